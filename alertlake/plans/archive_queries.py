"""Queries of what is read, written and put in order: sources, windows, archives, catalogs, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.operators import chains, coverage
from alertlake.plans.collect import archived, purge_archive
from alertlake.plans.message_queries import LOW, constant, job, ntz, places
from alertlake.plans.registry import query, table
from alertlake.plans.stream_queries import fresh
from alertlake.sources import archive, gazetteer, posts
from alertlake.streaming import ingest


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string").alias("forwarded_from")
    return e.select(F.col("user_id").cast("string").alias("channel"), F.col("event_id").cast("string").alias("post_id"), F.col("ts").cast("timestamp").alias("published_at"), F.col("event_type").alias("text"), F.col("props").alias("url"), none)


@query("SELECT user_id, event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-12'")
def posts_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of a window and of the 48 hours before it, written as JSON and read back."""
    path = fresh(spark, "posts-json")
    event_posts(spark, sf_dir).write.json(path)
    found = posts.in_context(posts.posts_from_json(spark, path), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return found.select(F.col("channel").cast("long").alias("user_id"), F.col("post_id").cast("long").alias("event_id"))


@query("""SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 6 = 0 THEN (c_custkey % 4)::INTEGER WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 2 END, CASE WHEN c_custkey % 5 = 0 THEN 50 ELSE c_custkey % 90 + 1 END, c_name) AS place
          FROM customer WHERE c_nationkey % 3 <> 0 AND c_custkey % 7 <> 1""")
def sources_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources: enabled channels, in the order in which they are collected."""
    key = F.col("c_custkey")
    layer = F.when(F.col("c_mktsegment") == "BUILDING", "monitoring_local").when(F.col("c_mktsegment") == "MACHINERY", "monitoring_national").otherwise("official_local")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("channel"), (F.col("c_nationkey") % 3 != 0).alias("enabled"), F.when(key % 7 == 1, "mchs_rss").when(key % 2 == 0, "telegram").alias("kind"), F.when(key % 6 == 0, (key % 4).cast("int")).alias("coverage_priority"), layer.alias("source_layer"), F.when(key % 5 == 0, F.when(key % 2 == 0, 0)).otherwise((key % 90 + 1).cast("int")).alias("priority"))
    ordered = posts.in_collection_order(posts.telegram_sources(rows)).select("c_custkey").withColumn("place", F.monotonically_increasing_id())
    # Partitions and rows inside them are in order, so ids rise with it; a running number by days of them would do for more.
    return ordered.select("c_custkey", F.expr("row_number() OVER (ORDER BY place)").cast("long").alias("place"))


@query("""SELECT s_suppkey AS end_id, row_number() OVER (ORDER BY floor((s_nationkey + 0.05) / 0.15) DESC, (s_suppkey % 40)::DOUBLE, s_suppkey) AS place FROM supplier""")
def terminals_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of chains from north to south in bands, then from west to east."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("end_id"), (F.col("s_nationkey") + 0.05).cast("double").alias("lat"), (F.col("s_suppkey") % 40).cast("double").alias("lon"), F.lit(LOW).alias("at"))
    ordered = chains.in_terminal_order(s).select("end_id").withColumn("place", F.monotonically_increasing_id())
    return ordered.select("end_id", F.expr("row_number() OVER (ORDER BY place)").cast("long").alias("place"))


@query("SELECT user_id, event_type, date_trunc('hour', ts) AS hour, count(*) AS posts FROM events GROUP BY ALL")
def activity_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts per hour and key, as a stream counts them."""
    rows = event_posts(spark, sf_dir).select(F.col("channel").cast("long").alias("user_id"), F.col("text").alias("event_type"), "published_at")
    return ingest.hourly_activity(rows, ["user_id", "event_type"]).select("user_id", "event_type", *ntz("hour"), "posts")


@query("SELECT event_type AS region, count(*) AS observations, count(DISTINCT user_id % 20) AS places FROM events GROUP BY event_type")
def observations_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live reports as observations: how many reports each region's hold, and at how many places."""
    e = table(spark, sf_dir, "events")
    place = F.col("user_id") % 20
    none = F.array().cast("array<struct<name:string,lat:double,lon:double>>")
    named = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(place.cast("string").alias("name"), F.lit(50.0).alias("lat"), (place * 0.1).cast("double").alias("lon")))).otherwise(none)
    records = e.select(F.col("event_type").alias("region"), place.cast("string").alias("place"), F.lit(50.0).alias("lat"), (place * 0.1).cast("double").alias("lon"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 5 == 0, "region").otherwise("city").alias("scope"), F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 90).cast("int")).alias("count"), F.lit("uav").alias("threat_class"), named.alias("mentioned_places"))
    nodes = chains.nodes_of(records)
    return nodes.groupBy("region").agg(F.sum("observations").alias("observations"), F.count_distinct("place").alias("places"))


@query("""SELECT 0 AS line_no, '- customers: **' || count(*) || '**' AS line FROM customer UNION ALL SELECT 1, '- orders: **' || count(*) || '**' FROM orders
          UNION ALL SELECT 1000 + row_number() OVER (ORDER BY n_name), '| ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'gap' ELSE 'covered' END || ' | ' || coalesce(n, 0) || ' |' FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def report_of_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown report of totals and of a line for each region."""
    totals = table(spark, sf_dir, "customer").agg(F.count("*").alias("customers")).join(table(spark, sf_dir, "orders").agg(F.count("*").alias("orders")), F.expr("true"))
    counts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    gaps = table(spark, sf_dir, "nation").join(counts, "n_nationkey", "left").select(F.col("n_name").alias("region"), F.when(F.col("n_nationkey") % 2 == 0, "gap").otherwise("covered").alias("state"), F.coalesce("n", F.lit(0)).cast("string").alias("sources"))
    return coverage.health_report(totals, gaps)


@query("""SELECT row_number() OVER (ORDER BY o_orderdate, o_orderpriority, o_orderkey) AS place, o_orderkey FROM orders""")
def exported_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records exported as JSON lines in order of time, region and place, and read back."""
    path = fresh(spark, "export")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("region"), F.col("o_orderkey").alias("place"))
    archive.export_json(rows, path)
    read = spark.read.schema("at timestamp, region string, place long").json(path).withColumns({"file": F.input_file_name(), "line": F.monotonically_increasing_id()})
    return read.select(F.expr("row_number() OVER (ORDER BY file, line)").cast("long").alias("place"), F.col("place").alias("o_orderkey"))


@query("SELECT 2 * count(*) AS events, 7 * count(*) AS reports, count(*) AS purged, 0::BIGINT AS again FROM supplier")
def archive_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive written with a tally for every source's first report; purged, it holds what it held before, and a second purge finds nothing."""
    root, run = fresh(spark, "archive"), job(spark, sf_dir)
    tables = archived(run, None, None, F.lit(LOW), places(spark))
    reports = tables["reports"]
    tallies = reports.where("count = 3").withColumns({"id": F.concat(F.lit("tally-"), "id"), "text": F.lit("За ночь уничтожены 12 БПЛА.")})
    archive.write_archive({**tables, "reports": reports.unionByName(tallies)}, run.status, root, LOW, LOW, "initial")
    gone = purge_archive(spark, root)[0]
    again = purge_archive(spark, root)[0]
    left = archive.read_archive(spark, root, "reports").agg(F.count("*").alias("reports"))
    events = archive.read_archive(spark, root, "events").agg(F.count("*").alias("events"))
    return events.join(left, F.expr("true")).select("events", "reports", constant(gone, "long").alias("purged"), constant(again, "long").alias("again"))


@query("""SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_nationkey + 0.5 AS lat, s_suppkey % 100 + 0.25 AS lon, (s_suppkey % 50)::BIGINT AS population FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 9 <> 0""")
def places_dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of places, tab by tab, written and read back: those of one country that have a point."""
    key, path = F.col("s_suppkey"), fresh(spark, "dump")
    known = {"id": key.cast("string"), "name": F.col("s_name"), "lat": F.when(key % 9 == 0, "?").otherwise((F.col("s_nationkey") + 0.5).cast("string")), "lon": (key % 100 + 0.25).cast("string"), "country": F.when(F.col("s_nationkey") % 2 == 0, "RU").otherwise("XX"), "population": (key % 50).cast("string"), "modified": F.lit("2024-01-01")}
    line = F.concat_ws("\t", *(known.get(c, F.lit("x")) for c in gazetteer.COLUMNS))
    table(spark, sf_dir, "supplier").select(line).write.text(path)
    return gazetteer.place_dump(spark, path, "RU").select("id", "name", "lat", "lon", "population")


@query("""SELECT 'r' || n_nationkey AS region, 5 AS corners, n_nationkey::DOUBLE AS west, n_nationkey + 1.5 AS north FROM nation""")
def shapes_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as squares, written as GeoJSON and read as shapes."""
    path, west = fresh(spark, "shapes"), F.col("n_nationkey").cast("double")
    point = lambda x, y: F.array(x, y)
    ring = F.array(point(west, west), point(west + 1.5, west), point(west + 1.5, west + 1.5), point(west, west + 1.5), point(west, west))
    polygon = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.array(ring))).otherwise(F.to_json(F.array(F.array(ring))))
    kind = F.when(F.col("n_nationkey") % 2 == 0, "Polygon").otherwise("MultiPolygon")
    feature = F.concat(F.lit('{"type":"Feature","properties":{"name":"r'), F.col("n_nationkey").cast("string"), F.lit('"},"geometry":{"type":"'), kind, F.lit('","coordinates":'), polygon, F.lit("}}"))
    whole = table(spark, sf_dir, "nation").groupBy(F.lit(1)).agg(F.concat_ws(",", F.collect_list(feature)).alias("all"))  # a country's regions: one file
    whole.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}"))).coalesce(1).write.text(path)
    found = gazetteer.shapes(spark, path)
    corners = F.flatten("polygon")
    return found.select("region", F.size(corners).alias("corners"), F.array_min(F.transform(corners, lambda p: p["lon"])).alias("west"), F.array_max(F.transform(corners, lambda p: p["lat"])).alias("north"))
