"""Queries of lines, routes and time grids over the driver's tables: orders are routes, their items the points of a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.functions import times
from alertlake.functions.geo import KM_LAT, KM_LON, angle_between, count_weight, haversine_sql, local_vector, offset_point, smoothstep
from alertlake.operators import chains, geometry, intervals
from alertlake.plans.queries import LAT, LON, points
from alertlake.plans.registry import query, table

LINE_SQL = f"""p AS (SELECT l_orderkey AS route, l_linenumber AS seq, ({LON.format('l_partkey')})::DOUBLE / 8 AS lon, ({LAT.format('l_partkey')})::DOUBLE / 8 AS lat FROM lineitem),
          l0 AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM p WINDOW w AS (PARTITION BY route ORDER BY seq, lon, lat)),
          l1 AS (SELECT *, coalesce({haversine_sql('lat0', 'lon0', 'lat', 'lon')}, 0) AS step FROM l0),
          l2 AS (SELECT *, sum(step) OVER (PARTITION BY route ORDER BY seq, lon, lat ROWS UNBOUNDED PRECEDING) AS km FROM l1),
          line AS (SELECT *, coalesce(km / nullif(max(km) OVER (PARTITION BY route), 0), 0) AS progress FROM l2)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a route of items."""
    p = points(spark, sf_dir, "lineitem", "l_partkey")
    return p.select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("seq"), (F.col("lon") / 8).alias("lon"), (F.col("lat") / 8).alias("lat"))


@query(f"WITH {LINE_SQL} SELECT route, seq, round(km, 4) AS km, round(progress, 8) AS progress FROM line")
def cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chains.progress_along(lines(spark, sf_dir), ["route"], ["seq", "lon", "lat"])
    return found.select("route", "seq", F.round("km", 4).alias("km"), F.round("progress", 8).alias("progress"))


REGION_SQL = "CASE WHEN {lon} > 20 THEN NULL ELSE (floor(({lon} + 30) / 5))::INTEGER END"


@query(f"""WITH {LINE_SQL}, legs AS (SELECT route, row_number() OVER (PARTITION BY route ORDER BY seq, lon, lat) - 1 AS leg, step AS km, {REGION_SQL.format(lon='(lon0 + lon) / 2')} AS region FROM l1),
          g AS (SELECT *, region % 3 = 0 AS lit FROM legs WHERE leg > 0),
          s AS (SELECT route, sum(CASE WHEN lit THEN km ELSE 0 END) AS lit_km, sum(CASE WHEN NOT lit THEN km ELSE 0 END) AS unlit_km, sum(CASE WHEN region IS NULL THEN km ELSE 0 END) AS outside_km, count(DISTINCT region) FILTER (lit) AS lit_regions, count(DISTINCT region) FILTER (NOT lit) AS unlit_regions FROM g GROUP BY route),
          i AS (SELECT *, lag(lit) OVER (PARTITION BY route ORDER BY leg) AS before, min(leg) FILTER (lit) OVER (PARTITION BY route) AS lo, max(leg) FILTER (lit) OVER (PARTITION BY route) AS hi FROM g WHERE region IS NOT NULL),
          b AS (SELECT route, count(DISTINCT region) AS bridge_regions, count(*) FILTER (before) AS bridge_runs FROM i WHERE NOT lit AND leg > lo AND leg < hi GROUP BY route)
          SELECT route, round(lit_km, 3) AS lit_km, round(unlit_km, 3) AS unlit_km, round(outside_km, 3) AS outside_km, lit_regions, unlit_regions, coalesce(bridge_regions, 0) AS bridge_regions, coalesce(bridge_runs, 0) AS bridge_runs FROM s LEFT JOIN b USING (route)""")
def route_region_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs in strips of five degrees as regions, every third of them lit, none in the east."""
    legs = geometry.legs_of(lines(spark, sf_dir), ["route"], ["seq", "lon", "lat"]).withColumn("region", F.when(F.col("lon") <= 20, F.floor((F.col("lon") + 30) / 5).cast("int")))
    lit = spark.range(-40, 40).select(F.col("id").cast("int").alias("region")).where("region % 3 = 0")
    found = geometry.route_regions(legs, ["route"], lit)
    return found.select("route", *(F.round(c, 3).alias(c) for c in ("lit_km", "unlit_km", "outside_km")), "lit_regions", "unlit_regions", "bridge_regions", "bridge_runs")


@query(f"""WITH {LINE_SQL}, q AS (SELECT o_orderkey AS route, ({LON.format('o_custkey')})::DOUBLE / 8 AS plon, ({LAT.format('o_custkey')})::DOUBLE / 8 AS plat FROM orders),
          s AS (SELECT route, seq, lon0, lat0, lon, lat, progress AS p1, lag(progress) OVER (PARTITION BY route ORDER BY seq, lon, lat) AS p0 FROM line),
          m AS (SELECT *, (lon - lon0) * {KM_LON} * cos(radians(plat)) AS vx, (lat - lat0) * {KM_LAT} AS vy, (plon - lon0) * {KM_LON} * cos(radians(plat)) AS ux, (plat - lat0) * {KM_LAT} AS uy FROM q JOIN s USING (route) WHERE lon0 IS NOT NULL),
          t AS (SELECT *, greatest(0, least(1, coalesce((ux * vx + uy * vy) / nullif(vx * vx + vy * vy, 0), 0))) AS t FROM m),
          d AS (SELECT *, pow(ux - vx * t, 2) + pow(uy - vy * t, 2) AS off FROM t)
          SELECT route, round(arg_min(p0 + (p1 - p0) * t, (round(sqrt(off), 6), seq, p0 + (p1 - p0) * t)), 6) AS progress FROM d GROUP BY route""")
def nearest_on_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far along its route the nearest place to a point lies."""
    line = chains.progress_along(lines(spark, sf_dir), ["route"], ["seq", "lon", "lat"])
    asked = points(spark, sf_dir, "orders", "o_custkey").select(F.col("o_orderkey").alias("route"), F.col("o_orderkey").alias("point_id"), (F.col("lon") / 8).alias("lon"), (F.col("lat") / 8).alias("lat"))
    return geometry.nearest_progress(line, asked, ["route"]).select("route", F.round("progress", 6).alias("progress"))


AT_SQL = "lon{k}0 + (lon{k}1 - lon{k}0) * t{k}"


@query(f"""WITH {LINE_SQL}, n AS (SELECT route, count(*) AS points FROM line GROUP BY route HAVING count(*) >= 2), r AS (SELECT route, points, 0.15 AS tail, (route % 90 + 9) / 100.0 AS head FROM n),
          s AS (SELECT route, lon0, lat0, lon, lat, progress AS p1, lag(progress) OVER (PARTITION BY route ORDER BY seq, lon, lat) AS p0, row_number() OVER (PARTITION BY route ORDER BY seq, lon, lat) AS i FROM line),
          a AS (SELECT r.route, arg_min(lon0 + (lon - lon0) * greatest(0, least(1, coalesce((head - p0) / nullif(p1 - p0, 0), 0))), i) AS head_lon, arg_min(lat0 + (lat - lat0) * greatest(0, least(1, coalesce((head - p0) / nullif(p1 - p0, 0), 0))), i) AS head_lat FROM r JOIN s USING (route) WHERE i > 1 AND (p1 >= head OR i = points) GROUP BY r.route),
          c AS (SELECT r.route, CASE WHEN head > tail THEN 2 + count(*) FILTER (i > 1 AND i < points AND p1 > tail AND p1 < head) END AS n_points FROM r JOIN s USING (route) GROUP BY r.route, head, tail)
          SELECT route, round(head_lon, 6) AS head_lon, round(head_lat, 6) AS head_lat, n_points::INTEGER AS n_points FROM a JOIN c USING (route)""")
def parts_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point at a share of each route, and the points of the part from 0.15 on to there."""
    line = chains.progress_along(lines(spark, sf_dir), ["route"], ["seq", "lon", "lat"])
    whole = line.groupBy("route").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat", "progress"))), lambda p: F.struct(p["progress"].alias("progress"), p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line")).where("size(line) >= 2")
    head = (F.col("route") % 90 + 9) / 100.0
    found = whole.select("route", chains.point_at(F.col("line"), head).alias("h"), F.size(chains.sub_line(F.col("line"), F.lit(0.15), head)).alias("n"))
    return found.select("route", F.round("h.lon", 6).alias("head_lon"), F.round("h.lat", 6).alias("head_lat"), F.when(F.col("n") >= 0, F.col("n")).alias("n_points"))


@query(f"""SELECT c_custkey, round((10 - lon) * {KM_LON} * cos(radians(47.0)), 6) AS x, round((50 - lat) * {KM_LAT}, 6) AS y, round(lon + 12.5 / greatest(20, {KM_LON} * cos(radians(lat))), 8) AS east, round(lat - 7.25 / {KM_LAT}, 8) AS south,
           round(abs(fmod(fmod(lon - lat * 2 + 180, 360) + 360, 360) - 180), 6) AS turn, round(least(1.8, log2(c_custkey % 70 + 1) * 0.42), 9) AS weight, round(pow((c_custkey % 11) / 10.0, 2) * (3 - 2 * (c_custkey % 11) / 10.0), 9) AS eased
           FROM (SELECT c_custkey, ({LON.format('c_custkey')})::DOUBLE AS lon, ({LAT.format('c_custkey')})::DOUBLE AS lat FROM customer)""")
def local_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and offsets on a local plane, angles between bearings, weights of counts, easing."""
    p = points(spark, sf_dir, "customer", "c_custkey")
    to = local_vector(F.col("lat"), F.col("lon"), F.lit(50.0), F.lit(10.0), F.lit(47.0))
    off = offset_point(F.col("lat"), F.col("lon"), F.lit(12.5), F.lit(-7.25), F.col("lat"))
    r = lambda c, n, name: F.round(c, n).alias(name)
    return p.select("c_custkey", r(to["x"], 6, "x"), r(to["y"], 6, "y"), r(off["lon"], 8, "east"), r(off["lat"], 8, "south"), r(angle_between(F.col("lon"), F.col("lat") * 2), 6, "turn"), r(count_weight(F.col("c_custkey") % 70), 9, "weight"), r(smoothstep((F.col("c_custkey") % 11) / 10.0), 9, "eased"))


SEG_SQL = """s AS (SELECT l_suppkey % 30 AS line_id, l_orderkey * 10 + l_linenumber AS seg_no, (l_partkey % 400)::DOUBLE AS x1, (l_orderkey % 370)::DOUBLE AS y1, (l_partkey % 400 + l_linenumber % 3)::DOUBLE AS x2, (l_orderkey % 370 + l_quantity::INTEGER % 4)::DOUBLE + 0.5 AS y2 FROM lineitem)"""


@query(f"""WITH {SEG_SQL}, c AS (SELECT *, unnest(range(floor(y1 / 4)::BIGINT, floor(y2 / 4)::BIGINT + 1)) AS cy FROM (SELECT *, unnest(range(floor(x1 / 4)::BIGINT, floor(x2 / 4)::BIGINT + 1)) AS cx FROM s)),
          o AS (SELECT DISTINCT a.line_id, b.line_id AS other_id, a.seg_no AS s1, b.seg_no AS s2,
          (a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1) AS t1, (a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1) AS t2,
          (b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1) AS t3, (b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1) AS t4
          FROM c a JOIN c b USING (cx, cy) WHERE a.line_id < b.line_id)
          SELECT line_id, other_id, least(4, count(*))::INTEGER AS n FROM o WHERE ((t1 > 1e-8 AND t2 < -1e-8) OR (t1 < -1e-8 AND t2 > 1e-8)) AND ((t3 > 1e-8 AND t4 < -1e-8) OR (t3 < -1e-8 AND t4 > 1e-8)) GROUP BY ALL""")
def line_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proper crossings of lines made of items, counted up to four."""
    d = lambda c, n: F.col(c).cast("long") % n
    segs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 30).alias("line_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seg_no"), d("l_partkey", 400).cast("double").alias("x1"), d("l_orderkey", 370).cast("double").alias("y1"), (d("l_partkey", 400) + d("l_linenumber", 3)).cast("double").alias("x2"), (d("l_orderkey", 370) + d("l_quantity", 4) + 0.5).cast("double").alias("y2"))
    return geometry.crossings(segs)


@query("""WITH r AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS a, o_orderdate::TIMESTAMP + to_hours(o_custkey % 300 + 1) AS b FROM orders),
          n AS (SELECT *, epoch_ms(b) - epoch_ms(a) AS ms, CASE WHEN (epoch_ms(b) - epoch_ms(a)) / 86400000.0 <= 2 THEN 9 WHEN (epoch_ms(b) - epoch_ms(a)) / 86400000.0 <= 7 THEN 8 ELSE 7 END AS n FROM r),
          t AS (SELECT o_orderkey, ms, n, unnest(range(0, n)) AS i, epoch_ms(a) AS a FROM n), u AS (SELECT *, make_timestamp((a + floor(ms * (i / (n - 1)))::BIGINT) * 1000) + INTERVAL 3 HOUR AS local FROM t)
          SELECT o_orderkey, i::INTEGER AS i, round(i / (n - 1), 9) AS share, CASE WHEN ms / 86400000.0 <= 1.5 THEN strftime(local, '%H:%M') ELSE strftime(local, '%m/%d %H') END AS label FROM u""")
def tick_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks on time lines of one hour to 300; the zone stood at +03:00 in the years of the data (1995 had summer time, so the SQL's offset is asked of a fixed zone)."""
    a = F.col("o_orderdate").cast("timestamp")
    b = a + F.make_dt_interval(F.lit(0), (F.col("o_custkey") % 300 + 1).cast("int"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(times.ticks(a, b, zone="+03:00")).alias("i", "t"))
    return found.select("o_orderkey", "i", F.round("t.share", 9).alias("share"), "t.label")


@query("""SELECT o_orderkey, (floor((o_custkey % 500) * 60000 / 31500) + 1 + CASE WHEN ((o_custkey % 500) * 60000) % 31500 > 0 THEN 1 ELSE 0 END)::INTEGER AS frames,
          strftime(o_orderdate::TIMESTAMP + INTERVAL 2 HOUR, '%Y%m%d_%H%M') AS stamp, ((o_custkey % 500) // 60)::BIGINT AS hour_of_span,
          CASE WHEN o_custkey % 500 >= 60 THEN ((o_custkey % 500) // 60) || ' h ' || ((o_custkey % 500) % 60) || ' min' ELSE (o_custkey % 500) || ' min' END AS duration, round((o_custkey % 500) / 60.0, 9) AS hours FROM orders""")
def time_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a playback, stamps for file names, whole hours, durations."""
    a = F.col("o_orderdate").cast("timestamp")
    b = a + F.make_dt_interval(mins=(F.col("o_custkey") % 500).cast("int"))
    grid = times.playback_grid(a, b, minutes_per_second=1.5)
    hour = times.hour_of(b) - times.hour_of(a)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(grid).alias("frames"), times.file_stamp(a, "+02:00").alias("stamp"), hour.alias("hour_of_span"), times.duration_text(a, b).alias("duration"), F.round(times.hours_between(a, b), 9).alias("hours"))


@query("""SELECT o_orderkey, make_timestamp(epoch_us(o_orderdate::TIMESTAMP) - 3 * 3600000000) AS low, make_timestamp(epoch_us(o_orderdate::TIMESTAMP) + 21 * 3600000000 - 1000000) AS high,
          make_timestamp((epoch_ms(o_orderdate::TIMESTAMP) + least(1000, greatest(0, o_custkey % 1300 - 100)) * 86400)::BIGINT * 1000) AS slid FROM orders""")
def day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of calendar days at +03:00, and instants at shares of a day held to its ends."""
    day = times.day_bounds(F.col("o_orderdate"), "+03:00")
    a = F.col("o_orderdate").cast("timestamp")
    slid = times.at_share(a, a + F.expr("INTERVAL 1 DAY"), (F.col("o_custkey") % 1300 - 100) / 1000)
    ntz = lambda c, name: c.cast("timestamp_ntz").alias(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", ntz(day["start"], "low"), ntz(day["end"], "high"), ntz(slid, "slid"))


@query(f"""WITH n AS (SELECT event_id, user_id % 5 = 0 AS proxy, ts, (user_id * 37 % 400) / 40.0 + 30 AS lon, (user_id * 53 % 120) / 30.0 + 50 AS lat, CASE WHEN event_id % 2 = 0 THEN 'uav' ELSE 'missile' END AS threat FROM events)
          SELECT event_id FROM n w WHERE NOT proxy OR NOT EXISTS (SELECT 1 FROM n s WHERE NOT s.proxy AND s.threat = w.threat AND s.ts BETWEEN w.ts AND w.ts + INTERVAL 90 MINUTE AND epoch_ms(s.ts) - epoch_ms(w.ts) <= 5400000 AND {haversine_sql('w.lat', 'w.lon', 's.lat', 's.lon')} < 45)""")
def weak_nodes_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    lon, lat = (F.col("user_id") * 37 % 400) / 40.0 + 30, (F.col("user_id") * 53 % 120) / 30.0 + 50
    nodes = events.select(F.col("event_id").alias("node_id"), (F.col("user_id") % 5 == 0).alias("proxy"), F.col("ts").alias("at"), lon.alias("lon"), lat.alias("lat"), F.when(F.col("event_id") % 2 == 0, "uav").otherwise("missile").alias("threat_class"))
    return chains.suppressed(nodes).select(F.col("node_id").alias("event_id"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 40 > 0 AND o_orderstatus IN ('O', 'P') THEN least(64, o_custkey % 40 * 3) END AS evidence FROM orders""")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "O", "attacked").when(F.col("o_orderstatus") == "P", "detected_reported").otherwise("shot_down")
    return table(spark, sf_dir, "orders").select("o_orderkey", chains.evidence_count(F.col("o_custkey") % 40 * 3, kind).alias("evidence"))


@query("""WITH n AS (SELECT event_id, user_id * 100 + extract(day FROM ts) AS end_id, user_id, (event_id % 4 + 1)::BIGINT AS observations, 1 + (event_id % 7) / 5.0 AS weight, CASE WHEN event_id % 3 = 0 THEN (event_id % 50)::BIGINT END AS observed_count, event_id % 11 = 0 AS proxy FROM events),
          g AS (SELECT end_id, user_id, count(*) AS supports, sum(observations) AS evidence, sum(weight) AS weighted, coalesce(max(observed_count), 0) AS observed_most, count(*) FILTER (proxy) AS proxies FROM n GROUP BY ALL)
          SELECT end_id, evidence::BIGINT AS evidence, round(weighted, 6) AS weighted, observed_most, proxies, round(1 + least(0.55, greatest(0, weighted - supports) * 0.08), 6) AS route_weight,
          round(least(1, 0.22 + supports * 0.17 + least(0.22, evidence * 0.035) + least(0.10, greatest(0, weighted - supports) * 0.018) + CASE WHEN end_id % 2 = 0 THEN 0.12 ELSE 0 END - proxies * 0.08), 6) AS confidence FROM g""")
def chain_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events of a day as chains: what supports each, and how far it is to be believed."""
    e = F.col("event_id")
    nodes = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("end_id"), e.alias("node_id"), (e % 4 + 1).alias("observations"), (1 + (e % 7) / 5.0).alias("weight"), F.when(e % 3 == 0, e % 50).alias("observed_count"), (e % 11 == 0).alias("proxy"))
    paths = nodes.groupBy("end_id").agg(F.sort_array(F.collect_list("node_id")).alias("path"))
    found = chains.evidence_of(paths, nodes.drop("end_id"), F.col("end_id") % 2 == 0)
    return found.select("end_id", "evidence", F.round("weighted", 6).alias("weighted"), "observed_most", "proxies", F.round("route_weight", 6).alias("route_weight"), F.round("confidence", 6).alias("confidence"))


@query("""SELECT user_id, event_id, ts, strftime(ts, '%Y-%m-%dT%H') AS hour FROM (SELECT *, count(*) OVER (PARTITION BY user_id, date_trunc('hour', ts)) AS n FROM events) WHERE n >= 2""")
def busy_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that share their hour with another of their user: instants in hours as intervals."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    hours = events.select("user_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("start")).groupBy("user_id", "start").agg(F.count("*").alias("n")).where("n >= 2")
    spans = hours.select(F.col("user_id").alias("of"), "start", (F.col("start") + F.expr("INTERVAL 3599.999999 SECONDS")).alias("end"))
    met = intervals.stab(spans, events.withColumnRenamed("ts", "at")).where("of = user_id")
    return met.select("user_id", "event_id", F.col("at").alias("ts"), F.date_format("at", "yyyy-MM-dd'T'HH").alias("hour"))


WAY_SQL = f"""l AS (SELECT o_orderkey, ({LON.format('o_custkey')})::DOUBLE + 0.05 AS x1, ({LAT.format('o_custkey')})::DOUBLE + 0.05 AS y1, (o_orderkey * 7 % 300 - 150)::DOUBLE / 10 + 0.013 AS dx, (o_orderkey * 11 % 200 - 100)::DOUBLE / 10 + 0.017 AS dy FROM orders),
          e AS (SELECT n_nationkey AS region, n_nationkey * 14.0::DOUBLE + ax AS ax, ay, n_nationkey * 14.0::DOUBLE + bx AS bx, b_y FROM nation, (VALUES (-178, -50, -166, -50), (-166, -50, -166, 50), (-166, 50, -178, 50), (-178, 50, -178, -50),
             (-174, -5, -170, -5), (-170, -5, -170, 5), (-170, 5, -174, 5), (-174, 5, -174, -5)) AS v(ax, ay, bx, b_y)),
          c AS (SELECT DISTINCT o_orderkey, region, round(((ax - x1) * (b_y - ay) - (ay - y1) * (bx - ax)) / nullif(dx * (b_y - ay) - dy * (bx - ax), 0), 9) AS till FROM l, e
                WHERE (dx * (ay - y1) - dy * (ax - x1) > 0) <> (dx * (b_y - y1) - dy * (bx - x1) > 0)),
          t AS (SELECT o_orderkey, n_nationkey AS region, 1.0::DOUBLE AS till FROM l, nation UNION SELECT * FROM c WHERE till > 0 AND till < 1),
          s AS (SELECT *, coalesce(lag(till) OVER (PARTITION BY o_orderkey, region ORDER BY till), 0) AS since FROM t),
          m AS (SELECT *, x1 + dx * (since + till) / 2 - region * 14.0 AS x, y1 + dy * (since + till) / 2 AS y FROM s JOIN l USING (o_orderkey)),
          i AS (SELECT *, x > -178 AND x < -166 AND y > -50 AND y < 50 AND NOT (x > -174 AND x < -170 AND y > -5 AND y < 5) AS inside FROM m),
          w AS (SELECT *, (inside <> coalesce(lag(inside) OVER (PARTITION BY o_orderkey, region ORDER BY till), NOT inside))::INTEGER AS turn FROM i),
          p AS (SELECT *, sum(turn) OVER (PARTITION BY o_orderkey, region ORDER BY till)::INTEGER AS piece FROM w),
          g AS (SELECT o_orderkey, region, piece, min(since) AS since, max(till) AS till, bool_or(inside) AS inside FROM p GROUP BY ALL),
          k AS (SELECT * FROM g WHERE inside OR piece > 1 OR till < 1)"""


def ways(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A straight way for each order, and a rectangle with a hole for each nation."""
    corner = lambda dx, y: f"named_struct('lon', n_nationkey * 14.0D - {dx}, 'lat', {y}D)"
    ring = lambda w, e, y: f"array({corner(w, -y)}, {corner(e, -y)}, {corner(e, y)}, {corner(w, y)}, {corner(w, -y)})"
    shapes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_nationkey").alias("region"), F.expr(f"array({ring(178, 166, 50.0)}, {ring(174, 170, 5.0)})").alias("polygon"))
    key = F.col("o_orderkey")
    p = points(spark, sf_dir, "orders", "o_custkey").select(key.alias("line_id"), (F.col("lon") + 0.05).alias("lon1"), (F.col("lat") + 0.05).alias("lat1"), ((key * 7 % 300 - 150) / 10 + 0.013).alias("dx"), ((key * 11 % 200 - 100) / 10 + 0.017).alias("dy"))
    return p.select("line_id", "lon1", "lat1", (F.col("lon1") + F.col("dx")).alias("lon2"), (F.col("lat1") + F.col("dy")).alias("lat2")), shapes


@query(f"WITH {WAY_SQL} SELECT o_orderkey, region, piece, round(since, 6) AS since, round(till, 6) AS until, round(till - since, 6) AS share, inside FROM k")
def boundary_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways cut where they go into a nation's shape and out of it: the shares of each way and nation sum to one."""
    found = geometry.cut_at_edges(*ways(spark, sf_dir))
    r = lambda c, name: F.round(c, 6).alias(name)
    return found.select(F.col("line_id").alias("o_orderkey"), "region", "piece", r("since", "since"), r("until", "until"), r(F.col("until") - F.col("since"), "share"), "inside")


@query(f"""WITH {WAY_SQL}, f AS (SELECT o_orderkey, coalesce(min(since) FILTER (since > 0), 0) AS share FROM k WHERE inside GROUP BY o_orderkey)
          SELECT o_orderkey, round(share, 6) AS share, round(x1 + dx * share, 6) AS lon, round(y1 + dy * share, 6) AS lat FROM f JOIN l USING (o_orderkey)""")
def boundary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each way first comes into any nation's shape (shapes lie apart, so the SQL needs no union of them)."""
    lines, shapes = ways(spark, sf_dir)
    found = geometry.first_entries(lines, geometry.cut_at_edges(lines, shapes))
    return found.select(F.col("line_id").alias("o_orderkey"), *(F.round(c, 6).alias(c) for c in ("share", "lon", "lat")))
