"""The registered queries over the driver's tables, each with the SQL of the same rows where SQL can say it.

The tables have no alerts, so each operator is put to work on what has its shape: `signup`
and `error` events open and close a user's interval, customers stand for places with points
made of their keys, parts' names for a gazetteer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlake.functions.geo import KM_LAT, KM_LON, bearing_deg, corridor, haversine_sql
from alertlake.functions.rules import counted, labelled, labelled_sql
from alertlake.functions.text import first_of, fnv1a, normalize, phrase_hits, sentences, stable_id, strip_html
from alertlake.functions.times import local_day
from alertlake.operators import chains, coverage, geometry, intervals, merge, pairing, sessions
from alertlake.operators.gazetteer import without_fallback
from alertlake.plans.registry import query, table


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end")
    return table(spark, sf_dir, "events").withColumn("kind", kind).where("kind is not null").select("user_id", "ts", "event_id", "kind", "value")


def user_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairing.pair(tokens(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["ts", "event_id"])
    return found.select("user_id", F.col("start_ts").alias("start"), F.col("end_ts").alias("end"), F.col("start_event_id").alias("start_id"), F.col("end_event_id").alias("end_id"))


KEPT = """
    tok AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'start' ELSE 'end' END AS kind FROM events WHERE event_type IN ('signup', 'error')),
    seen AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM tok),
    kept AS (SELECT *, lag(ts) OVER w AS start, lag(event_id) OVER w AS start_id, lead(kind) OVER w AS nxt FROM seen
             WHERE (kind = 'start' AND (prev IS NULL OR prev = 'end')) OR (kind = 'end' AND prev = 'start') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    iv AS (SELECT user_id, start, ts AS "end", start_id, event_id AS end_id FROM kept WHERE kind = 'end')"""


@query(f"WITH {KEPT} SELECT * FROM iv")
def pair_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_intervals(spark, sf_dir)


@query(f"WITH {KEPT} SELECT * FROM iv")
def pair_intervals_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by buckets of a day: no user passes through one task."""
    found = pairing.pair(tokens(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["ts", "event_id"], bucket=F.to_date("ts"))
    return found.select("user_id", F.col("start_ts").alias("start"), F.col("end_ts").alias("end"), F.col("start_event_id").alias("start_id"), F.col("end_event_id").alias("end_id"))


@query(f"WITH {KEPT} SELECT user_id, ts, event_id FROM kept WHERE kind = 'start' AND nxt IS NULL")
def unmatched_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.still_open(tokens(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["ts", "event_id"])


def hours_of(events: DataFrame) -> DataFrame:
    return events.select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("at")).distinct()


HOURS = """hours AS (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS "at" FROM events)"""


@query(f"""WITH {KEPT}, {HOURS} SELECT "at", count(*) AS active, count(DISTINCT user_id) AS users FROM hours JOIN iv ON start <= "at" AND "at" <= "end" GROUP BY "at\"""")
def active_at_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = intervals.stab(user_intervals(spark, sf_dir), hours_of(table(spark, sf_dir, "events")))
    return met.groupBy("at").agg(F.count("*").alias("active"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {KEPT}, {HOURS} SELECT "at", count(start) AS active FROM hours LEFT JOIN iv ON start <= "at" AND "at" <= "end" GROUP BY "at\"""")
def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.active_counts(user_intervals(spark, sf_dir), hours_of(table(spark, sf_dir, "events")))


@query("""SELECT a.event_id, count(*) AS near, min(b.event_id) AS first_id FROM events a JOIN events b
          ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 45 MINUTE AND a.ts + INTERVAL 45 MINUTE
          WHERE a.event_type = 'purchase' AND b.event_type = 'click' GROUP BY a.event_id""")
def reports_within_45m(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    a = events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    b = events.where("event_type = 'click'").select(F.col("event_id").alias("other_id"), "user_id", F.col("ts").alias("other_at"))
    return intervals.near_in_time(a, b, 45 * 60_000, on=["user_id"]).groupBy("event_id").agg(F.count("*").alias("near"), F.min("other_id").alias("first_id"))


LOW, HIGH = "2024-01-10 00:00:00", "2024-01-12 23:59:59"


MS = lambda t: f"(epoch_us({t}) // 1000)"
CLIP_LOW, CLIP_HIGH = f"greatest(start, TIMESTAMP '{LOW}')", f"""least("end", TIMESTAMP '{HIGH}')"""
RANGE_LOW, RANGE = MS(f"TIMESTAMP '{LOW}'"), f"""({MS(f"TIMESTAMP '{HIGH}'")} - {MS(f"TIMESTAMP '{LOW}'")})"""


@query(f"""WITH {KEPT} SELECT user_id, start_id, {CLIP_LOW} AS clip_start, {CLIP_HIGH} AS clip_end,
           round(({MS(CLIP_LOW)} - {RANGE_LOW}) / {RANGE} * 100, 6) AS left_pct, round(greatest(0.3, ({MS(CLIP_HIGH)} - {MS(CLIP_LOW)}) / {RANGE} * 100), 6) AS width_pct
           FROM iv WHERE "end" >= TIMESTAMP '{LOW}' AND start <= TIMESTAMP '{HIGH}'""")
def overlap_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (LOW, HIGH))
    found = intervals.clipped(user_intervals(spark, sf_dir), low, high)
    return found.select("user_id", "start_id", "clip_start", "clip_end", F.round("left_pct", 6).alias("left_pct"), F.round("width_pct", 6).alias("width_pct"))


VERSIONS = """versions AS (SELECT event_id AS id, value, 10 AS quality, 0 AS seq FROM events UNION ALL SELECT event_id, value + 1, CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 30 END, 1 FROM events)"""


@query(f"WITH {VERSIONS} SELECT id, value, quality, seq FROM versions QUALIFY row_number() OVER (PARTITION BY id ORDER BY quality DESC, seq DESC) = 1")
def dedup_best_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value")
    again = events.select("id", (F.col("value") + 1).alias("value"), F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, 10).otherwise(30).alias("quality"), F.lit(1).alias("seq"))
    return merge.best_version(events.withColumns({"quality": F.lit(10), "seq": F.lit(0)}).unionByName(again), ["id"], ["quality", "seq"])


@query("""WITH old AS (SELECT event_id AS id, user_id AS source_id, ts AS "at", CASE event_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 10 ELSE 20 END AS quality, 0 AS seq FROM events),
          new AS (SELECT event_id AS id, user_id AS source_id, ts AS "at", 20 AS quality, 1 AS seq FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_id % 5 <> 0),
          status AS (SELECT user_id AS source_id, max(CASE WHEN user_id % 7 = 0 THEN 0 ELSE 20 END) AS q FROM events GROUP BY user_id),
          kept AS (SELECT o.* FROM old o LEFT JOIN status s ON o.source_id = s.source_id WHERE "at" < TIMESTAMP '2024-01-15' OR quality > coalesce(q, 0) UNION ALL SELECT * FROM new)
          SELECT id, source_id, "at", quality FROM kept QUALIFY row_number() OVER (PARTITION BY id ORDER BY quality DESC, seq DESC) = 1""")
def merge_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("ts").alias("at"))
    start = F.lit("2024-01-15").cast("timestamp_ntz")
    old = rows.withColumn("quality", F.when(F.col("id") % 4 == 0, 30).when(F.col("id") % 4 == 1, 10).otherwise(20))
    new = rows.where((F.col("at") >= start) & (F.col("id") % 5 != 0)).withColumn("quality", F.lit(20))
    status = events.select(F.col("user_id").alias("source_id"), (F.col("user_id") % 7 != 0).alias("transport_ok"), F.lit(20).alias("quality")).distinct()
    return merge.merged(old, new, status, start)


@query("""WITH local AS (SELECT DISTINCT user_id % 50 AS region FROM events WHERE event_type = 'purchase' AND value > 60)
          SELECT event_type, user_id % 50 AS region, count(*) AS n FROM events WHERE event_type <> 'view' OR user_id % 50 NOT IN (SELECT region FROM local) GROUP BY ALL""")
def fallback_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("region", F.col("user_id") % 50)
    layer = F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), "monitoring_local").otherwise("other")
    kept = without_fallback(events.withColumns({"source_layer": layer, "fallback_only_if_no_local_activity": F.col("event_type") == "view"}))
    return kept.groupBy("event_type", "region").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT user_id FROM events UNION SELECT DISTINCT -c_custkey FROM customer),
          e AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, min(ts) AS oldest, max(ts) AS newest, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id)
          SELECT user_id, coalesce(n, 0) AS fetched_posts, coalesce(errors, 0) AS errors, oldest, newest,
          CASE WHEN user_id % 5 = 0 AND n IS NULL THEN 'inactive' WHEN user_id % 3 = 0 AND user_id % 11 <> 0 AND (coalesce(p, 0) > 20 OR user_id % 2 = 0) AND n IS NULL THEN 'quiet'
               WHEN user_id % 11 = 0 THEN 'failed' WHEN coalesce(p, 0) > 20 OR user_id % 2 = 0 THEN 'healthy' ELSE 'degraded' END AS health FROM s LEFT JOIN e USING (user_id)""")
def status_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are users and, without any post, customers under negative numbers."""
    sources = table(spark, sf_dir, "events").select("user_id").union(table(spark, sf_dir, "customer").select(-F.col("c_custkey"))).distinct()
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("posts"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    flags = {"fetched_posts": F.coalesce("posts", F.lit(0).cast("long")), "expected_active": F.col("user_id") % 5 != 0, "transport": F.when(F.col("user_id") % 3 == 0, "mtproto").otherwise("html"), "transport_ok": F.col("user_id") % 11 != 0, "window_complete": (F.coalesce("p", F.lit(0)) > 20) | (F.col("user_id") % 2 == 0)}
    fetched = sources.join(per.drop("errors"), "user_id", "left").withColumns(flags).drop("posts", "p")
    return coverage.source_status(fetched, per.select("user_id", "errors"), key="user_id").select("user_id", "fetched_posts", "errors", "oldest", "newest", "health")


STATUS = """st AS (SELECT user_id AS source, user_id % 40 AS region, user_id % 11 <> 0 AS transport_ok, user_id % 4 <> 0 AS window_complete,
          CASE WHEN user_id % 11 = 0 THEN 'failed' WHEN user_id % 4 <> 0 THEN 'healthy' ELSE 'degraded' END AS health, count(*) FILTER (event_type = 'purchase' AND value > 90) AS alert_posts,
          count(*) FILTER (event_type = 'click' AND value > 80) AS activity_posts, count(*) FILTER (event_type = 'error' AND value > 90) AS missile_activity_posts FROM events GROUP BY user_id)"""


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sources of 40 regions, with counts of their posts."""
    is_ = lambda kind, above: F.count_if((F.col("event_type") == kind) & (F.col("value") > above))
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(is_("purchase", 90).alias("alert_posts"), is_("click", 80).alias("activity_posts"), is_("error", 90).alias("missile_activity_posts"))
    fetched = counts.select("source", (F.col("source") % 40).alias("region"), F.lit(True).alias("expected_active"), F.lit("html").alias("transport"), (F.col("source") % 11 != 0).alias("transport_ok"), (F.col("source") % 4 != 0).alias("window_complete"), F.lit(1).alias("fetched_posts"))
    return coverage.source_status(fetched, counts)


EVENT_ROWS = """ev AS (SELECT o_custkey % 60 AS region, CASE o_orderstatus WHEN 'F' THEN 'region' WHEN 'O' THEN 'city' ELSE 'municipality' END AS scope FROM orders WHERE o_custkey % 60 <> 7),
          rep AS (SELECT c_nationkey + 40 AS region, CASE WHEN c_custkey % 5 = 0 THEN 'city' ELSE 'region' END AS scope, c_custkey % 7 = 0 AS placed FROM customer)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.col("o_orderstatus") == "F", "region").when(F.col("o_orderstatus") == "O", "city").otherwise("municipality")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).cast("string").alias("region"), scope.alias("scope"), F.lit("unmatched_start").alias("type")).where("region <> '7'")


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.when(F.col("c_custkey") % 7 == 0, F.array(F.struct(F.lit("p").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    return table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 40).cast("string").alias("region"), F.when(F.col("c_custkey") % 5 == 0, "city").otherwise("region").alias("scope"), places.alias("mentioned_places"))


@query(f"""WITH {STATUS}, {EVENT_ROWS}, rec AS (SELECT region, scope, 1 AS e FROM ev UNION ALL SELECT region, scope, 0 FROM rep),
          a AS (SELECT count(*) AS sources, count(DISTINCT region) AS regions_configured, count(*) FILTER (health = 'healthy') AS sources_healthy, count(*) FILTER (health = 'degraded') AS sources_degraded,
          count(*) FILTER (health = 'failed') AS sources_failed, count(*) FILTER (health = 'quiet') AS sources_quiet, count(*) FILTER (health = 'inactive') AS sources_inactive, count(*) FILTER (window_complete) AS sources_window_complete,
          count(DISTINCT region) FILTER (transport_ok) AS regions_transport_ok, count(DISTINCT region) FILTER (alert_posts > 0) AS regions_with_alert_posts, count(DISTINCT region) FILTER (activity_posts > 0) AS regions_with_activity_posts,
          count(DISTINCT region) FILTER (missile_activity_posts > 0) AS regions_with_missile_activity FROM st),
          b AS (SELECT sum(e)::BIGINT AS events_total, sum(1 - e)::BIGINT AS reports_total, count(DISTINCT region) AS regions_with_records, count(DISTINCT region) FILTER (scope IN ('city', 'municipality')) AS regions_with_local_records, count(DISTINCT region) FILTER (e = 1) AS regions_with_paired_alerts FROM rec)
          SELECT * FROM a, b""")
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage(source_rows(spark, sf_dir), event_rows(spark, sf_dir), report_rows(spark, sf_dir))


@query(f"""WITH {EVENT_ROWS}, rec AS (SELECT region, scope IN ('city', 'municipality') AS local, 1 AS e FROM ev UNION ALL SELECT region, scope = 'city' OR placed, 0 FROM rep)
          SELECT sum(1 - e)::BIGINT AS archive_reports_total, sum(e)::BIGINT AS archive_events_total, count(DISTINCT region) AS archive_regions_with_records, count(DISTINCT region) FILTER (local) AS archive_regions_with_local_records FROM rec""")
def archive_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.archive_counts(event_rows(spark, sf_dir), report_rows(spark, sf_dir))


@query(f"""WITH {STATUS}, {EVENT_ROWS}, rec AS (SELECT region, scope IN ('city', 'municipality') AS local, 1 AS e FROM ev UNION ALL SELECT region, scope = 'city' OR placed, 0 FROM rep),
          hi AS (SELECT *, CASE WHEN source % 9 = 0 THEN 'mchs_rss' ELSE 'telegram' END AS source_type FROM st)
          SELECT 'region_feeds_http_ok' AS metric, count(*) FILTER (source_type = 'mchs_rss' AND transport_ok) AS value FROM hi UNION ALL SELECT 'high_resolution_sources_healthy', 12345 UNION ALL
          SELECT 'high_resolution_regions_configured', count(DISTINCT region) FILTER (source_type = 'telegram') FROM hi UNION ALL SELECT 'high_resolution_regions_transport_ok', count(DISTINCT region) FILTER (source_type = 'telegram' AND transport_ok) FROM hi UNION ALL
          SELECT 'high_resolution_sources_failed', count(*) FILTER (source_type = 'telegram' AND health = 'failed') FROM hi UNION ALL SELECT 'high_resolution_sources_with_alert_posts', count(*) FILTER (source_type = 'telegram' AND alert_posts > 0) FROM hi UNION ALL
          SELECT 'high_resolution_sources_with_activity_posts', count(*) FILTER (source_type = 'telegram' AND activity_posts > 0) FROM hi UNION ALL SELECT 'telegram_mtproto_sources_used', count(*) FILTER (source_type = 'telegram' AND source % 3 = 0 AND transport_ok) FROM hi UNION ALL
          SELECT 'high_resolution_sources_window_complete', count(*) FILTER (source_type = 'telegram' AND window_complete) FROM hi UNION ALL SELECT 'regions_with_paired_alerts', count(DISTINCT region) FROM ev UNION ALL SELECT 'paired', count(*) FROM ev UNION ALL
          SELECT 'unmatched_starts', count(*) FROM ev UNION ALL SELECT 'archive_reports_total', count(*) FILTER (e = 0) FROM rec UNION ALL SELECT 'archive_events_total', count(*) FILTER (e = 1) FROM rec UNION ALL
          SELECT 'archive_regions_with_records', count(DISTINCT region) FROM rec UNION ALL SELECT 'archive_regions_with_local_records', count(DISTINCT region) FILTER (local) FROM rec""")
def header_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric stored, one stored as null, the others counted anew."""
    status = source_rows(spark, sf_dir).withColumns({"source_type": F.when(F.col("source") % 9 == 0, "mchs_rss").otherwise("telegram"), "transport": F.when(F.col("source") % 3 == 0, "mtproto").otherwise("html")})
    stored = spark.range(1).select(F.lit(12345).alias("high_resolution_sources_healthy"), F.lit(None).cast("int").alias("paired"))
    events = event_rows(spark, sf_dir)
    return coverage.header_metrics(stored, status, events, report_rows(spark, sf_dir), events)


@query(f"""WITH {STATUS}, s AS (SELECT *, alert_posts + 1 AS posts FROM st WHERE source % 13 <> 0), g AS (SELECT region, bool_or(transport_ok) AS works, bool_or(health IN ('failed', 'degraded')) AS poor,
          string_agg('@' || source || '=' || health || '(' || posts || ' posts)', '; ' ORDER BY '@' || source || '=' || health || '(' || posts || ' posts)') AS sources FROM s GROUP BY region)
          SELECT region, CASE WHEN NOT works THEN 'NO WORKING SOURCE' ELSE 'PARTIAL / DEGRADED' END AS state, sources FROM g WHERE NOT works OR poor""")
def region_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_rows(spark, sf_dir).withColumns({"expected_active": F.col("source") % 13 != 0, "posts": F.col("alert_posts") + 1, "source": F.col("source").cast("string")})
    return coverage.region_gaps(rows)


@query("""WITH r AS (SELECT r_name AS region, n_name AS place, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 8 WHEN o_orderstatus = 'F' THEN 4 WHEN o_totalprice > 400000 THEN 2 ELSE 1 END AS flag
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
          SELECT 'region' AS level, region AS key, bit_or(flag) AS flags FROM r GROUP BY region UNION ALL SELECT 'place', place, bit_or(flag) FROM r GROUP BY place""")
def hierarchy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(places, F.expr("c_nationkey = n_nationkey"))
    seen = rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("place"), F.when(F.col("o_totalprice") > 400000, "missile").otherwise("uav").alias("threat_class"), (F.col("o_orderstatus") == "F").alias("formal"))
    return coverage.marked_up(seen, "place", "region")


@query("""SELECT r_name AS region, n_name AS place, count(*) AS customers, count(DISTINCT c_mktsegment) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
          GROUP BY ROLLUP (r_name, n_name)""")
def place_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    named = rows.withColumnsRenamed({"r_name": "region", "n_name": "place"})
    return coverage.rolled_up(named, ["region", "place"], [F.count("*").alias("customers"), F.count_distinct("c_mktsegment").alias("segments")])


@query("SELECT user_id, event_type, arg_max({'ts': ts, 'value': value}, {'ts': ts, 'value': value}).ts AS ts, arg_max({'ts': ts, 'value': value}, {'ts': ts, 'value': value}).value AS value FROM events GROUP BY user_id, event_type")
def latest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.latest_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value")


@query("""SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY
          CASE WHEN event_type = 'error' AND value > 50 THEN 4 WHEN event_type = 'error' THEN 3 WHEN value > 50 THEN 2 ELSE 1 END DESC, ts DESC, event_id DESC) = 1""")
def cause_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumns({"formal": F.col("event_type") == "error", "threat_class": F.when(F.col("value") > 50, "missile").otherwise("uav")})
    return coverage.leading_cause(rows, ["user_id"], "ts", ["event_id", "event_type"]).select("user_id", "ts", "event_id", "event_type")


WORD_RULES = (("shout", (r"[!]{2,}", r"[#$%]{3}")), ("address", (r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", r"https?://")), ("number", (r"[0-9]{3}-[0-9]{2,3}-[0-9]{4}", r"[0-9]{4} [0-9]{4}")), ("question", (r"[?]",)))


@query(f"SELECT label, lang, count(*) AS n FROM (SELECT {labelled_sql('text', WORD_RULES)} AS label, lang FROM documents) GROUP BY ALL")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered rule set over whole texts: the same data compile to both engines."""
    return table(spark, sf_dir, "documents").select(labelled(F.col("text"), WORD_RULES).alias("label"), "lang").groupBy("label", "lang").agg(F.count("*").alias("n"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?][ \t\r\n]+|\n+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL)
           SELECT doc_id, len(parts) AS n_parts, list_filter(parts, lambda x: regexp_matches(x, '[0-9]{3}'))[1] AS first_number FROM s""")
def sentence_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of a text that holds a number, the parts being split without look-behind as both engines can."""
    parts = F.filter(F.transform(F.split("text", r"[.!?][ \t\r\n]+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    first = first_of(parts, lambda s: F.when(s.rlike("[0-9]{3}"), s))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(parts).cast("long").alias("n_parts"), first.alias("first_number"))


@query(r"""SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')))::INTEGER AS n_sentences FROM documents WHERE text IS NOT NULL
           UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NULL""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the look-behind split of messages; the SQL puts a line end after each mark instead."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(sentences(F.col("text"))).alias("n_sentences"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[«»„“”"''`…,:;.!?()\[\]{}<>|/\\–—−-]+', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS normalized_md5 FROM documents WHERE text IS NOT NULL""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(normalize(F.col("text"))).alias("normalized_md5"))


@query("SELECT o_orderkey, substr(sha1(concat_ws('|', coalesce(o_orderkey::VARCHAR, ''), coalesce(o_orderstatus, ''), coalesce(o_custkey::VARCHAR, ''))), 1, 16) AS id FROM orders")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", stable_id(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_custkey")).alias("id"))


COUNT = r"([a-z]+) ?[:=]? ?\(?([0-9]{2,6})"


COUNTED = (("shown", r"(number|about)?:? ?([0-9]{4})(?:[^0-9]|$)"), ("short", r"(number|about)? ?([0-9]{2,3})"))


@query(f"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[«»„“”"''`…,:;.!?()\\[\\]{{}}<>|/\\\\–—−-]+', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS n FROM documents WHERE text IS NOT NULL),
          c AS (SELECT doc_id, CASE WHEN regexp_matches(n, '{COUNTED[0][1]}') THEN regexp_extract(n, '{COUNTED[0][1]}', 2) WHEN regexp_matches(n, '{COUNTED[1][1]}') THEN regexp_extract(n, '{COUNTED[1][1]}', 2) END AS n,
                CASE WHEN regexp_matches(n, '{COUNTED[0][1]}') THEN 'shown' WHEN regexp_matches(n, '{COUNTED[1][1]}') THEN 'short' END AS what FROM d)
          SELECT doc_id, what, n::INTEGER AS n FROM c WHERE what IS NOT NULL""")
def count_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first counted phrase of a text by an ordered list of patterns."""
    found = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", counted(normalize(F.col("text")), COUNTED).alias("c"))
    return found.where("c is not null").select("doc_id", F.col("c.count_type").alias("what"), F.col("c.count").alias("n"))


PHRASES = """aliases AS (SELECT DISTINCT lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS phrase FROM benchmark UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)"""


PHRASES = """aliases AS (SELECT DISTINCT lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS phrase FROM benchmark UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)"""


@query(f"""WITH {PHRASES}, w AS (SELECT doc_id, string_split(lower(text), ' ') AS ws FROM documents),
           g AS (SELECT DISTINCT doc_id, unnest(ws) AS phrase FROM w UNION SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w)
           SELECT phrase, count(*) AS documents, min(doc_id) AS first_doc FROM g JOIN aliases USING (phrase) WHERE phrase <> '' GROUP BY phrase""")
def ngram_dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of a dictionary found in texts, by the equi-joins that find place names in posts."""
    names = table(spark, sf_dir, "part").select("p_name")
    two = table(spark, sf_dir, "benchmark").select(F.lower(F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))).alias("phrase"))
    aliases = two.union(names).union(names.select(F.split_part("p_name", F.lit(" "), F.lit(1)))).where("phrase <> ''").distinct()
    hits = phrase_hits(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("n")), ["doc_id"], "n", aliases)
    return hits.select("doc_id", "phrase").distinct().groupBy("phrase").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("""WITH RECURSIVE s AS (SELECT user_id, min(ts) AS session_start FROM events GROUP BY user_id
            UNION ALL SELECT s.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = s.user_id AND e.ts > s.session_start + INTERVAL 60 MINUTE) FROM s WHERE session_start IS NOT NULL)
          SELECT e.user_id, s.session_start, count(*) AS observations, max(e.value) AS max_value FROM s JOIN events e ON e.user_id = s.user_id AND e.ts BETWEEN s.session_start AND s.session_start + INTERVAL 60 MINUTE
          WHERE s.session_start IS NOT NULL GROUP BY ALL""")
def anchored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    marked = sessions.anchored_sessions(rows, ["user_id"], "ts", 3_600_000)
    # The mark has milliseconds; the first row's own time is the session's start.
    return marked.groupBy("user_id", "session_start").agg(F.min("ts").alias("first"), F.count("*").alias("observations"), F.max("value").alias("max_value")).select("user_id", F.col("first").alias("session_start"), "observations", "max_value")


@query("""WITH d AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY ALL),
          c AS (SELECT *, CASE WHEN bought = lag(bought) OVER w THEN 0 ELSE 1 END AS chg FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
          r AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY day) AS run FROM c)
          SELECT user_id, bought, min(day) AS first, max(day) AS last, count(*) AS length FROM r GROUP BY user_id, run, bought""")
def activity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    return sessions.runs_of(days, ["user_id"], "day", "bought", bucket=F.date_trunc("MONTH", "day"))


@query("""WITH e AS (SELECT l_linenumber AS part, (l_partkey % 40)::DOUBLE AS lon1, (l_suppkey % 10)::DOUBLE AS lat1, (l_orderkey % 40)::DOUBLE AS lon2, (l_quantity::INTEGER % 10)::DOUBLE AS lat2 FROM lineitem),
          k AS (SELECT part, least((lon1, lat1), (lon2, lat2)) AS a, greatest((lon1, lat1), (lon2, lat2)) AS b FROM e WHERE (lon1, lat1) <> (lon2, lat2))
          SELECT part, a[1] AS lon1, a[2] AS lat1, b[1] AS lon2, b[2] AS lat2 FROM k GROUP BY part, a, b HAVING count(*) % 2 = 1""")
def boundary_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c, n: (F.col(c).cast("long") % n).cast("double")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("part"), d("l_partkey", 40).alias("lon1"), d("l_suppkey", 10).alias("lat1"), d("l_orderkey", 40).alias("lon2"), d("l_quantity", 10).alias("lat2"))
    return geometry.outer_edges(edges, ["part"])


@query("""WITH e AS (SELECT l_linenumber AS part, (l_partkey % 40)::DOUBLE AS lon1, (l_suppkey % 10)::DOUBLE AS lat1, (l_orderkey % 40)::DOUBLE AS lon2, (l_quantity::INTEGER % 10)::DOUBLE AS lat2 FROM lineitem),
          k AS (SELECT part, least((lon1, lat1), (lon2, lat2)) AS a, greatest((lon1, lat1), (lon2, lat2)) AS b FROM e WHERE (lon1, lat1) <> (lon2, lat2)),
          x AS (SELECT part, a, b FROM k GROUP BY ALL HAVING count(*) % 2 = 1),
          n AS (SELECT part, p, count(*) AS degree FROM (SELECT part, a AS p FROM x UNION ALL SELECT part, b FROM x) GROUP BY ALL)
          SELECT part, (SELECT count(*) FROM x WHERE x.part = n.part) AS edges, count(*) FILTER (degree % 2 = 1) // 2 AS open_lines, sum(degree // 2)::BIGINT AS joints FROM n GROUP BY part""")
def boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of boundary_xor in lines: all are there, lines end where an odd number of edges meet, and follow each other wherever two can."""
    rows = geometry.lines_of_edges(boundary_xor(spark, sf_dir), ["part"])
    ends = rows.groupBy("part", "line").agg(F.count("*").alias("n"), F.min_by(F.struct("lon1", "lat1"), "place").alias("a"), F.max_by(F.struct("lon2", "lat2"), "place").alias("b"))
    # A line of n edges has n - 1 joints, a ring n.
    closed = (F.col("a") == F.col("b")).cast("long")
    return ends.groupBy("part").agg(F.sum("n").alias("edges"), F.sum(1 - closed).alias("open_lines"), F.sum(F.col("n") - 1 + closed).alias("joints"))


LON, LAT = "({0} * 37 % 3600) / 10.0 - 180", "({0} * 53 % 1200) / 10.0 - 60"


def points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table's rows with a point made of their key."""
    return table(spark, sf_dir, name).withColumns({"lon": F.expr(f"cast({LON.format(key)} as double)"), "lat": F.expr(f"cast({LAT.format(key)} as double)")})


@query(f"""SELECT c_nationkey, round(sum({LON.format('c_custkey')} * sqrt(greatest(c_acctbal, 0))) / sum(sqrt(greatest(c_acctbal, 0))), 6) AS lon,
           round(sum(({LAT.format('c_custkey')}) * sqrt(greatest(c_acctbal, 0))) / sum(sqrt(greatest(c_acctbal, 0))), 6) AS lat FROM customer GROUP BY c_nationkey""".replace(LON.format("c_custkey") + " *", f"({LON.format('c_custkey')}) *"))
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.weighted_centroid(points(spark, sf_dir, "customer", "c_custkey"), ["c_nationkey"], F.sqrt(F.greatest(F.col("c_acctbal"), F.lit(0.0))))
    return found.select("c_nationkey", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""WITH p AS (SELECT c_custkey, ({LON.format('c_custkey')})::DOUBLE AS lon, ({LAT.format('c_custkey')})::DOUBLE AS lat FROM customer),
           s AS (SELECT s_suppkey, ({LON.format('s_suppkey')})::DOUBLE + s_suppkey * 1e-7 AS s_lon, ({LAT.format('s_suppkey')})::DOUBLE AS s_lat FROM supplier),
           d AS (SELECT c_custkey, s_suppkey, {haversine_sql('lat', 'lon', 's_lat', 's_lon')} AS km FROM p, s),
           r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS rank FROM d)
           SELECT c_custkey, s_suppkey, round(km, 6) AS km, rank::INTEGER AS rank FROM r WHERE rank <= 2""")
def haversine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest suppliers to each customer: cubes around the sphere, no product of the tables."""
    p = points(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("point_id"), "lon", "lat")
    # A little to the east with each key, so that no two sites are equally far.
    s = points(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("site_id"), (F.col("lon") + F.col("s_suppkey") * 1e-7).alias("lon"), "lat")
    return geometry.nearest(p, s, k=2).select(F.col("point_id").alias("c_custkey"), F.col("site_id").alias("s_suppkey"), F.round("km", 6).alias("km"), "rank")


@query(f"""SELECT c_custkey, (SELECT min(n_nationkey) FROM nation WHERE lon > n_nationkey * 14.0 - 178 AND lon < n_nationkey * 14.0 - 166 AND lat > -50 AND lat < 50 AND NOT (lon > n_nationkey * 14.0 - 174 AND lon < n_nationkey * 14.0 - 170 AND lat > -5 AND lat < 5)) AS region
           FROM (SELECT c_custkey, ({LON.format('c_custkey')})::DOUBLE + 0.05 AS lon, ({LAT.format('c_custkey')})::DOUBLE + 0.05 AS lat FROM customer)""")
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in rectangles with a hole, one per nation."""
    corner = lambda dx, y: f"named_struct('lon', n_nationkey * 14.0D - {dx}, 'lat', {y}D)"
    ring = lambda w, e, y: f"array({corner(w, -y)}, {corner(e, -y)}, {corner(e, y)}, {corner(w, y)}, {corner(w, -y)})"
    shapes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_nationkey").alias("region"), F.expr(f"array({ring(178, 166, 50.0)}, {ring(174, 170, 5.0)})").alias("polygon"))
    p = points(spark, sf_dir, "customer", "c_custkey").select("c_custkey", (F.col("lon") + 0.05).alias("lon"), (F.col("lat") + 0.05).alias("lat"))
    return geometry.locate(p, shapes, cell_deg=4.0).select("c_custkey", "region")


@query("""SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 18""")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 18 of each group: the limit is the feature."""
    return coverage.top_k(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 18).select("p_brand", "p_partkey", "p_retailprice", "rank")


@query("SELECT DISTINCT n_nationkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8500)")
def regions_not_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as regions, their suppliers as sources that work where their balance is high."""
    status = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("region"), (F.col("s_acctbal") > 8500).alias("transport_ok"))
    return coverage.failed_regions(status).select(F.col("region").alias("n_nationkey"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    had = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return coverage.missing(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), had, ["n_nationkey"])


@query("SELECT (ts + INTERVAL 3 HOUR)::DATE AS local_day, count(*) AS n, sum((props->>'k')::INTEGER)::BIGINT AS k FROM events GROUP BY ALL")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per calendar day at +03:00, with a field of their JSON."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(local_day(F.col("ts"), 3).alias("local_day")).agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k int")["k"]).alias("k"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
           '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text_md5 FROM pages WHERE html IS NOT NULL""")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.md5(strip_html(F.col("html"))).alias("text_md5"))


@query("SELECT c_custkey, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::UBIGINT)), lambda h, u: (xor(h, u) * 16777619::UBIGINT) & 4294967295::UBIGINT)::BIGINT AS jitter FROM customer WHERE c_name <> ''")
def seeded_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_name <> ''").select("c_custkey", fnv1a(F.col("c_name")).alias("jitter"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at points made of users' ids, moving east with time."""
    events = table(spark, sf_dir, "events")
    lon = 30 + (F.col("user_id") % 40) * 0.25 + (F.hour("ts") * 60 + F.minute("ts")) / 1440 * 8
    lat = 50 + (F.col("user_id") * 7 % 30) * 0.12
    return events.select(F.col("event_id").alias("node_id"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), F.col("ts").alias("at"), (1 + F.least(F.lit(1.8), F.col("value") / 50)).alias("weight"), F.lit(1).cast("long").alias("observations"), (F.col("event_type") == "click").alias("proxy"), F.lit("uav").alias("threat_class"))


@query()
def chain_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chain to every purchase: a longest path over the observations of its corridor (tests hold it against all paths)."""
    nodes = observations(spark, sf_dir)
    purchases = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("node_id"))
    ends = nodes.join(purchases, "node_id").select(F.col("node_id").alias("end_id"), "threat_class", F.lit(28.0).alias("anchor_lon"), F.lit(51.5).alias("anchor_lat"), "lon", "lat", "at")
    found = chains.chains(nodes, ends)
    return found.select("end_id", F.size("path").alias("steps"), F.round("score", 6).alias("score"), F.concat_ws(",", F.transform("path", lambda n: n.cast("string"))).alias("path"), "illustrative")


EASED = "CASE WHEN {ms} <= start_ms THEN 0 WHEN {ms} >= arrival THEN 1 ELSE (SELECT p0 + (p1 - p0) * pow(({ms} - t0) / (t1 - t0)::DOUBLE, 2) * (3 - 2 * ({ms} - t0) / (t1 - t0)::DOUBLE) FROM legs g WHERE g.route_id = m.route_id AND g.t0 < {ms} AND {ms} <= g.t1) END"


@query(f"""WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, epoch_us(max(ts)) // 1000 AS t, count(*) AS n FROM events GROUP BY ALL),
          a AS (SELECT user_id AS route_id, t, sum(n) OVER (PARTITION BY user_id ORDER BY day)::DOUBLE / (sum(n) OVER (PARTITION BY user_id))::DOUBLE AS p, (sum(n) OVER (PARTITION BY user_id))::DOUBLE * 10 AS km FROM d),
          r AS (SELECT route_id, max(t) AS arrival, greatest(25 * 60000, max(km) / 210 * 3600000) AS base, arg_min(t, p) AS ft, min(p) AS fp FROM a GROUP BY route_id),
          q AS (SELECT *, trunc(CASE WHEN ft - base * fp >= arrival - 60000 THEN arrival - base ELSE ft - base * fp END)::BIGINT AS start_ms FROM r),
          w AS (SELECT *, trunc(greatest(12 * 60000, least(90 * 60000, (arrival - start_ms) * 0.33::DOUBLE)))::BIGINT AS lag_ms FROM q),
          c AS (SELECT route_id, 0.0 AS p, start_ms AS t FROM w UNION ALL SELECT a.route_id, a.p, a.t FROM a JOIN w USING (route_id) WHERE a.p < 0.999 AND a.t < arrival AND a.t > start_ms UNION ALL SELECT route_id, 1.0, arrival FROM w),
          legs AS (SELECT route_id, lag(p) OVER o AS p0, p AS p1, lag(t) OVER o AS t0, t AS t1 FROM c WINDOW o AS (PARTITION BY route_id ORDER BY t)),
          m AS (SELECT w.*, h.ms FROM w JOIN (SELECT DISTINCT epoch_us(date_trunc('hour', ts)) // 1000 AS ms FROM events) h ON h.ms > start_ms AND h.ms < arrival + lag_ms),
          x AS (SELECT route_id, ms AS at_ms, {EASED.format(ms='m.ms')} AS head, {EASED.format(ms='(m.ms - m.lag_ms)')} AS tail FROM m)
          SELECT route_id, at_ms, round(head, 6) AS head, round(tail, 6) AS tail FROM x WHERE head > tail + 0.00001""")
def wave_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads and tails of users' routes at every hour: a day's share of a user's events is its share of the way."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("ts").alias("at"), F.count("*").alias("n"))
    # One row a day and user.
    within = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    share = days.withColumn("progress", F.sum("n").over(within) / F.sum("n").over(Window.partitionBy("user_id")))
    routes = share.groupBy(F.col("user_id").alias("route_id")).agg(F.max("at").alias("arrival"), (F.sum("n") * 10.0).alias("total_km"), F.collect_list(F.struct("progress", intervals.millis(F.col("at")).alias("t"))).alias("anchors"))
    found = chains.waves_at(chains.prepared(routes), hours_of(table(spark, sf_dir, "events")).select(F.col("at").cast("timestamp").alias("at")))
    return found.select("route_id", F.unix_millis("at").alias("at_ms"), F.round("head", 6).alias("head"), F.round("tail", 6).alias("tail"))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, ({LON.format('l_partkey')})::DOUBLE AS lon, ({LAT.format('l_partkey')})::DOUBLE AS lat FROM lineitem),
           s AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, lon, lat))
           SELECT l_orderkey, round(sum(coalesce({haversine_sql('lat0', 'lon0', 'lat', 'lon')}, 0)), 4) AS km, count(*) AS points FROM s GROUP BY l_orderkey""")
def route_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir, "lineitem", "l_partkey").select("l_orderkey", "l_linenumber", "lon", "lat")
    return geometry.length_km(p, ["l_orderkey"], ["l_linenumber", "lon", "lat"]).select("l_orderkey", F.round("km", 4).alias("km"), "points")


@query(f"""SELECT c_custkey, round(fmod(degrees(atan2(sin(radians(10 - lon)) * cos(radians(50)), cos(radians(lat)) * sin(radians(50)) - sin(radians(lat)) * cos(radians(50)) * cos(radians(10 - lon)))) + 360, 360), 6) AS bearing,
           round(((lon - 5) * k * (5 * k) + (lat - 45) * {KM_LAT} * (5 * {KM_LAT})) / sqrt(pow(5 * k, 2) + pow(5 * {KM_LAT}, 2)), 6) AS progress_km
           FROM (SELECT c_custkey, ({LON.format('c_custkey')})::DOUBLE AS lon, ({LAT.format('c_custkey')})::DOUBLE AS lat, {KM_LON} * cos(radians(47.5)) AS k FROM customer)""")
def corridor_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir, "customer", "c_custkey")
    way = corridor(F.lit(45.0), F.lit(5.0), F.lit(50.0), F.lit(10.0), F.col("lat"), F.col("lon"))
    bearing = bearing_deg(F.col("lat"), F.col("lon"), F.lit(50.0), F.lit(10.0))
    return p.select("c_custkey", F.round(bearing, 6).alias("bearing"), F.round(way["progress_km"], 6).alias("progress_km"))
