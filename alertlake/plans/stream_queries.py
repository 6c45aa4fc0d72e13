"""Queries that run as streams, or through the library's own sources and sinks.

Rows land in parts, one after another, and every part is a run of its own that goes on from the
checkpoint of the one before: what a run leaves behind must make up for nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.operators import intervals, pairing
from alertlake.operators.stage import shared_root
from alertlake.plans.message_queries import JOB_EVENTS, JOB_REPORTS, feed_of, ntz, of_suppliers, places, sources_of
from alertlake.plans.queries import KEPT, tokens, user_intervals
from alertlake.plans.registry import query, table
from alertlake.plans.stream import Stores, collect_stream
from alertlake.sources import landed, upsert
from alertlake.streaming.joins import streams_near_in_time
from alertlake.streaming.pairing import TOKEN, pair_stream, with_rocksdb

CUTS = ("2024-01-11", "2024-01-21")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def in_parts(rows: DataFrame, at: str) -> list[DataFrame]:
    """Rows of the time before the first cut, of that between the two, and of that after."""
    low, high = (F.lit(c).cast("timestamp") for c in CUTS)
    return [rows.where(F.col(at) < low), rows.where((F.col(at) >= low) & (F.col(at) < high)), rows.where(F.col(at) >= high)]


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, cursor, html): documents as posts, twenty a page, one channel a source."""
    key = F.col("doc_id")
    words = F.trim(F.regexp_replace(F.translate("text", "<>&", "   "), r"[ \t\n\r\x0B\f]+", " "))
    at = F.date_format(F.timestamp_seconds(F.lit(1790000000) + key * 60), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    wrap = F.concat(F.lit('<div class="tgme_widget_message" data-post="'), "source", F.lit("/"), key.cast("string"), F.lit('"><div class="tgme_widget_message_text">'), words, F.lit('</div><time datetime="'), at, F.lit('"></time></div>'))
    d = table(spark, sf_dir, "documents").select("source", "doc_id", wrap.alias("wrap"))
    pages = d.groupBy(F.col("source").alias("channel"), F.floor(key / 20)).agg(F.max("doc_id").alias("cursor"), F.concat_ws("\n", F.array_sort(F.collect_list("wrap"))).alias("html"))
    return pages.select("channel", "cursor", "html")


LANDED = """SELECT source AS channel, doc_id, TIMESTAMP '2026-09-21 14:13:20' + INTERVAL (doc_id) MINUTE AS published_at, trim(regexp_replace(translate(text, '<>&', '   '), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')) AS text, max(doc_id) OVER (PARTITION BY source, doc_id // 20) AS "cursor" FROM documents"""


def as_documents(found: DataFrame) -> DataFrame:
    return found.select("channel", F.col("post_id").cast("long").alias("doc_id"), *ntz("published_at"), "text", "cursor")


@query(LANDED)
def posts_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written through the sink and read back by ranges of cursors."""
    landed.register(spark)
    root = fresh(spark, "pages")
    landed_pages(spark, sf_dir).write.format(landed.FORMAT).mode("append").save(root)
    return as_documents(spark.read.format(landed.FORMAT).option("pages_per_partition", "20").load(root))


@query(LANDED)
def posts_landed_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: two runs, the second for pages that landed after the first."""
    landed.register(spark)
    root, out, checkpoint = fresh(spark, "pages"), fresh(spark, "posts"), fresh(spark, "checkpoint")
    pages = landed_pages(spark, sf_dir)
    half = pages.agg(F.percentile_approx("cursor", 0.5)).first()[0] or 0
    for part in (pages.where(F.col("cursor") <= half), pages.where(F.col("cursor") > half)):
        part.write.format(landed.FORMAT).mode("append").save(root)
        stream = spark.readStream.format(landed.FORMAT).load(root)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return as_documents(spark.read.parquet(out))


def in_runs(parts: list[DataFrame], folder: str, schema: str, run: Callable[[DataFrame], None]) -> None:
    """Each part is written to the folder, then a run over the folder's stream is made."""
    for part in parts:
        part.write.mode("append").parquet(folder)
        run(part.sparkSession.readStream.schema(schema).parquet(folder))


@query(f"WITH {KEPT} SELECT * FROM iv")
def pairs_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_intervals as a stream with state, stopped and started again twice."""
    with_rocksdb(spark)
    rows = tokens(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), F.lit("uav").alias("threat"), "kind", F.col("ts").cast("timestamp").alias("published_at"), F.format_string("%012d", "event_id").alias("post_id"), F.lit(2).alias("sub"), F.lit("here").alias("place"), F.lit("exact_local").alias("tag"))
    folder, out, checkpoint = fresh(spark, "tokens"), fresh(spark, "pairs"), fresh(spark, "checkpoint")

    def run(stream: DataFrame) -> None:
        pair_stream(stream, longest_hours=24 * 365).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    in_runs(in_parts(rows, "published_at"), folder, TOKEN, run)
    return spark.read.parquet(out).select(F.col("source").cast("long").alias("user_id"), *ntz("start", "end"), F.col("start_post_id").cast("long").alias("start_id"), F.col("end_post_id").cast("long").alias("end_id"))


@query("""SELECT user_id, event_type, arg_max(event_id, (quality, ts, event_id)) AS event_id, max(quality) AS quality FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 30 ELSE 10 END AS quality FROM events) GROUP BY ALL""")
def archive_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events merged into an archive by user and type, in three runs; of each key the best version, of those the newest."""
    folder, root, checkpoint = fresh(spark, "rows"), fresh(spark, "archive"), fresh(spark, "checkpoint")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 3 == 0, 30).otherwise(10).alias("quality"))
    schema = "user_id long, event_type string, event_id long, ts timestamp, quality int"
    in_runs(in_parts(rows, "ts"), folder, schema, lambda stream: upsert.upsert_stream(stream, root, ["user_id", "event_type"], ["quality", "ts", "event_id"], checkpoint, buckets=16).awaitTermination())
    return upsert.read_upserted(spark, root).select("user_id", "event_type", "event_id", "quality")


@query("""SELECT a.event_id, count(*) AS near, min(b.event_id) AS first_id FROM events a JOIN events b
          ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 45 MINUTE AND a.ts + INTERVAL 45 MINUTE
          WHERE a.event_type = 'purchase' AND b.event_type = 'click' GROUP BY a.event_id""")
def streams_within_45m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reports_within_45m as a join of two streams, in three runs."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    right = events.where("event_type = 'click'").select(F.col("event_id").alias("other_id"), "user_id", F.col("ts").alias("other_at"))
    a, b, out, checkpoint = fresh(spark, "left"), fresh(spark, "right"), fresh(spark, "met"), fresh(spark, "checkpoint")
    for one, other in zip(in_parts(left, "at"), in_parts(right, "other_at"), strict=True):
        one.write.mode("append").parquet(a)
        other.write.mode("append").parquet(b)
        met = streams_near_in_time(spark.readStream.schema(left.schema).parquet(a), spark.readStream.schema(right.schema).parquet(b), 45 * 60_000, on=["user_id"])
        met.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_id").agg(F.count("*").alias("near"), F.min("other_id").alias("first_id"))


def stream_job(spark: SparkSession, sf_dir: str) -> Stores:
    """The suppliers' feeds (see job()) through the stream job, in two runs."""
    stores, folder = Stores(fresh(spark, "stream-job")), fresh(spark, "feed")
    feed, sources = feed_of(spark, sf_dir), sources_of(spark, sf_dir)
    half = F.lit(feed.agg(F.percentile_approx(F.unix_seconds("published_at"), 0.5)).first()[0])  # amid a supplier's posts
    for part in (feed.where(F.unix_seconds("published_at") <= half), feed.where(F.unix_seconds("published_at") > half)):
        part.write.mode("append").parquet(folder)
        collect_stream(spark.readStream.schema(feed.schema).parquet(folder), sources, places(spark), stores)
    return stores


@query(of_suppliers("s VARCHAR, region VARCHAR, place VARCHAR, a TIMESTAMP, b TIMESTAMP, scope VARCHAR, precision VARCHAR, end_match VARCHAR", JOB_EVENTS, "s || '-' || s_suppkey AS source, region, place, a + INTERVAL (s_suppkey) DAY AS start, b + INTERVAL (s_suppkey) DAY AS \"end\", scope, precision, end_match"))
def stream_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of job_events, paired and archived by streams."""
    return upsert.read_upserted(spark, stream_job(spark, sf_dir).events).select("source", "region", "place", *ntz("start", "end"), "scope", "precision", "end_match")


@query(of_suppliers("s VARCHAR, a TIMESTAMP, place VARCHAR, count INTEGER, activity_kind VARCHAR", JOB_REPORTS, "s || '-' || s_suppkey AS source, a + INTERVAL (s_suppkey) DAY AS \"at\", place, count, activity_kind"))
def stream_job_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.read_upserted(spark, stream_job(spark, sf_dir).reports).select("source", *ntz("at"), "place", "count", "activity_kind")


@query(f"""WITH {KEPT}, p AS (SELECT * FROM iv WHERE user_id % 2 = 0), q AS (SELECT * FROM iv WHERE user_id % 2 = 1)
          SELECT p.start_id, count(*) AS met, min(q.start_id) AS first_id, max(q."end") AS latest FROM p JOIN q ON p.start <= q."end" AND q.start <= p."end" GROUP BY p.start_id""")
def intervals_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of users with an even id and of those with an odd one that share an instant."""
    all_ = user_intervals(spark, sf_dir)
    own = all_.where("user_id % 2 = 0").select("start_id", "start", "end")
    other = all_.where("user_id % 2 = 1").select(F.col("start_id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return intervals.overlap_pairs(own, other).groupBy("start_id").agg(F.count("*").alias("met"), F.min("other_id").alias("first_id"), F.max("other_end").alias("latest"))


CLEARED = """e AS (SELECT user_id % 7 AS source, user_id AS place, event_id, ts, CASE WHEN event_type = 'click' THEN 'start' WHEN event_type = 'error' THEN 'end' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'clear' END AS kind FROM events),
          t AS (SELECT source, place, event_id, ts, kind FROM e WHERE kind IN ('start', 'end') UNION ALL SELECT c.source, p.place, c.event_id, c.ts, 'end' FROM e c JOIN (SELECT DISTINCT source, place FROM e WHERE kind = 'start') p USING (source) WHERE c.kind = 'clear'),
          k AS (SELECT *, lag(kind) OVER w AS before FROM t WINDOW w AS (PARTITION BY place ORDER BY ts, event_id)),
          f AS (SELECT *, lead(event_id) OVER w AS closed_by, lead(ts) OVER w AS closed_at FROM k WHERE (kind = 'start' AND coalesce(before = 'end', true)) OR (kind = 'end' AND before = 'start') WINDOW w AS (PARTITION BY place ORDER BY ts, event_id))"""


def cleared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tokens: seven sources with a place for each user, opened and closed by it; a signup in five clears all places of its source."""
    kind = F.when(F.col("event_type") == "click", "start").when((F.col("event_type") == "error") | ((F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0)), "end")
    wide = F.col("event_type") == "signup"
    said = lambda c: F.lit(c).alias(c)
    rows = table(spark, sf_dir, "events").withColumn("kind", kind).where("kind is not null")
    return rows.select((F.col("user_id") % 7).cast("string").alias("source"), F.lit("uav").alias("threat"), "kind", F.when(wide, pairing.EVERY_PLACE).otherwise(F.col("user_id").cast("string")).alias("place"), F.col("ts").cast("timestamp").alias("published_at"), F.format_string("%012d", "event_id").alias("order_id"), F.col("event_id").cast("string").alias("post_id"), F.when(wide, 1).otherwise(2).alias("sub"), F.when(wide, "all_local_clear").otherwise("direct").alias("tag"), said("text"), said("url"), said("region"), said("channel"))


def told(found: DataFrame, own: Column, closed: Column) -> DataFrame:
    return found.select(F.col("place").cast("long").alias("place"), own.cast("long").alias("event_id"), closed.cast("long").alias("closed_by"))


@query(f"WITH {CLEARED} SELECT place, event_id, closed_by FROM f WHERE kind = 'start'")
def alerts_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and what closed them: an end of their own place, or a clear of all places of their source."""
    found = pairing.opened_and_closed(cleared_tokens(spark, sf_dir))
    return told(found, F.col("opened.post_id"), F.col("closed.post_id"))


@query(f"WITH {CLEARED} SELECT place, event_id, closed_by FROM f WHERE kind = 'start' AND closed_by IS NOT NULL")
def alerts_cleared_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with state, in three runs: what is closed."""
    with_rocksdb(spark)
    rows = cleared_tokens(spark, sf_dir).select("source", "threat", "kind", "published_at", F.col("order_id").alias("post_id"), "sub", "place", "tag")
    folder, out, checkpoint = fresh(spark, "tokens"), fresh(spark, "cleared"), fresh(spark, "checkpoint")

    def run(stream: DataFrame) -> None:
        pair_stream(stream, longest_hours=24 * 365).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    in_runs(in_parts(rows, "published_at"), folder, TOKEN, run)
    return told(spark.read.parquet(out), F.col("start_post_id"), F.col("end_post_id"))
