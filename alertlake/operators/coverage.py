"""Counts of what a run collected: per post, per source, per region, and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.functions.rules import THREATS, found, judged
from alertlake.functions.text import normalize


def flagged(posts: DataFrame) -> DataFrame:
    """posts with uav_/missile_ formal, kind and reference columns."""
    columns, posts = {}, judged(posts)
    of = lambda c, t: F.get(F.filter(c, lambda s: s["threat"] == t.name), 0)["kind"]
    for t in THREATS:
        columns |= {f"{t.name}_formal": of("formal", t), f"{t.name}_kind": of("activity", t), f"{t.name}_reference": F.coalesce(found(normalize(F.col("text")), t.about), F.lit(False))}
    return posts.withColumns(columns)


def post_counts(flags: DataFrame, by: list[str]) -> DataFrame:
    """The eleven counts of a source's flagged posts."""
    is_ = lambda c, v: F.col(c).eqNullSafe(F.lit(v))
    start, end = is_("uav_formal", "start") | is_("missile_formal", "start"), is_("uav_formal", "end") | is_("missile_formal", "end")
    uav, missile = F.col("uav_kind").isNotNull(), F.col("missile_kind").isNotNull()
    counts = {
        "start_posts": start, "end_posts": end, "activity_posts": uav | missile, "uav_activity_posts": uav, "missile_activity_posts": missile,
        "uav_reference_posts": F.col("uav_reference"), "missile_reference_posts": F.col("missile_reference"),
        "missile_start_posts": is_("missile_formal", "start"), "missile_end_posts": is_("missile_formal", "end"),
    }
    out = flags.groupBy(*by).agg(F.count("*").alias("posts"), F.min("published_at").alias("oldest_post"), F.max("published_at").alias("newest_post"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    told = F.col("uav_reference_posts") + F.col("missile_reference_posts") - F.col("uav_activity_posts") - F.col("missile_activity_posts")
    return out.withColumns({"alert_posts": F.col("start_posts") + F.col("end_posts"), "unclassified_reference_posts": F.greatest(F.lit(0), told)})


def health_of() -> Column:
    """From expected_active, transport, transport_ok, window_complete and fetched_posts."""
    none = F.coalesce("fetched_posts", F.lit(0)) == 0
    return (
        F.when(~F.col("expected_active") & none, "inactive")
        .when((F.col("transport") == "mtproto") & F.col("transport_ok") & F.col("window_complete") & none, "quiet")
        .when(~F.col("transport_ok"), "failed")
        .when(F.col("window_complete"), "healthy")
        .otherwise("degraded")
    )


def source_status(fetched: DataFrame, counts: DataFrame, key: str = "source") -> DataFrame:
    """One row per fetch: its health, and the counts of its posts (0 without any)."""
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c, kind in counts.dtypes if kind in ("bigint", "int") and c != key}
    rows = fetched.withColumn("health", health_of()).join(counts, key, "left").withColumns(zeros)
    return rows.withColumn("ok", F.col("health").isin("healthy", "degraded", "quiet"))


def coverage(status: DataFrame, events: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of totals; all distinct counts are over regions and sources."""
    regions = lambda c: F.count_distinct(F.when(c, F.col("region")))
    of = status.agg(
        F.count("*").alias("sources"), F.count_distinct("region").alias("regions_configured"),
        *(F.count_if(F.col("health") == h).alias(f"sources_{h}") for h in ("healthy", "degraded", "failed", "quiet", "inactive")),
        F.count_if("window_complete").alias("sources_window_complete"), regions(F.col("transport_ok")).alias("regions_transport_ok"),
        regions(F.col("alert_posts") > 0).alias("regions_with_alert_posts"), regions(F.col("activity_posts") > 0).alias("regions_with_activity_posts"),
        regions(F.col("missile_activity_posts") > 0).alias("regions_with_missile_activity"),
    )
    local = F.col("scope").isin("city", "municipality", "local")
    records = events.select("region", "scope", F.lit(1).alias("e")).unionByName(reports.select("region", "scope", F.lit(0).alias("e")))
    totals = records.agg(F.sum("e").alias("events_total"), F.sum(1 - F.col("e")).alias("reports_total"), F.count_distinct("region").alias("regions_with_records"), regions(local).alias("regions_with_local_records"), regions(F.col("e") == 1).alias("regions_with_paired_alerts"))
    # Two single rows.
    return of.join(totals, F.expr("true"))


LOCAL_SCOPES = ("city", "municipality")


def archive_counts(events: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: what the archive holds after all that changes it. A report that names places is local, whatever its scope."""
    local = F.col("scope").isin(*LOCAL_SCOPES)
    places = (F.size("mentioned_places") > 0) if "mentioned_places" in reports.columns else F.lit(False)
    rows = events.select("region", local.alias("local"), F.lit(1).alias("e")).unionByName(reports.select("region", (local | places).alias("local"), F.lit(0).alias("e")))
    named = F.when(F.col("region") != "", F.col("region"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        count(1 - F.col("e")).alias("archive_reports_total"), count(F.col("e")).alias("archive_events_total"),
        F.count_distinct(named).alias("archive_regions_with_records"), F.count_distinct(F.when(F.col("local"), named)).alias("archive_regions_with_local_records"),
    )


def header_metrics(stored: DataFrame, status: DataFrame, events: DataFrame, reports: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(metric, value) of a header: what the archive stored (one row, any columns), else counted anew."""
    is_ = lambda c, v: F.col(c).eqNullSafe(F.lit(v))
    high = is_("source_type", "telegram")
    regions = lambda c: F.count_distinct(F.when(c, F.col("region")))
    of_status = status.agg(
        F.count_if(is_("source_type", "mchs_rss") & F.col("transport_ok")).alias("region_feeds_http_ok"), F.count_if(high & is_("health", "healthy")).alias("high_resolution_sources_healthy"),
        regions(high).alias("high_resolution_regions_configured"), regions(high & F.col("transport_ok")).alias("high_resolution_regions_transport_ok"),
        F.count_if(high & is_("health", "failed")).alias("high_resolution_sources_failed"), F.count_if(high & (F.coalesce("alert_posts", F.lit(0)) > 0)).alias("high_resolution_sources_with_alert_posts"),
        F.count_if(high & (F.coalesce("activity_posts", F.lit(0)) > 0)).alias("high_resolution_sources_with_activity_posts"),
        F.count_if(high & is_("transport", "mtproto") & F.col("transport_ok")).alias("telegram_mtproto_sources_used"), F.count_if(high & F.col("window_complete")).alias("high_resolution_sources_window_complete"),
    )
    paired = events.agg(F.count_distinct("region").alias("regions_with_paired_alerts"), F.count("*").alias("paired"))
    waiting = unmatched.agg(F.count_if(is_("type", "unmatched_start")).alias("unmatched_starts"))
    # All are single rows.
    counted = of_status.join(paired, F.expr("true")).join(waiting, F.expr("true")).join(archive_counts(events, reports), F.expr("true"))
    both = counted.select(*(F.col(c).alias(f"c_{c}") for c in counted.columns)).join(stored, F.expr("true"), "left")
    value = lambda c: F.coalesce(F.col(c).cast("long"), F.col(f"c_{c}")) if c in stored.columns else F.col(f"c_{c}")
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), value(c).cast("long").alias("value")) for c in counted.columns])).alias("m")).select("m.*")


def in_status_order(status: DataFrame) -> DataFrame:
    """Sources by region, then by type; sources alike in both by name."""
    kind = ["source_type"] if "source_type" in status.columns else []
    return status.orderBy("region", *kind, "source")


def missing(wanted: DataFrame, had: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `wanted` whose key `had` lacks."""
    return wanted.join(had.select(*key).distinct(), key, "left_anti")


def rolled_up(rows: DataFrame, levels: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates at every level of a hierarchy, from the total (all levels null) to the finest."""
    return rows.rollup(*levels).agg(*aggregates)


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their `rank`; Spark keeps k a group and task only before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def failed_regions(status: DataFrame) -> DataFrame:
    """Configured regions that no source reached."""
    return status.select("region").distinct().join(status.where("transport_ok").select("region").distinct(), "region", "left_anti")


def region_gaps(status: DataFrame) -> DataFrame:
    """Regions of active sources of which none works, or some failed or are degraded: region, state, sources."""
    active = status.where(F.coalesce("expected_active", F.lit(True)))
    text = F.concat(F.lit("@"), "source", F.lit("="), "health", F.lit("("), F.coalesce("posts", F.lit(0)).cast("string"), F.lit(" posts)"))
    rolled = active.groupBy("region").agg(F.bool_or("transport_ok").alias("works"), F.bool_or(F.col("health").isin("failed", "degraded")).alias("poor"), F.array_join(F.sort_array(F.collect_list(text)), "; ").alias("sources"))
    state = F.when(~F.col("works"), "NO WORKING SOURCE").when(F.col("poor"), "PARTIAL / DEGRADED")
    return rolled.withColumn("state", state).where("state is not null").select("region", "state", "sources")


def health_report(totals: DataFrame, gaps: DataFrame) -> DataFrame:
    """Lines of a Markdown report, in order: (line_no, line)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("line_no"), F.concat(F.lit(f"- {c}: **"), F.coalesce(F.col(c).cast("string"), F.lit("0")), F.lit("**")).alias("line")) for i, c in enumerate(totals.columns)]))
    head = totals.select(pairs.alias("p")).select("p.*")
    # One row a region.
    body = gaps.select((F.row_number().over(Window.orderBy("region")) + 1000).alias("line_no"), F.format_string("| %s | %s | %s |", "region", "state", "sources").alias("line"))
    return head.unionByName(body)


MISSILE_ACTIVE, ACTIVE, MISSILE_REPORT, REPORT = 8, 4, 2, 1


def state_flags(records: DataFrame, by: list[str]) -> DataFrame:
    """The OR of the flags of what is seen at each key: records (by..., threat_class, formal boolean) -> flags int."""
    missile = F.col("threat_class") == "missile"
    flag = F.when(F.col("formal") & missile, MISSILE_ACTIVE).when(F.col("formal"), ACTIVE).when(missile, MISSILE_REPORT).otherwise(REPORT)
    return records.groupBy(*by).agg(F.bit_or(flag).alias("flags"))


def marked_up(records: DataFrame, place: str, region: str) -> DataFrame:
    """State at two levels: a record at a place marks its region too. (level, key, flags)."""
    keys = F.array(F.struct(F.lit("region").alias("level"), F.col(region).alias("key")), F.struct(F.lit("place").alias("level"), F.col(place).alias("key")))
    return state_flags(records.withColumn("k", F.explode(keys)).select("threat_class", "formal", "k.level", "k.key").where("key is not null"), ["level", "key"])


def latest_by(records: DataFrame, key: list[str], at: str, count: str, extra: list[str] | None = None) -> DataFrame:
    """The newest record of each key, of equally new ones the one with the larger count."""
    columns = [at, count, *(extra or [])]
    best = records.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(F.col(at), F.coalesce(count, F.lit(-1)))).alias("best"))
    return best.select(*key, *(F.col(f"best.{c}").alias(c) for c in columns))


def leading_cause(records: DataFrame, key: list[str], at: str, extra: list[str]) -> DataFrame:
    """The record to show at a key: missile alert, any alert, missile report, report; the newest of its class."""
    missile = F.col("threat_class") == "missile"
    rank = F.when(F.col("formal") & missile, 4).when(F.col("formal"), 3).when(missile, 2).otherwise(1)
    best = records.groupBy(*key).agg(F.max_by(F.struct(at, "threat_class", "formal", *extra), F.struct(rank, F.col(at), *extra)).alias("best"))
    return best.select(*key, "best.*")


def plan_window(manifest: DataFrame, mode: str, target_end: Column, lookback_hours: float = 120.0) -> DataFrame:
    """(mode, window_start, window_end) of the next run, from the one-row manifest of the last one (or none).

    backfill: the look-back before the target. replay_previous: the last window again.
    incremental: from the end of the last window (not after the target) to the target.
    Without a readable manifest a run is the initial one.
    """
    back = target_end - F.expr(f"make_dt_interval(0, 0, 0, {lookback_hours * 3600})")
    last = manifest.agg(F.max(F.struct("window_end", "window_start")).alias("m")).select("m.window_start", "m.window_end")
    usable = F.col("window_end").isNotNull() & (F.lit(mode != "replay_previous") | F.col("window_start").isNotNull())
    replay, backfill = F.lit(mode == "replay_previous"), F.lit(mode == "backfill")
    return last.select(
        F.when(backfill, "backfill").when(~usable, "initial").otherwise(F.lit(mode)).alias("mode"),
        F.when(backfill | ~usable, back).when(replay, F.col("window_start")).otherwise(F.least("window_end", target_end)).alias("window_start"),
        F.when(~backfill & usable & replay, F.col("window_end")).otherwise(target_end).alias("window_end"),
    )
