"""START/END pairing: the first start of a key opens it, the next end closes it.

The state after a token is told by that token alone (a start leaves the key open, an end
leaves it closed), so no fold over a group is needed: a token counts iff it differs from the
one before it. Keys may be hot: `previous()` looks back inside (key, bucket) and takes what
lies before a bucket from one row per bucket, so no key passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions.rules import ALL_LOCAL_PHRASES, found, judged
from alertlake.functions.text import normalize, stable_id
from alertlake.operators.sequences import last_known, next_known, previous


def kept_tokens(tokens: DataFrame, keys: list[str], order: list[str], kind: str = "kind", bucket: Column | None = None) -> DataFrame:
    """Tokens that change their key's state: starts of a closed key, ends of an open one."""
    seen = previous(tokens, keys, order, F.col(kind), "__prev", bucket)
    return seen.where(((F.col(kind) == "start") & F.coalesce(F.col("__prev") == "end", F.lit(True))) | ((F.col(kind) == "end") & (F.col("__prev") == "start"))).drop("__prev")


def pair(tokens: DataFrame, keys: list[str], order: list[str], carry: list[str], kind: str = "kind", bucket: Column | None = None) -> DataFrame:
    """A row per closed interval: keys, start_<c> and end_<c> for the columns of `carry`."""
    kept = kept_tokens(tokens, keys, order, kind, bucket)
    opened = previous(kept, keys, order, F.struct(*carry), "__start", bucket).where(F.col(kind) == "end")
    return opened.select(*keys, *(F.col(f"__start.{c}").alias(f"start_{c}") for c in carry), *(F.col(c).alias(f"end_{c}") for c in carry))


def still_open(tokens: DataFrame, keys: list[str], order: list[str], carry: list[str], kind: str = "kind", bucket: Column | None = None) -> DataFrame:
    """A row per key that ends open: keys and the columns of `carry` of the start that opened it."""
    kept = kept_tokens(tokens, keys, order, kind, bucket)
    # Kept tokens take turns, so the last one tells: combined before the shuffle.
    last = kept.groupBy(*keys).agg(F.max_by(F.struct(F.col(kind).alias("__kind"), *carry), F.struct(*order)).alias("last"))
    return last.where("last.__kind = 'start'").select(*keys, *(F.col(f"last.{c}").alias(c) for c in carry))


REGION = ""  # the place of a whole region
EVERY_PLACE = "*"  # of an end: all local places of its source


def tokens_of(posts: DataFrame) -> DataFrame:
    """Posts with their places and flags -> a token for each place that a post opens or closes.

    posts: source, region, channel, post_id, published_at, text, url, allow_fallback,
    region_wide boolean, places array<struct<name, ...>>. A post that clears the whole region
    closes all local places of its source and threat by one token of EVERY_PLACE.
    """
    n = normalize(F.col("text"))
    told = judged(posts).where("not retrospective").withColumn("told", F.explode("formal"))
    told = told.select("*", F.col("told.threat").alias("threat"), F.col("told.kind").alias("kind"), found(n, ALL_LOCAL_PHRASES).alias("all_local")).drop("told", "formal", "activity", "retrospective")
    names, start, wide, all_local = F.array_distinct(F.transform("places", lambda p: p["name"])), F.col("kind") == "start", F.col("region_wide"), F.col("all_local")
    neither = ~wide & (F.size(names) == 0) & F.col("allow_fallback")
    token = lambda place, sub, tag: F.struct(place.alias("place"), F.lit(sub).alias("sub"), tag.alias("tag"))
    none = F.array().cast("array<struct<place:string,sub:int,tag:string>>")
    one = lambda when, place, sub, tag: F.when(when, F.array(token(F.lit(place), sub, tag))).otherwise(none)
    own = start | ~all_local
    said = F.concat(
        one(wide & own, REGION, 0, F.when(start, "exact_region").otherwise("regional_clear")),
        one(neither & own, REGION, 0, F.when(start, "parent_region_fallback").otherwise("parent_region_fallback_clear")),
        one(~start & (all_local | wide), EVERY_PLACE, 1, F.when(all_local, "all_local_clear").otherwise("regional_clear")),
        F.when(own, F.transform(names, lambda p: token(p, 2, F.when(start, "exact_local").otherwise("direct")))).otherwise(none),
    )
    columns = [c for c in told.columns if c not in ("places", "all_local", "region_wide", "allow_fallback")]
    return told.withColumn("t", F.explode(said)).select(*columns, "t.place", "t.sub", "t.tag", F.col("post_id").cast("string").alias("order_id"))


GROUP, KEYS, ORDER = ["source", "threat"], ["source", "threat", "place"], ["published_at", "order_id", "sub", "tag"]
CARRIED = ["published_at", "post_id", "text", "url", "tag", "region", "channel"]


def day_of() -> Column:
    """The bucket in which a key's tokens are put in order: a source may be busy, a day of it fits a task."""
    return F.to_date("published_at")


def opened_and_closed(tokens: DataFrame) -> DataFrame:
    """A row per start that opens its place: its columns in `opened`, and in `closed` those of the end that closes it, or null.

    Which clear of all places follows a token, and which came before it, are as-of questions
    within the source; tokens are never multiplied by places. A start opens its place unless
    the token before it there was a start too and no clear of all places lies between. What
    closes it is the earlier of its place's own next end and the source's next clear.
    """
    at = lambda: F.struct(*ORDER)
    wide = (F.col("place") == EVERY_PLACE) & (F.col("kind") == "end")
    end = F.struct(at().alias("at"), F.struct(*CARRIED).alias("row"))
    marked = last_known(tokens, GROUP, ORDER, F.when(wide, at()), "__cleared", day_of())
    marked = next_known(marked, GROUP, ORDER, F.when(wide, end), "__clear", day_of()).where(~wide)
    local = F.col("place") != REGION
    marked = previous(marked, KEYS, ORDER, F.struct(F.col("kind").alias("kind"), at().alias("at")), "__before", day_of())
    marked = next_known(marked, KEYS, ORDER, F.when(F.col("kind") == "end", end), "__end", day_of())
    fresh = F.col("__before").isNull() | (F.col("__before.kind") == "end") | (local & F.coalesce(F.col("__cleared") > F.col("__before.at"), F.lit(False)))
    clear = F.when(local, F.col("__clear"))
    first = F.when(clear["at"] < F.col("__end.at"), clear["row"]).otherwise(F.coalesce(F.col("__end.row"), clear["row"]))
    return marked.where((F.col("kind") == "start") & fresh).select(*KEYS, F.struct(*CARRIED).alias("opened"), first.alias("closed"))


def pair_alerts(tokens: DataFrame, low: Column, high: Column) -> DataFrame:
    """Events: intervals that touch [low, high], with the ids, texts and tags of both ends."""
    pairs = opened_and_closed(tokens).where("closed is not null").select(*KEYS, *(F.col(f"{part}.{c}").alias(f"{name}_{c}") for part, name in (("opened", "start"), ("closed", "end")) for c in CARRIED))
    place = F.when(F.col("place") == REGION, F.col("start_region")).otherwise(F.col("place"))
    events = pairs.select(
        stable_id(F.col("start_channel"), F.col("start_post_id"), F.col("end_post_id"), place, F.col("threat")).alias("id"),
        F.col("start_region").alias("region"), place.alias("place"), F.col("threat").alias("threat_class"), "source",
        F.when(F.col("place") == REGION, "region").otherwise("local").alias("scope"), F.col("start_tag").alias("precision"), F.col("end_tag").alias("end_match"),
        F.col("start_published_at").alias("start"), F.col("end_published_at").alias("end"), "start_url", "end_url", "start_text", "end_text",
    )
    return events.where((F.col("end") >= low) & (F.col("start") <= high))


def unmatched_starts(tokens: DataFrame) -> DataFrame:
    """Starts that nothing closed."""
    opened = opened_and_closed(tokens).where("closed is null").select(*KEYS, "opened.*")
    place = F.when(F.col("place") == REGION, F.col("region")).otherwise(F.col("place"))
    return opened.select(F.lit("unmatched_start").alias("type"), F.col("threat").alias("threat_class"), "source", "region", place.alias("place"), F.col("published_at").alias("start"), "url", "text")


def unplaced_starts(posts: DataFrame) -> DataFrame:
    """Starts that name neither the region nor a place."""
    told = judged(posts).where(~F.col("retrospective") & ~F.col("region_wide") & (F.size("places") == 0)).withColumn("told", F.explode("formal"))
    return told.where("told.kind = 'start'").select(F.lit("unplaced_start").alias("type"), F.col("told.threat").alias("threat_class"), "source", "region", F.lit(None).cast("string").alias("place"), F.col("published_at").alias("start"), "url", "text")
