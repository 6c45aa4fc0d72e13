"""Runs and anchored sessions of rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.operators.intervals import millis
from alertlake.operators.sequences import last_known, next_known, previous, running_sum
from alertlake.operators.stage import staged


FEW = 512  # marks of a stretch that are folded at once


def _same(keys: list[str], **on: str) -> Column:
    """a and b are equal in the keys, nulls too, and a's columns in b's of the other names."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    for mine, other in on.items():
        out = out & (F.col(f"a.{mine}") == F.col(f"b.{other}"))
    return out


def _doubled(marks: DataFrame, starts: DataFrame, keys: list[str], within_ms: int) -> DataFrame:
    """Starts of the sessions of marks (keys, t), given the first of each stretch: all that their pointers reach.

    Every mark points at the first that its own session would leave out. In each round what
    the starts reach is added, and pointers are made twice as long.
    """
    asked = marks.withColumns({"mark": F.col("t"), "of": F.lit(None).cast("long")}).unionByName(marks.select(*keys, (F.col("t") + within_ms).alias("t"), F.lit(None).cast("long").alias("mark"), F.col("t").alias("of")))
    # At one instant the question comes after the mark: a mark just within reach isn't the next start.
    sorted_ = asked.withColumn("turn", F.col("of").isNotNull().cast("int"))
    jump = next_known(sorted_, keys, ["t", "turn"], F.col("mark"), "to", F.floor(F.col("t") / within_ms)).where("of is not null")
    step, found = staged(jump.select(*keys, F.col("of").alias("t"), "to").where("to is not null"), "jumps"), starts.count()
    while True:
        reached = starts.alias("a").join(step.alias("b"), _same(keys, t="t")).select(*(F.col(f"a.{k}") for k in keys), F.col("b.to").alias("t"))
        more = staged(starts.unionByName(reached).distinct(), "starts")
        if (n := more.count()) == found:
            return more
        starts, found = more, n
        step = staged(step.alias("a").join(step.alias("b"), _same(keys, to="t")).select(*(F.col(f"a.{k}") for k in keys), F.col("a.t"), F.col("b.to")), "jumps")


def anchored_sessions(rows: DataFrame, keys: list[str], at: str, within_ms: int) -> DataFrame:
    """rows with `session_start`: a session takes what comes up to `within_ms` after its first row.

    Not a gap session: the reach is counted from the first row. A row more than the reach
    after the one before it starts a session for sure, and so a stretch of rows that depends
    on no other. Stretches of a few instants, nearly all, are folded at once; in longer ones,
    of a busy key, starts are found by pointers that are doubled, in log2(sessions of the
    longest stretch) rounds of joins. Instants are put in order inside buckets of `within_ms`,
    so no key passes through one task. Rows without a time are left out.
    """
    bucket = F.floor(F.col("t") / within_ms)
    timed = rows.where(F.col(at).isNotNull()).withColumn("t", millis(F.col(at)))
    marks = timed.select(*keys, "t").distinct()
    sure = previous(marks, keys, ["t"], F.col("t"), "before", bucket).withColumn("first", F.when(F.coalesce(F.col("t") - F.col("before") > within_ms, F.lit(True)), F.col("t")))
    placed = staged(last_known(sure, keys, ["t"], F.col("first"), "stretch", bucket).select(*keys, "t", "stretch"), "stretches")
    sizes = staged(placed.groupBy(*keys, "stretch").agg(F.count("*").alias("n")), "stretch-sizes")
    own = [F.col(f"a.{k}") for k in keys]
    of = lambda some: placed.alias("a").join(some.alias("b"), _same(keys, stretch="stretch")).select(*own, F.col("a.t"), F.col("a.stretch"))
    none = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("starts"))
    fold = lambda acc, t: F.when(F.coalesce(t - acc["last"] > within_ms, F.lit(True)), F.struct(t.alias("last"), F.concat(acc["starts"], F.array(t)).alias("starts"))).otherwise(acc)
    listed = of(sizes.where(F.col("n") <= FEW)).groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    starts = listed.select(*keys, F.explode(F.aggregate("ts", none, fold)["starts"]).alias("t"))
    long = sizes.where(F.col("n") > FEW)
    if not long.isEmpty():
        starts = starts.unionByName(_doubled(of(long).select(*keys, "t"), staged(long.select(*keys, F.col("stretch").alias("t")), "starts"), keys, within_ms))
    told = placed.alias("a").join(starts.withColumn("s", F.col("t")).alias("b"), _same(keys, t="t"), "left").select(*own, F.col("a.t"), F.col("b.s"))
    found = last_known(told, keys, ["t"], F.col("s"), "start", bucket).select(*keys, F.col("t").alias("mark"), "start")
    back = timed.alias("a").join(found.alias("b"), _same(keys, t="mark"))
    return back.select("a.*", F.timestamp_millis("b.start").alias("session_start")).drop("t")


def session_totals(rows: DataFrame, keys: list[str], at: str, within_ms: int, aggregates: list[Column]) -> DataFrame:
    """One row per anchored session with its size and the given aggregates."""
    return anchored_sessions(rows, keys, at, within_ms).groupBy(*keys, "session_start").agg(F.count("*").alias("observations"), *aggregates)


def runs_of(rows: DataFrame, keys: list[str], order: str, flag: str, bucket: Column | None = None) -> DataFrame:
    """Maximal runs of rows with equal `flag`: keys, flag, first, last, length (gaps and islands)."""
    changed = previous(rows, keys, [order], F.col(flag), "__before", bucket).withColumn("__c", F.coalesce((F.col(flag) != F.col("__before")).cast("int"), F.lit(1)))
    numbered = running_sum(changed, keys, [order], F.col("__c"), "__run", bucket)
    return numbered.groupBy(*keys, "__run", flag).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__run")


def bridges(runs: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """The runs without the flag that lie between the first and the last run with it."""
    lit = runs.where(flag).groupBy(*keys).agg(F.min("first").alias("__lo"), F.max("last").alias("__hi"))
    return runs.where(~F.col(flag)).join(lit, keys).where("first > __lo and last < __hi").drop("__lo", "__hi")
