"""What stands before or after a row in its key's order, without sorting a key in one task.

Each function takes a `bucket` that rises with the order: rows are sorted inside (key,
bucket), and what lies before or after a bucket comes from one row per bucket. Without a
bucket a key is sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _windows(keys: list[str], order: list[str]) -> tuple[WindowSpec, WindowSpec]:
    return Window.partitionBy(*keys, "__bucket").orderBy(*order), Window.partitionBy(*keys).orderBy("__bucket")


def _dealt(rows: DataFrame, value: Column, bucket: Column | None) -> DataFrame:
    return rows.withColumns({"__bucket": F.lit(0) if bucket is None else bucket, "__value": value})


def _joined(rows: DataFrame, per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their bucket's row; null keys meet null keys."""
    named = per_bucket.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__bucket").alias("__b"), "__carried")
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(named, same)


def previous(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: Column | None = None) -> DataFrame:
    """rows with a column `name`: `value` of the row before, by `order` within `keys`; null for the first."""
    if bucket is None:
        return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    dealt = _dealt(rows, value, bucket)
    within, across = _windows(keys, order)
    last = dealt.groupBy(*keys, "__bucket").agg(F.max_by(F.struct("__value"), F.struct(*order)).alias("__last"))
    last = last.withColumn("__carried", F.lag(F.col("__last")["__value"]).over(across))
    numbered = dealt.withColumns({"__before": F.lag("__value").over(within), "__first": F.row_number().over(within) == 1})
    return _joined(numbered, last, keys).select(*rows.columns, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__before")).alias(name))


def last_known(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: Column | None = None) -> DataFrame:
    """rows with a column `name`: the last `value` that isn't null up to the row, its own included."""
    dealt = _dealt(rows, value, bucket)
    within, across = _windows(keys, order)
    last = dealt.groupBy(*keys, "__bucket").agg(F.max_by(F.struct("__value"), F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__last"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("__carried", F.last(F.col("__last")["__value"], ignorenulls=True).over(before))
    known = dealt.withColumn("__known", F.last("__value", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(known, last, keys).select(*rows.columns, F.coalesce("__known", "__carried").alias(name))


def next_known(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: Column | None = None) -> DataFrame:
    """rows with a column `name`: the first `value` after the row that isn't null."""
    dealt = _dealt(rows, value, bucket)
    within, across = _windows(keys, order)
    first = dealt.groupBy(*keys, "__bucket").agg(F.min_by(F.struct("__value"), F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__first"))
    after = across.rowsBetween(1, Window.unboundedFollowing)
    first = first.withColumn("__carried", F.first(F.col("__first")["__value"], ignorenulls=True).over(after))
    known = dealt.withColumn("__known", F.first("__value", ignorenulls=True).over(within.rowsBetween(1, Window.unboundedFollowing)))
    return _joined(known, first, keys).select(*rows.columns, F.coalesce("__known", "__carried").alias(name))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: Column | None = None) -> DataFrame:
    """rows with a column `name`: the sum of `value` up to the row, its own included."""
    dealt = _dealt(rows, value, bucket)
    within, across = _windows(keys, order)
    sums = dealt.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__sum"))
    sums = sums.withColumn("__carried", F.sum("__sum").over(across.rowsBetween(Window.unboundedPreceding, -1)))
    summed = dealt.withColumn("__known", F.sum("__value").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(summed, sums, keys).select(*rows.columns, (F.col("__known") + F.coalesce("__carried", F.lit(0))).alias(name))
