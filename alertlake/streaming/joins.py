"""Joins of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.operators.intervals import millis


def streams_near_in_time(left: DataFrame, right: DataFrame, within_ms: int, at: str = "at", other: str = "other_at", on: list[str] | None = None, late: str = "48 hours") -> DataFrame:
    """Every pair of rows of two streams at most `within_ms` apart (both ends included), and equal in the columns `on`.

    Both streams have a watermark `late` behind them, and a pair's times are bound to each
    other, so a row is kept only until the other stream's watermark is `within_ms` past it.
    Without `on` rows meet in buckets of time.
    """
    bucket = lambda c: F.floor(millis(F.col(c)) / within_ms).cast("long")
    a, b, keys = left.withWatermark(at, late), right.withWatermark(other, late), list(on or [])
    if not keys:
        a = a.withColumn("__bucket", bucket(at))
        b = b.withColumn("__bucket", F.explode(F.sequence(bucket(other) - 1, bucket(other) + 1)))
    met = [*keys, *([] if keys else ["__bucket"])]
    renamed = b.withColumnsRenamed({k: f"__other_{k}" for k in met})
    span = F.expr(f"make_dt_interval(0, 0, 0, {within_ms} / 1000)")
    close = (F.col(other) >= F.col(at) - span) & (F.col(other) <= F.col(at) + span)
    for k in met:
        close = close & (F.col(k) == F.col(f"__other_{k}"))
    return a.join(renamed, close).drop(*(f"__other_{k}" for k in met), "__bucket")
