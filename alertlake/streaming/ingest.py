"""Streams of landed posts, and the archive as a log of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertlake.operators.merge import best_version, purged_reports, revalidated
from alertlake.sources.posts import POST


def read_posts(spark: SparkSession, folder: str, late: str = "48 hours", files_per_batch: int = 1000) -> DataFrame:
    """Posts that land as JSON files, each id once; posts later than `late` are dropped."""
    rows = spark.readStream.schema(POST).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["channel", "post_id"])


def hourly_activity(posts: DataFrame, by: list[str]) -> DataFrame:
    """Posts per hour and key: windowed counts, final when the watermark passes."""
    return posts.groupBy(F.window("published_at", "1 hour").alias("hour"), *by).agg(F.count("*").alias("posts")).select(*by, F.col("hour.start").alias("hour"), "posts")


def append_versions(stream: DataFrame, log: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each batch under its number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def correct_reports(stream: DataFrame, log: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Reports of a stream under the rules of today, without tallies, logged as append_versions() logs.

    With a stream that reads an older log it is a late correction: each batch is judged anew
    and written under its number, so a run that is repeated changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        revalidated(purged_reports(batch)).drop("changed").write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, log: str, key: list[str], order: list[str]) -> DataFrame:
    """The archive that the log amounts to: of each key the version of the best quality, of those the newest."""
    return best_version(spark.read.parquet(log), key, [*order, "batch"]).drop("batch")
