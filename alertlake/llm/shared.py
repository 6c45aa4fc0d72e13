"""Written tables in the folder that every executor of the cluster can read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from alertlake.operators import stage


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    It ends the lineage: what follows is recomputed from files that outlive any executor.
    It also gives the planner the true size, so a join on the table is broadcast only
    when the table lies under spark.sql.autoBroadcastJoinThreshold.
    """
    return stage.staged(df, name)


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    stage.remove(*tables)


def release() -> None:
    """Give back what a Python worker's finished task leaves in Arrow's pool: the worker waits for other tasks beside busy ones."""
    pa.default_memory_pool().release_unused()
