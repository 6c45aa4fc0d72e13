"""Tables written in the folder that every executor of the cluster can read."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """This application's folder in the cluster's spark.checkpoint.dir.

    Where that is unset: on one machine (master local) a folder there, else an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = named.rstrip("/") if named else Path(tempfile.gettempdir()).as_uri()
    return f"{root}/alertlake-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back.

    What several results need is computed once, and what follows is recomputed from files
    that outlive any executor; plans stay short.
    """
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(*tables: DataFrame) -> None:
    """Delete tables made by staged() that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            _delete(table.sparkSession, file.rsplit("/", 1)[0])


def clear(spark: SparkSession) -> None:
    """Delete all that this application staged: to be called once its results have been written or read."""
    _delete(spark, shared_root(spark))
