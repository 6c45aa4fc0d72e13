"""The archive: a folder of Parquet tables per run, and a manifest that names the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, window_start timestamp, window_end timestamp, mode string, published_at timestamp"


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all runs; none where there is no archive yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def current_run(spark: SparkSession, root: str) -> str | None:
    row = read_manifest(spark, root).orderBy(F.col("published_at").desc(), "run").select("run").first()
    return row["run"] if row else None


def read_archive(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    run = current_run(spark, root)
    return spark.read.parquet(f"{root}/runs/{run}/{table}") if run else None


def write_archive(tables: dict[str, DataFrame], status: DataFrame, root: str, window_start, window_end, mode: str) -> str:
    """Write a run's tables in a folder of their own, then name it in the manifest; returns the run.

    A run that fails half-way is never named, so readers see whole archives only. Refused
    where every source failed.
    """
    spark = status.sparkSession
    if status.where("ok").isEmpty():
        raise ValueError("every source failed: the archive stays as it is")
    run = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{root}/runs/{run}/{name}")
    row = spark.createDataFrame([(run, window_start, window_end, mode)], "run string, window_start timestamp, window_end timestamp, mode string")
    row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return run


def export_json(rows: DataFrame, path: str) -> None:
    """JSON lines for a viewer, in the order of time, region and place where the columns exist."""
    order = [c for c in ("start", "at", "region", "place") if c in rows.columns]
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(path)


def geojson_lines(rows: DataFrame) -> DataFrame:
    """A GeoJSON feature per row with `line` (array<struct<lon, lat>>, two points or more), the other columns as properties."""
    others = [c for c in rows.columns if c != "line"]
    coordinates = F.transform("line", lambda p: F.array(p["lon"], p["lat"]))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*others).alias("properties")))
    return rows.where(F.size("line") >= 2).select(feature.alias("feature"))


def geojson_points(rows: DataFrame) -> DataFrame:
    """A GeoJSON feature per row with lon and lat, the other columns as properties."""
    others = [c for c in rows.columns if c not in ("lon", "lat")]
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*others).alias("properties")))
    return rows.where("lon is not null and lat is not null").select(feature.alias("feature"))
