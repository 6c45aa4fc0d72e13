"""Gazetteers and shapes: tab-separated place dumps, place catalogs, GeoJSON."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlake.operators.geometry import POLYGON, seat, weighted_centroid

COLUMNS = "id name ascii alternates lat lon class code country cc2 admin1 admin2 admin3 admin4 population elevation dem timezone modified".split()
PLACE = "id string, name string, label string, region string, type string, lat double, lon double, population long, feature_code string, aliases array<string>"


def _zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of the text files in zip archives; an archive can't be split, so each is read by one task, some thousand lines at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        with io.TextIOWrapper(archive.open(name), encoding="utf-8") as file:
                            while lines := list(itertools.islice(file, 10_000)):
                                yield pd.DataFrame({"line": [line.rstrip("\n") for line in lines]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "line string")


def place_dump(spark: SparkSession, path: str, country: str) -> DataFrame:
    """Rows of a country from a tab-separated dump of 19 columns, plain or zipped; rows that are too short or lack a coordinate go."""
    if path.endswith(".zip"):
        parts = F.split("line", "\t", -1)
        raw = _zipped_lines(spark, path).where(F.size(parts) >= len(COLUMNS)).select(*(F.get(parts, i).alias(c) for i, c in enumerate(COLUMNS)))
    else:
        raw = spark.read.option("sep", "\t").option("quote", "").option("mode", "DROPMALFORMED").schema(", ".join(f"{c} string" for c in COLUMNS)).csv(path)
    typed = raw.where((F.col("country") == country) & F.col("modified").isNotNull())
    typed = typed.withColumns({"lat": F.expr("try_cast(lat as double)"), "lon": F.expr("try_cast(lon as double)"), "population": F.coalesce(F.expr("try_cast(population as long)"), F.lit(0).cast("long"))})
    return typed.where("lat is not null and lon is not null")


def write_catalog(places: DataFrame, path: str) -> dict[str, int]:
    """Write a catalog of places (PLACE and rank) as Parquet; returns how many there are of each type."""
    places.write.mode("overwrite").parquet(path)
    return {r["type"]: r["n"] for r in places.sparkSession.read.parquet(path).groupBy("type").agg(F.count("*").alias("n")).collect()}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog as written by write_catalog(), or a JSON file of places; none where there is no such path."""
    schema = f"{PLACE}, rank int"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True) if path.endswith(".json") else spark.read.schema(schema).parquet(path)


def alias_set(*names, limit: int = 40):
    """Distinct names in order (case folded), with a letter and up to 90 characters, `limit` at most."""
    listed = F.filter(F.transform(F.flatten(F.array(*names)), lambda s: F.trim(s)), lambda n: n.rlike(r"\p{L}") & (F.length(n) <= 90))
    seen = F.transform(listed, F.lower)
    firsts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(listed))), lambda i: F.when(F.array_position(seen, F.get(seen, i - 1)) == i, F.get(listed, i - 1))), lambda n: n.isNotNull())
    return F.slice(firsts, 1, limit)


def cities(dump: DataFrame, regions: DataFrame) -> DataFrame:
    """A catalog of populated places: (admin1 -> region) joined, aliases from all names, in order of region, population, name."""
    own = dump.where("class = 'P'").join(regions.select(F.col("code").alias("admin1"), "region"), "admin1")
    aliases = alias_set(F.array("name"), F.array("ascii"), F.split(F.coalesce("alternates", F.lit("")), ","), limit=42)
    rows = own.select("id", "name", F.col("name").alias("label"), "region", F.lit("city").alias("type"), "lat", "lon", "population", F.col("code").alias("feature_code"), aliases.alias("aliases"))
    return ranked(rows)


def municipalities(names: DataFrame, features: DataFrame, points: DataFrame, regions: DataFrame) -> DataFrame:
    """Districts known by name, by an area or by places in them, placed at the area, else at the largest place, else at their centroid.

    names (code, name, aliases), features (code, lat, lon), points (code, name, lat, lon, population).
    """
    centre = weighted_centroid(points, ["code"], F.sqrt("population")).toDF("code", "c_lon", "c_lat")
    largest = seat(points, ["code"], "population").toDF("code", "s_name", "s_lon", "s_lat")
    area = features.groupBy("code").agg(F.min(F.struct("lat", "lon")).alias("f")).select("code", F.col("f.lat").alias("f_lat"), F.col("f.lon").alias("f_lon"))
    every = names.join(area, "code", "full").join(largest, "code", "full").join(centre, "code", "full")
    prefix = F.substring_index("code", ".", 2)
    rows = every.join(regions.select(F.col("code").alias("r_code"), "region"), prefix == F.col("r_code"))
    name = F.coalesce("name", "s_name")
    placed = rows.select(F.col("code").alias("id"), name.alias("name"), name.alias("label"), "region", F.lit("municipality").alias("type"), F.coalesce("f_lat", "c_lat", "s_lat").alias("lat"), F.coalesce("f_lon", "c_lon", "s_lon").alias("lon"), F.lit(0).cast("long").alias("population"), F.lit("ADM2").alias("feature_code"), alias_set(F.coalesce("aliases", F.array(name)), limit=80).alias("aliases"))
    return ranked(placed)


def ranked(places: DataFrame) -> DataFrame:
    """places with `rank`: region, then the larger population, then the name; it decides which place counts first."""
    # A gazetteer is ranked within its regions; the order across them never matters, as posts match in one region.
    return places.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(F.col("population").desc(), "name", "id")).cast("int"))


def shapes(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """GeoJSON polygons and multipolygons -> (region, polygon), the rings of all parts together."""
    properties = f"struct<`{name}`: string>"
    schema = f"features array<struct<properties: {properties}, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    text = F.col("f.geometry.coordinates")
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))).otherwise(F.from_json(text, "array<array<array<double>>>"))
    polygon = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return features.select(F.col("f.properties").getField(name).alias("region"), polygon.cast(POLYGON).alias("polygon")).where("polygon is not null")
