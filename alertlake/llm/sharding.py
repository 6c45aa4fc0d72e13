"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; sorting all rows by the
fractional rank (rank - 1/2) / (rows of the source) interleaves the sources in proportion,
and equal cuts of that order give shards that all match the mixture.

Both ranks come from counts of narrow buckets plus a row number inside a bucket, so no
source, however hot, and no global sort passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.shared import cut

HASH_BITS = 24


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_rows: int = 20_000) -> DataFrame:
    """Adds shard int and slot long (gapless from 0 in each shard) to doc_id, size and text_crc32.

    The law is `rows`: shard counts differ by one at most. A null source is a source of its
    own, a null text has 0 bytes, rows with equal doc_id and source are told apart by size
    and checksum only (alike rows are interchangeable, and one that stands more than
    bucket_rows times is spread over the whole order), an empty table gives no rows, and with
    fewer rows than shards the first ones hold a row each or none.
    """
    own = ["doc_id", "stratum", "size", "text_crc32"]
    stratum = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "source"))
    text = F.coalesce("text", F.lit(""))
    narrow = cut(docs.select("doc_id", stratum.alias("stratum"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "sizes")
    total = narrow.count()
    if not total:
        return docs.select("doc_id", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).where("false")
    buckets = min(2**HASH_BITS, max(64, total // bucket_rows))
    # Alike rows would share a bucket, however many they are: what stands more than bucket_rows times is dealt by its rows' numbers in the written table.
    crowds = cut(narrow.groupBy(own).agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select(*(F.col(c).alias(f"c_{c}") for c in own)), "crowds")
    same = F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & (F.col("stratum") == F.col("c_stratum")) & (F.col("size") == F.col("c_size")) & (F.col("text_crc32") == F.col("c_text_crc32"))
    numbered = narrow.withColumn("number", F.monotonically_increasing_id()).join(crowds, same, "left")
    copy = F.when(F.col("c_stratum").isNotNull(), F.col("number")).otherwise(F.lit(0))
    mixed = numbered.select(*own, F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32", copy).alias("mix"))
    mixed = cut(mixed.withColumn("bucket", F.floor(F.shiftrightunsigned("mix", 64 - HASH_BITS) * F.lit(buckets) / 2**HASH_BITS).cast("int")), "mixed")
    by_source = Window.partitionBy("stratum").orderBy("bucket")
    counts = mixed.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("stratum", "bucket", (F.sum("n").over(by_source) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("of"))
    rank = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(F.shiftrightunsigned("mix", 1), "mix", "doc_id", "size", "text_crc32"))
    ranked = mixed.join(counts, ["stratum", "bucket"]).withColumn("at", (F.col("before") + rank - 0.5) / F.col("of"))
    ranked = cut(ranked.select("doc_id", "stratum", "mix", "size", "text_crc32", "at", F.floor(F.col("at") * buckets).cast("int").alias("cell")), "ranked")
    # One row for each of at most 2**24 cells of the order, not of the data.
    cells = ranked.groupBy("cell").agg(F.count("*").alias("n"))
    cells = cells.select("cell", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("at", "stratum", "mix", "doc_id", "size", "text_crc32"))
    placed = ranked.join(cells, "cell").withColumn("place", (F.col("before") + place - 1).cast("long"))
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards} div {total} as int)"))
    slot = F.expr(f"cast(place - (cast(shard as long) * {total} + {shards} - 1) div {shards} as long)")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"))
