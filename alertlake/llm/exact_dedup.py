"""Exact dedup over an extendible-hash index kept in shared files.

The index has a directory and buckets. Slots of the directory are the leading `depth` bits of
a key's hash; each names a bucket. It starts with one slot and one bucket; while a bucket
holds more than `capacity` keys, the directory doubles (one more bit) and the overfull
buckets are split in two, the others being named by two slots each from then on. Doubling
works on counts of slots, not on the keys.

Rows are routed to their buckets first: hash, slot, bucket. Buckets are made by owner tasks,
each with a range of (bucket, key), which put the rows of a text together and write an entry
for it: its key, the row that stays and the number of rows. Rows whose key others share
carry their bytes to the owner, which compares them: texts of one key are chained, each
entry with its bytes. What a map task or a share of the owners' input repeats is one row with
a count before it gets there, so a text in half of all rows is a few rows to its owner. Every
row is then looked up: slot, bucket, key and, in a chain, bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.shared import cut, remove

SHARES = 64  # of a text's rows, combined before they go to its owner
FINER = 4  # bits by which counts are finer than the expected depth, and are refined


@dataclass
class Index:
    depth: int  # bits of a slot
    directory: DataFrame  # slot, bucket, bucket_depth
    buckets: DataFrame  # bucket, key, bytes, keep_id, group_size
    chained: DataFrame  # key: keys of several texts


def leading(hash_: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hash_, 64 - bits) if bits else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int) -> tuple[int, DataFrame]:
    """From a column `hash` of distinct keys: the depth, and (slot, bucket, bucket_depth).

    A bucket is named by its first slot. Halves without keys have no bucket.
    """
    spark, bits = hashes.sparkSession, 1
    counted = lambda df, n: cut(df.groupBy(leading(F.col("hash"), n).alias("slot")).agg(F.count("*").alias("n")), "slot-counts")
    bits = min(64, max(1, math.ceil(math.log2(max(1, hashes.count() / capacity))) + FINER))
    counts, depth, settled = counted(hashes, bits), 0, []
    while True:
        at = F.shiftrightunsigned("slot", bits - depth) if depth else F.lit(0).cast("long")
        held = cut(counts.groupBy(at.alias("prefix")).agg(F.sum("n").alias("held")), "buckets-held")
        fits = F.col("held") <= capacity if depth < 64 else F.lit(True)
        settled.append(held.where(fits).select("prefix", F.lit(depth).alias("bucket_depth")))
        overfull = held.where(~fits).select("prefix")
        if overfull.isEmpty():
            break
        if depth == bits:  # the counts tell these buckets' halves apart no more: count their keys by more bits
            bits = min(64, bits + FINER)
            left = hashes.withColumn("prefix", leading(F.col("hash"), depth)).join(overfull, "prefix", "left_semi")
            finer = counted(left, bits)
        else:
            finer = cut(counts.withColumn("prefix", at).join(overfull, "prefix", "left_semi").select("slot", "n"), "slot-counts")
        remove(spark, counts)
        counts, depth = finer, depth + 1
    buckets = settled[0]
    for more in settled[1:]:
        buckets = buckets.union(more)
    first = F.expr(f"shiftleft(prefix, {depth} - bucket_depth)")
    slots = F.explode(F.sequence(F.col("bucket"), F.col("bucket") + F.expr(f"shiftleft(1L, {depth} - bucket_depth)") - 1))
    return depth, cut(buckets.select(first.alias("bucket"), "bucket_depth").select(slots.alias("slot"), "bucket", "bucket_depth"), "directory")


def keyed(docs: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, key, hash, body): the key is hashed once more, so that its leading bits are even whatever the key."""
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    return body.withColumn("key", key(F.col("body"))).withColumn("hash", F.xxhash64("key"))


def routed(rows: DataFrame, depth: int, slots: DataFrame) -> DataFrame:
    """rows (hash, ...) with their bucket, through the directory."""
    return rows.withColumn("slot", leading(F.col("hash"), depth)).join(slots.select("slot", "bucket"), "slot").drop("slot", "hash")


def entries_of_owners(rows: DataFrame) -> DataFrame:
    """(bucket, key, bytes, keep_id, n) -> (bucket, key, bytes, keep_id, group_size): an entry a text, made by the owner of its range.

    Rows are combined by shares of their ids first; the range exchange then gives every owner
    all that is left of its keys, and grouping by bytes there compares them.
    """
    share = F.pmod(F.xxhash64("keep_id"), F.lit(SHARES))
    combined = rows.groupBy("bucket", "key", "bytes", share.alias("share")).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    owned = combined.repartitionByRange("bucket", "key")
    return owned.groupBy("bucket", "key", "bytes").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def build_index(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = 100_000) -> Index:
    """The index of docs (doc_id, text; null counts as empty), written to the shared folder."""
    rows = keyed(docs, key)
    keys = cut(rows.groupBy("key", "hash").agg(F.count("*").alias("n")), "keys")
    depth, slots = directory(keys.select("hash"), capacity)
    # A key that one row has needs no bytes: nothing shares its place.
    shared = cut(keys.where("n > 1").select("key"), "shared-keys")
    several = rows.join(shared, "key", "left_semi").select("hash", "key", F.col("body").alias("bytes"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    single = rows.join(shared, "key", "left_anti").select("hash", "key", F.lit(None).cast("string").alias("bytes"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    made = cut(entries_of_owners(routed(several.unionByName(single), depth, slots)), "entries")
    chained = cut(made.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "chained-keys")
    # Where a key has one text its bytes are not kept: the key tells it.
    told = made.join(chained.withColumn("told", F.lit(True)), "key", "left").withColumn("bytes", F.when(F.col("told"), F.col("bytes")))
    return Index(depth, slots, cut(told.select("bucket", "key", "bytes", "keep_id", "group_size").sortWithinPartitions("bucket", "key"), "buckets"), chained)


def look_up(docs: DataFrame, index: Index, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text_sha256, keep_id, group_size) of every row, through slot, bucket, key and bytes."""
    rows = keyed(docs, key).withColumn("text_sha256", F.sha2("body", 256))
    if index.chained.isEmpty():
        asked = rows.withColumn("bytes", F.lit(None).cast("string"))
    else:
        asked = rows.join(index.chained.withColumn("told", F.lit(True)), "key", "left").withColumn("bytes", F.when(F.col("told"), F.col("body")))
    asked = asked.select("doc_id", "text_sha256", "key", "bytes", leading(F.col("hash"), index.depth).alias("slot"))
    at = asked.join(index.directory.select("slot", "bucket"), "slot").drop("slot")
    entry = index.buckets.select(F.col("bucket").alias("of"), F.col("key").alias("entry_key"), F.col("bytes").alias("entry_bytes"), "keep_id", "group_size")
    same = (F.col("bucket") == F.col("of")) & (F.col("key") == F.col("entry_key")) & F.col("bytes").eqNullSafe(F.col("entry_bytes"))
    return at.join(entry, same).select("doc_id", "text_sha256", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts have the same bytes; null counts as empty. Of equal
    texts the row with the largest doc_id stays. Rows that repeat both doc_id and text are
    the same document: they count in group_size and share its verdict. A null doc_id is
    less than any other. Other columns are ignored; an empty table gives an empty table.
    """
    found = look_up(docs, build_index(docs, key, capacity), key)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
