import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from alertlake.llm.sharding import shard_rows

from .conftest import ODD


def test_law_slots_and_mixture(docs_of):
    texts = [f"text {i}" for i in range(1000)]
    rows = shard_rows(docs_of(texts), shards=8, bucket_rows=10).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 1000 and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    slots, mix = defaultdict(list), defaultdict(Counter)
    for r in rows:
        slots[r.shard].append(r.slot)
        mix[r.shard][None if r.doc_id % 3 == 0 else f"s{r.doc_id % 2}"] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(m[None] - 334 / 8) <= 2 and abs(m["s0"] - 333 / 8) <= 2 for m in mix.values())


def test_sizes_checksums_and_repeats(docs_of):
    texts = ODD * 2
    ids = [0] * len(texts)
    rows = shard_rows(docs_of(texts, ids=ids), shards=40).collect()
    want = Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    assert Counter((r["size"], r.text_crc32) for r in rows) == want
    assert max(Counter(r.shard for r in rows).values()) == 1 and all(r.slot == 0 for r in rows)


def test_same_result_whatever_the_partitions(docs_of):
    df = docs_of([f"t{i}" for i in range(300)])
    one, other = (sorted(map(tuple, shard_rows(d, 7).collect())) for d in (df.repartition(1), df.repartition(13)))
    assert one == other


def test_empty(docs_of):
    assert shard_rows(docs_of([])).collect() == []


def plain(rows, shards):
    """rows (doc_id, source, mix, size, crc) -> their (shard, slot): sorted by fractional rank within the source, cut equally."""
    by_source = defaultdict(list)
    for r in rows:
        by_source["null" if r[1] is None else "=" + r[1]].append(r)
    order = []
    for name, own in by_source.items():
        own.sort(key=lambda r: (r[2] % 2**64, -1 if r[0] is None else r[0], r[3], r[4]))
        order += [((i + 0.5) / len(own), name, r) for i, r in enumerate(own)]
    order.sort(key=lambda o: (o[0], o[1], o[2][2], -1 if o[2][0] is None else o[2][0], o[2][3], o[2][4]))
    starts = [-(-k * len(rows) // shards) for k in range(shards)]
    return sorted((str(r[0]), r[3], r[4], p * shards // len(rows), p - starts[p * shards // len(rows)]) for p, (_, _, r) in enumerate(order))


def test_against_a_plain_interleaving(docs_of):
    """A source with two thirds of the rows, one of one row, none, null and repeated ids."""
    texts = [f"text {i % 90}" for i in range(400)]
    ids = [None if i % 50 == 7 else i % 380 for i in range(400)]
    sources = F.when(F.col("n_chars") % 3 != 0, "hot").when(F.col("doc_id") == 5, "one").when(F.col("doc_id") % 4 == 1, F.lit(None).cast("string")).otherwise("rest")
    df = docs_of(texts, ids=ids).withColumn("source", sources).withColumns({c: F.lit("x") for c in ("bucket", "stratum", "mix", "cell", "at")})
    text = F.coalesce("text", F.lit(""))
    sized = [(F.octet_length(text) + 16).cast("long").alias("s"), F.crc32(text).alias("c")]
    keyed = df.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id", *sized, F.lit(0).cast("long")).alias("m"), *sized).collect()
    for shards, bucket_rows in ((7, 20_000), (40, 3)):
        got = sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.slot) for r in shard_rows(df, shards=shards, bucket_rows=bucket_rows).collect())
        assert got == plain([tuple(r) for r in keyed], shards)


def test_alike_rows_are_no_single_bucket(spark):
    rows = spark.range(30_000).selectExpr("cast(null as long) doc_id", "if(id % 3 = 0, concat('t', id), 'same') text", "cast(null as string) lang", "if(id % 5 = 0, 'a', 'b') source", "0L n_chars")
    found = shard_rows(rows, shards=7, bucket_rows=300)
    counts = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert sum(counts) == 30_000 and len(counts) == 7 and max(counts) - min(counts) <= 1
    slots = found.groupBy("shard").agg({"slot": "max"}).collect()
    assert {r[1] for r in slots} <= {max(counts) - 1, min(counts) - 1} and found.select("shard", "slot").distinct().count() == 30_000
    # Every shard has its part of the text that stands in two thirds of the rows.
    size = len("same") + 16
    alike = [r["count"] for r in found.where(f"size = {size}").groupBy("shard").count().collect()]
    assert len(alike) == 7 and max(alike) < 1.2 * min(alike)
