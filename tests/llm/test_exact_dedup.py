from collections import defaultdict

from pyspark.sql import functions as F

from alertlake.llm.exact_dedup import build_index, directory, exact_dedup, look_up

from .conftest import ODD


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {i: (max(groups[t or ""]), len(groups[t or ""])) for i, t in rows}


def check(df, rows, **options):
    want = brute(rows)
    got = exact_dedup(df, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.doc_id] and r.kept == (r.doc_id == r.keep_id)


def test_odd_texts(docs_of):
    texts = ODD * 3
    check(docs_of(texts), list(enumerate(texts)))


def test_colliding_keys_are_told_apart_by_bytes(docs_of):
    texts = ODD * 2 + [f"t{i % 7}" for i in range(40)]
    check(docs_of(texts), list(enumerate(texts)), key=lambda c: F.length(c).cast("long") % 3)


def test_empty_table(docs_of, spark):
    assert exact_dedup(docs_of([])).collect() == []


def test_clashing_columns(docs_of):
    df = docs_of(["a", "a", "b"]).withColumns({c: F.lit("?") for c in ("key", "body", "rows", "kept", "keep_id", "bucket", "shared")})
    check(df, [(0, "a"), (1, "a"), (2, "b")])


def test_directory_doubles_where_buckets_overflow(spark):
    """Held against splitting one bucket after another by hand."""
    first = lambda *bits: sum(b << (63 - i) for i, b in enumerate(bits))
    near = [first(0, 0, 0, 0, 0, 0, 1) + i for i in range(9)]  # alike in the first 60 bits
    hashes = near + [first(0, 1) + 5, first(0, 1, 1) + 7, first(1), first(1, 1), first(1, 1, 1)]
    df = spark.createDataFrame([(h - 2**64 if h >= 2**63 else h,) for h in hashes], "hash long")
    for capacity in (1, 3, 9, 20):
        want, open_ = {}, [(0, 0, hashes)]
        while open_:
            depth, prefix, own = open_.pop()
            if len(own) <= capacity:
                want |= {h: (prefix, depth) for h in own}
            else:
                open_ += [(depth + 1, 2 * prefix + b, [h for h in own if h >> (63 - depth) & 1 == b]) for b in (0, 1)]
        if max(d for _, d in want.values()) > 20:
            continue  # so many slots aren't written out here
        depth, slots = directory(df, capacity)
        of = {r.slot: r for r in slots.collect()}
        assert depth == max(d for _, d in want.values())
        for h, (prefix, d) in want.items():
            found = of[h >> (64 - depth) if depth else 0]
            assert (found.bucket, found.bucket_depth) == (prefix << (depth - d), d)


def test_counts_are_refined_where_keys_crowd(spark):
    """Ten of 10,000 keys' hashes alike in 12 bits: deeper than the counts that the first estimate takes."""
    rows = [((i * 0x9E3779B97F4A7C15) % 2**64 - 2**63,) for i in range(2000)] + [((5 << 51) + i * 2**40,) for i in range(40)]
    depth, slots = directory(spark.createDataFrame(rows, "hash long"), 25)
    hashes = [r[0] % 2**64 for r in rows]
    of = {r.slot: r for r in slots.collect()}
    held = {}
    for h in hashes:
        b = of[h >> (64 - depth)]
        held.setdefault((b.bucket, b.bucket_depth), []).append(h)
    assert depth > 7 + 4 and max(map(len, held.values())) <= 25
    assert all(len({h >> (64 - d) for h in own}) == 1 for (_, d), own in held.items())


def test_index_holds_every_key_once(docs_of, spark):
    texts = [f"t{i % 50}" for i in range(200)]
    index = build_index(docs_of(texts), capacity=5)
    assert index.buckets.count() == 50 and index.buckets.agg(F.sum("group_size")).first()[0] == 200
    assert index.buckets.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 5
    assert index.depth >= 4


def test_the_result_is_read_from_the_index(docs_of):
    """With two slots of the directory swapped, or an entry changed, lookups go wrong."""
    texts = [f"t{i % 50}" for i in range(200)]
    docs = docs_of(texts)
    index = build_index(docs, capacity=5)
    assert look_up(docs, index).count() == 200
    buckets = [r.bucket for r in index.directory.select("bucket").distinct().limit(2).collect()]
    right, index.directory = index.directory, index.directory.replace({buckets[0]: buckets[1], buckets[1]: buckets[0]}, subset="bucket")
    assert look_up(docs, index).count() < 200
    index.directory, index.buckets = right, index.buckets.withColumn("keep_id", F.col("keep_id") + 1)
    assert {r.keep_id for r in look_up(docs, index).collect()} == set(range(151, 201))


def test_null_and_repeated_ids(docs_of):
    rows = exact_dedup(docs_of(["a", "a", "b", "c", "c", "c"], ids=[None, 3, None, 7, 7, 5])).collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows), key=str)
    assert got == sorted([(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True), (7, 7, 3, True), (7, 7, 3, True), (5, 7, 3, False)], key=str)


def test_colliding_texts_in_one_chain_and_a_text_in_half_of_the_rows(docs_of):
    """Keys of one bit: every text collides with half of the others; one of them stands 400 times."""
    texts = ["hot"] * 400 + [f"t{i % 150}" for i in range(400)]
    docs = docs_of(texts)
    key = lambda body: (F.xxhash64(body) % 2).cast("long")
    index = build_index(docs, key, capacity=1)
    rows = index.buckets.collect()
    assert len(rows) == 151 and len({r["bucket"] for r in rows}) == len({r["key"] for r in rows}) and all(r["bytes"] is not None for r in rows)
    assert {r["bytes"]: (r["keep_id"], r["group_size"]) for r in rows}["hot"] == (399, 400)
    want = {i: max(j for j, u in enumerate(texts) if u == t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup(docs, key, capacity=1).collect()} == want
