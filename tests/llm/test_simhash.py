import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from alertlake.llm.simhash import VantageTree, fingerprint, forest, links, near_duplicates, pieces, shards, views

from .conftest import ODD
from .test_components import brute as union_find


def plain(text):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [t or "" for t in ODD])
def test_fingerprint(text):
    assert fingerprint(text) == plain(text)


def test_seed_is_that_of_spark(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("ab cd ef gh"))).first()[0]
    assert fingerprint("AB cd\tef gh") == h % 2**64


def near_points(n, rng):
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 5, 40])):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return list({*out[:n], 0, 2**64 - 1})


def all_links(points):
    p = np.array(points, np.uint64)
    return [(int(p[i]), int(p[j])) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= 4) + i + 1]


@pytest.mark.parametrize("within", range(9))
def test_views_hold_every_pair(within):
    rng = random.Random(within)
    for _ in range(300):
        apart = sum(1 << b for b in rng.sample(range(64), rng.randrange(within + 1)))
        assert any((apart & bits).bit_count() <= radius for bits, radius in views(within))


@pytest.mark.parametrize("within", [0, 1, 4, 7])
def test_trees_give_what_all_pairs_give(within):
    points = near_points(700, random.Random(within))
    p = np.sort(np.array(points, np.uint64))
    far = np.bitwise_count(p[:, None] ^ p)
    for bits, radius in views(within):
        want = {(i, j) for i, j in np.argwhere((far <= within) & (np.bitwise_count((p[:, None] ^ p) & np.uint64(bits)) <= radius)).tolist() if i > j}
        found = [{x, y} for a, b in VantageTree(p, bits, radius, within).pairs() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        got = {(max(f), min(f)) for f in found}
        assert want <= got and all(far[f] <= within for f in got) and len(got) == len(found)
        edges = [(x, y) for x, y in forest(p, bits, radius, within).tolist()]
        assert union_find(edges) == union_find(sorted(got))


def test_a_tree_over_words_equal_in_its_bits():
    p = np.arange(3000, dtype=np.uint64)
    far = np.bitwise_count(p[:, None] ^ p)
    found = sum(len(a) for a, _ in VantageTree(p, ((1 << 22) - 1) << 42, 0, 1).pairs())
    assert found == (np.triu(far == 1)).sum()


def test_trees_prune_and_visit_over_boundaries(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    p = np.unique(np.array([fingerprint(r.text or "") for r in docs.select("text").collect()], np.uint64))
    for bits, radius in views(4):
        tree = VantageTree(p, bits, radius, 4)
        list(tree.pairs())
        assert tree.inner > 20 and tree.leaves > 20 and tree.compared < len(p) ** 2 / 8
        assert (tree.visits > 0 and tree.boundary > 0) == (radius > 0)


@pytest.mark.parametrize("most", [1 << 15, 300])
def test_shards_join_what_all_pairs_join(spark, most):
    rng = random.Random(most)
    points = near_points(1500, rng)
    hot = rng.getrandbits(64)
    points = list({*points, *(hot ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400))})
    fps = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in points], "fp long")
    got = [(r.a % 2**64, r.b % 2**64) for r in links(fps, most=most).collect()]
    assert union_find(got) == union_find(all_links(points))
    held = shards(fps, most=most).groupBy("view", "shard").count().collect()
    copies = sum(r["count"] for r in held) - 3 * len(points)
    assert (copies == 0 and len(held) == 3) if most > len(points) else (copies > 0 and len(held) > 6)


def test_rows_of_shards_grow_in_proportion(spark):
    """Five times the fingerprints are five times the rows, and trees of the shards still join what all pairs join."""
    rng = random.Random(5)
    points = list({rng.getrandbits(64) for _ in range(7000)} | {*near_points(3000, rng)})
    rng.shuffle(points)
    held = {}
    for n in (2000, 10_000):
        fps = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in points[:n]], "fp long")
        held[n] = shards(fps, most=500).count()
    assert held[10_000] <= 5.5 * held[2000] * len(points[:10_000]) / 10_000
    got = [(r.a % 2**64, r.b % 2**64) for r in links(fps, most=500).collect()]
    assert union_find(got) == union_find(all_links(points[:10_000]))


@pytest.mark.parametrize("within", range(9))
def test_a_pair_within_the_radius_is_equal_over_a_piece(within):
    rng = random.Random(within)
    for bits, radius in views(within):
        own = [i for i in range(64) if bits >> i & 1]
        parts = pieces(bits, radius)
        assert sum(parts) == bits and all(parts)
        assert all(any(not apart & part for part in parts) for apart in (sum(1 << i for i in rng.sample(own, radius)) for _ in range(200)))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    prints = {r.doc_id: plain(r.text or "") for r in docs.select("doc_id", "text").collect()}
    root = union_find(all_links(sorted(set(prints.values()))))
    least = {}
    for i, p in prints.items():
        c = root.get(p, p)
        least[c] = min(i, least.get(c, i))
    got = near_duplicates(docs).collect()
    assert len(got) == len(prints)
    assert all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", least[root.get(prints[r.doc_id], prints[r.doc_id])]) for r in got)


def test_odd_rows(docs_of):
    df = docs_of(ODD * 2).withColumns({c: F.lit("x") for c in ("fp", "shard", "first", "root", "label")})
    rows = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert len(rows) == 2 * len(ODD)
    assert all(rows[i].component_id == rows[i + len(ODD)].component_id <= i for i in range(len(ODD)))
    assert rows[0].fingerprint == rows[2].fingerprint == "0" * 16 and rows[2].component_id == 0
    assert near_duplicates(docs_of([])).collect() == []
