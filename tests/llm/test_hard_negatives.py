import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every, positives=5, negatives=10):
    """Every anchor with every row, one after another."""
    sound = [(i, [math.floor(256 * np.float32(x).item()) for x in v], label) for i, v, label, *_ in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, q, label) in enumerate(sound):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, o, strict=True)), i is None, i or 0, i, of) for k, (i, o, of) in enumerate(sound) if k != a and len(o) == len(q)]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == label][:positives]:
            fit = [s for s in scored if s[4] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]]
            out += [(anchor, p[3], r, s[3], -p[0], -s[0]) for r, s in enumerate(fit[:negatives], 1)]
    return sorted(out, key=str)


def found(spark, rows, every, **more):
    df = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **more)
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(n, dim, seed, labels=4, grain=None):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = centres[label] * 0.5 + centres[(label + 1) % labels] * 0.35 + rng.standard_normal(dim) * 0.5
        v = v / np.linalg.norm(v)
        if grain:
            v = np.round(v * grain) / grain
        rows.append((i, [float(x) for x in v.astype(np.float32)], label, "clash", "clash"))
    return rows


def test_planes_give_products():
    rng = np.random.default_rng(5)
    for dim in (0, 1, 63, 64, 65, 130):
        q = rng.integers(-(10**6), 10**6, (40, dim))
        planes = hn.sliced(q)
        some, score = hn.narrowed(planes, planes[:, :, 3], np.arange(40), lambda low, high: np.ones(len(low), bool))
        assert (score == q @ q[3]).all() and len(some) == 40


def test_intervals_hold_the_score_and_drop_early():
    rng = np.random.default_rng(6)
    q = rng.integers(-250, 250, (3000, 64))
    planes, exact, sizes = hn.sliced(q), q @ q[0], []
    keep = hn.among_best(5)

    def stays(low, high):
        sizes.append(len(low))
        return keep(low, high)

    some, score = hn.narrowed(planes, planes[:, :, 0], np.arange(3000), stays)
    assert (score == exact[some]).all() and set(np.argsort(-exact)[:5]) <= set(some.tolist())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < 300


@pytest.mark.parametrize("grain", [None, 4])
def test_against_all_pairs(spark, grain):
    rows = made(400, 24, 7, grain=grain)  # a grain makes many ties
    want = plain(rows, 20)
    assert want and found(spark, rows, 20, block_rows=50, anchor_rows=6) == want


def test_nulls_repeats_and_odd_vectors(spark):
    rows = made(60, 6, 9)
    v = rows[0][1]
    rows += [(0, v, 0, None, None)] * 3 + [(None, v, 1, None, None), (None, v, 0, None, None), (10, None, 1, None, None), (20, v, None, None, None)]
    rows += [(30, [*v[:5], None], 1, None, None), (40, [*v[:5], float("nan")], 1, None, None), (50, [*v[:5], float("inf")], 1, None, None)]
    rows += [(70, [0.0] * 6, 1, None, None), (80, [], 1, None, None), (90, [], 2, None, None), (100, [], 1, None, None), (110, [1.0, 2.0], 1, None, None), (120, [1.0, 2.0], 1, None, None), (121, [0.5, 1.0], 3, None, None)]
    want = plain(rows, 10)
    assert any(r[3] is None for r in want) and any(r[0] == 110 for r in want) and any(r[0] == 80 for r in want)
    assert found(spark, rows, 10, least_blocks=3) == want


def test_one_vector_in_a_third_of_the_rows(spark):
    rows = made(200, 16, 11)
    rows += [(1000 + i, rows[3][1], rows[3][2], None, None) for i in range(100)] + [(2000 + i, rows[4][1], rows[4][2], None, None) for i in range(50)]
    assert found(spark, rows, 25, block_rows=64) == plain(rows, 25)


def test_huge_components_do_not_overflow(spark):
    rows = [(0, [3e38, 0.0], 1, None, None), (1, [3e38, 0.0], 1, None, None), (2, [1.0, 0.0], 2, None, None), (3, [-3e38, 1.0], 2, None, None)]
    assert found(spark, rows, 100) == []


def test_empty_and_no_anchor(spark):
    assert found(spark, [], 100) == []
    assert found(spark, made(20, 4, 1)[1:], 1000) == []


def test_query_against_its_sql(spark, sf):
    import duckdb

    from alertlake.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_hard_negatives']})").fetchall()
    got = [tuple(r) for r in QUERIES["op11_hard_negatives"](spark, sf).select(*COLUMNS).collect()]
    assert want and sorted(got) == sorted(want)
