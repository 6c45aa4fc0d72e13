import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlake.llm.near_vectors import count_asked, near_vectors, window_of

from .test_components import brute as union_find

SCHEMA = "vec_id long, embedding array<float>, label int"


def all_links(rows, threshold=0.98):
    out = []
    sound = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows if y is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for y in {y for *_, y in sound}:
        for dim in {len(v) for _, v, z in sound if z == y}:
            own = [(i, v) for i, v, z in sound if z == y and len(v) == dim]
            m = np.stack([v for _, v in own])
            c = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
            out += [(own[a][0], own[b][0]) for a, b in zip(*np.nonzero(np.triu(c >= threshold, 1)), strict=True)]
    return out


def made(n, rng, dim=64):
    rows = []
    while len(rows) < n:
        base, label = rng.standard_normal(dim), int(rng.integers(3))
        for _ in range(rng.choice([1, 1, 1, 4, 30])):
            noise = rng.standard_normal(dim) * np.linalg.norm(base) / np.sqrt(dim)
            rows.append((len(rows), (base + rng.choice([0, 0.1, 0.18, 0.2]) * noise).astype(np.float32).tolist(), label))
    return rows[:n]


@pytest.mark.parametrize("most", [2048, 100])
def test_recall_and_no_false_link(spark, most):
    rows = made(1500, np.random.default_rng(most))
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA), most=most).collect()}
    want = all_links(rows)
    true = np.zeros(len(rows), int)
    for a, b in want:
        true[[a, b]] += 1
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()
    root = union_find(want)
    assert all(root.get(got[i].component_id, got[i].component_id) == root.get(i, i) for i in got)
    assert np.mean([got[i].component_id == root.get(i, i) for i in got]) > 0.97


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = all_links(rows)
    got = near_vectors(df).collect()
    assert len(got) == len(rows) and 0.9 * 2 * len(want) <= sum(r.n_links for r in got) <= 2 * len(want)


def test_tight_groups_and_copies_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    rows = [(i, (base + 0.001 * rng.standard_normal(64)).astype(np.float32).tolist(), 1) for i in range(400)] + [(400 + i, base.astype(np.float32).tolist(), 1) for i in range(200)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), most=64).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(599, 0)} and [r.vec_id for r in got if r.kept] == [0]


def test_odd_vectors(spark):
    one = [1.0] + [0.0] * 63
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [1.0] * 63]
    rows = [(i, v, 1) for i, v in enumerate(odd)] + [(10, one, None), (11, one, None), (12, one, 1), (13, one, 1), (14, one, 2), (15, one[:8], 1), (16, [2 * x for x in one], 1), (17, [-x for x in one], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("node", "copies", "cell", "p", "dim")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert len(got) == len(rows)
    assert got[12] == (2, 12, True) and got[13] == (2, 12, False) and got[16] == (2, 12, False)
    assert all(got[i] == (0, i, True) for i in got if i not in (12, 13, 16))
    assert near_vectors(df.limit(0)).collect() == []


def test_count_and_window():
    assert 0 < count_asked() <= 16 and count_asked(recall=0.5) >= count_asked(recall=0.999)
    assert window_of(0.98, 64) == pytest.approx(2.5 * 0.025)


def test_rows_that_repeat_an_id(spark):
    one = np.eye(8, dtype=np.float32).tolist()
    rows = [(7, one[0], 1), (7, one[1], 1), (3, one[0], 1), (9, one[1], 1), (None, one[1], 1), (7, None, 1), (None, one[2], 1)]
    got = sorted(map(str, map(tuple, near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())))
    want = [(7, 1, 3, False), (3, 1, 3, True), (7, 2, 7, True), (9, 2, 7, False), (None, 2, 7, False), (7, 0, 7, True), (None, 0, None, True)]
    assert got == sorted(map(str, want))


def test_cells_split_on_after_the_first_lines(spark, monkeypatch):
    """With two lines a turn, cells need lines of later turns; few pairs are lost."""
    from alertlake.llm import near_vectors as module

    rows = made(900, np.random.default_rng(11))
    turns = []
    monkeypatch.setattr(module, "LINES", 2)
    plain = module.projections
    monkeypatch.setattr(module, "projections", lambda v, turn=0: turns.append(turn) or plain(v, turn))
    points = spark.createDataFrame(rows, SCHEMA).select("vec_id", F.col("vec_id").alias("node"), "label", F.col("embedding").alias("v"))
    points = points.withColumns({"dim": F.size("v"), "p": plain(F.col("v"))}).cache()
    placed = module.cells(points, 0.98, 60).collect()
    assert max(turns) >= 1 and {r.node for r in placed} == set(range(900))
    of = {}
    for r in placed:
        of.setdefault(r.node, set()).add(r.cell)
    met = [bool(of[a] & of[b]) for a, b in all_links(rows)]
    assert np.mean(met) >= 0.97 and len(placed) > 900
