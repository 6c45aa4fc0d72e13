"""Near-duplicate vectors by counting collisions on sorted projections.

Vectors are laid on many random lines. Around each vector a window is opened on each line,
and the number of windows that another falls in is its count of collisions. The window and
the count asked for are set from the threshold: a pair at the threshold falls within
`spread` deviations on a line with a known chance, so the count that nearly all such pairs
reach is a quantile of the binomial. Pairs that reach it are verified in double precision.

So that not all pairs of a label meet, cells of vectors are split at the median of one line
after another, down to `most` rows; what lies above the median by no more than the window
is also copied below it. Copies carry the levels at which they were made, so that each
pair is counted in one cell only. A cell that no line splits (a tight group) is worked in
blocks of rows, pair by pair of blocks. Equal vectors are one, with a number of copies.
"""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.components import components
from alertlake.llm.shared import cut

LINES = 16
SPREAD = 2.5
RECALL = 0.995


def window_of(threshold: float, dim: int, spread: float = SPREAD) -> float:
    """Half the window: a pair at the threshold is sqrt(2 - 2 cos) apart, on a line about that over sqrt(dim)."""
    return spread * math.sqrt(max(0.0, 2 - 2 * threshold) / dim)


def count_asked(lines: int = LINES, spread: float = SPREAD, recall: float = RECALL) -> int:
    """The greatest count that a pair at the threshold reaches with the chance `recall`."""
    p = 2 * NormalDist().cdf(spread) - 1
    reach = 0.0
    for least in range(lines, 0, -1):
        reach += math.comb(lines, least) * p**least * (1 - p) ** (lines - least)
        if reach >= recall:
            return least
    return 0


@cache
def directions(dim: int, turn: int = 0, lines: int = LINES) -> np.ndarray:
    found = np.random.default_rng([dim, lines, turn]).standard_normal((dim, lines))
    return found / np.linalg.norm(found, axis=0)


def projections(vector: Column, turn: int = 0) -> Column:
    """Where a vector of length one in its direction lies on each line; each turn has lines of its own."""

    @F.pandas_udf("array<float>")
    def on_lines(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            v = np.asarray(v, float)
            v = v / np.abs(v).max()
            out.append((v / np.linalg.norm(v) @ directions(len(v), turn)).astype(np.float32))
        return pd.Series(out)

    return on_lines(vector)


def usable(vector: Column) -> Column:
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, sound) & F.exists(vector, lambda x: x != 0), F.lit(False))


def linked_in_cell(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(node, links, root) of the vectors linked in a cell: copies linked to, and a node of the same component."""
    n, asked = len(frame), count_asked()
    lines = np.stack(frame["p"].to_numpy())
    vectors = np.stack([np.asarray(v, float) for v in frame["v"]])
    norms = np.sqrt((vectors**2).sum(axis=1))
    node, copies, made, part = (frame[c].to_numpy() for c in ("node", "copies", "made", "part"))
    across = frame["lo"].iat[0] != frame["hi"].iat[0]
    half = np.float32(window_of(threshold, vectors.shape[1]))
    order = np.argsort(lines, axis=0, kind="stable")
    ranked = np.take_along_axis(lines, order, axis=0)
    low = np.stack([np.searchsorted(ranked[:, k], lines[:, k] - half, "left") for k in range(lines.shape[1])])
    high = np.stack([np.searchsorted(ranked[:, k], lines[:, k] + half, "right") for k in range(lines.shape[1])])
    order = np.ascontiguousarray(order.T)
    tally, root = np.zeros(n, np.int64), np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        hits = np.zeros(n, np.int8)
        for k in range(len(order)):
            hits[order[k, low[k, i] : high[k, i]]] += 1
        hits[: i + 1] = 0
        met = np.flatnonzero((hits >= asked) & (made & made[i] == 0) & ((part != part[i]) if across else True))
        if len(met):
            met = met[vectors[met] @ vectors[i] / (norms[met] * norms[i]) >= threshold]
            tally[i] += copies[met].sum()
            tally[met] += copies[i]
            for j in {top(int(j)) for j in met}:
                root[j] = top(i)
    kept = np.flatnonzero(tally)
    return pd.DataFrame({"node": node[kept], "links": tally[kept], "root": node[[top(int(i)) for i in kept]]})


def cells(points: DataFrame, threshold: float, most: int) -> DataFrame:
    """(node, cell, made): points split along lines until cells hold `most` rows or no line splits them.

    After LINES lines new ones are drawn. It ends when LINES lines one after another split no
    cell, or when `made` has no bit left (62 splits of a cell).
    """
    state = points.select("node", "dim", "p", F.xxhash64("label", "dim").alias("cell"), F.lit(0).cast("long").alias("made"))
    idle = 0
    for level in range(62):
        turn, line = divmod(level, LINES)
        if turn and not line:
            fresh = cut(points.select("node", projections(F.col("v"), turn).alias("p")), "projections")
            state = cut(state.drop("p").join(fresh, "node"), "cells")
        at = F.get("p", F.lit(line))
        stats = state.groupBy("cell", "dim").agg(F.count("*").alias("n"), F.percentile_approx(at, [0.5, 0.75], 1000).alias("q"))
        half = F.lit(window_of(threshold, 1)) / F.sqrt("dim")
        stats = stats.where(F.col("n") > most).select("cell", "n", F.col("q")[0].cast("double").alias("median"), (F.col("q")[0] + half).alias("edge"), F.col("q")[1].alias("upper"))
        stats = cut(stats, "cell-sizes")
        if stats.isEmpty():
            break
        split = stats.where("upper > edge").select("cell", "median", "edge")
        if split.isEmpty():
            idle += 1
            if idle == LINES:
                break
            continue
        idle = 0
        child = lambda above: F.struct(F.xxhash64("cell", F.lit(level), F.lit(above)).alias("cell"), F.col("made"))
        copied = F.struct(F.xxhash64("cell", F.lit(level), F.lit(0)).alias("cell"), F.col("made").bitwiseOR(F.lit(1 << level)).alias("made"))
        to = F.when(F.col("median").isNull(), F.array(F.struct("cell", "made"))).when(at <= F.col("median"), F.array(child(0))).when(at <= F.col("edge"), F.array(child(1), copied)).otherwise(F.array(child(1)))
        state = cut(state.join(split, "cell", "left").select("node", "dim", "p", F.explode(to).alias("to")).select("node", "dim", "p", "to.cell", "to.made"), "cells")
    return state.select("node", "cell", "made")


def near_vectors(embeddings: DataFrame, threshold: float = 0.98, most: int = 2048) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Vectors are compared only where labels and lengths are equal and the label isn't null.
    A vector that is null, empty, all zeros or holds a null or a non-finite component links
    with nothing and is kept. Every link found has a cosine of `threshold` or more; about
    RECALL of those at the threshold are found, and nearly all that are closer. Equal
    vectors are all found. Rows that repeat a vec_id are vectors of their own, linked and
    counted each; component_id is the least vec_id that links reach, and all rows with that
    id are kept. A null vec_id is after all others. Other columns are ignored; an empty table
    gives none. Labels and vectors are told apart by 128 bits of hash.
    """
    rows = embeddings.select("vec_id", "label", F.col("embedding").alias("v")).withColumn("usable", usable(F.col("v")) & F.col("label").isNotNull())
    keyed = rows.where("usable").withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    distinct = keyed.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    points = distinct.withColumns({"node": F.xxhash64("label", "k1", "k2"), "dim": F.size("v")})
    points = cut(points.withColumn("p", projections(F.col("v"))), "points")
    placed = cells(points, threshold, most)
    placed = cut(placed, "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.select("node", "cell", "made", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("node", "cell", "made", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).join(points.select("node", "copies", "v", "p"), "node")
    found = cut(dealt.groupBy("cell", "lo", "hi").applyInPandas(lambda frame: linked_in_cell(frame, threshold), "node long, links long, root long"), "links")
    tally = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = cut(points.select("label", "k1", "k2", "node", "first", "copies").join(tally, "node", "left").join(labels.withColumnRenamed("label", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    told = rooted.join(least, "root").select("label", "k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = keyed.select("vec_id", "label", "k1", "k2").join(cut(told, "told"), ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
