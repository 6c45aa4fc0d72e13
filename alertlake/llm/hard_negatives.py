"""Hard negatives by bit-sliced integer products.

Vectors are whole numbers (floor of 256 x) kept as bit-planes: bit j of all components of a
vector is a row of 64-bit words. The inner product with an anchor is a sum over planes of
2**j times the product with that plane, which counts common bits of the plane and the
anchor's own planes. Planes are taken from the most significant down. What the planes not
yet taken can add lies between (2**j - 1) times the sum of the anchor's negative components
and as much of its positive ones, so each plane halves the interval in which a score lies.
A candidate whose interval can no longer reach what is asked is dropped and costs no more
planes; after the last plane the scores left are exact.

It takes two passes. The first finds each anchor's positives: candidates whose upper end
falls below the k-th best lower end go. Their scores set the windows of the second, over
rows of other labels: a candidate stays while some window may hold it and may still want it.

Rows are dealt into blocks by their number, whatever their label or value, and packed once;
anchors are packed in blocks of their own. Each pair of blocks is a group of one row a side,
whose best few rows an anchor are ranked again over all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.shared import cut

SCALE = 256
PACKED = "dim int, block int, rows array<long>, ids array<long>, labels array<long>, wanted array<array<long>>, planes binary"
POSITIVES = "row long, id long, score long"
NEGATIVES = "row long, place int, id long, score long"
MOST_TASKS = 4096


def sound(vector: Column) -> Column:
    """Whether a vector has finite components only."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(vectors: list, dim: int) -> np.ndarray:
    """floor(256 x), held to what keeps every product of two vectors within 2**60."""
    bound = math.isqrt(2**60 // max(1, dim))
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * np.array(vectors, float).reshape(len(vectors), dim))
    return np.clip(scaled, -bound, bound).astype(np.int64)


def sliced(q: np.ndarray) -> np.ndarray:
    """Two's complement bit-planes, least first: planes x words x vectors."""
    n, dim = q.shape
    high = int(np.where(q < 0, ~q, q).max(initial=0)).bit_length() + 1
    words = -(-dim // 64)
    out = np.zeros((high, words, n), np.uint64)
    for j in range(high):
        bits = np.zeros((n, words * 64), np.uint8)
        bits[:, :dim] = (q >> j) & 1
        out[j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T
    return out


def weights(planes: int) -> np.ndarray:
    signed = 2 ** np.arange(planes, dtype=np.int64)
    signed[-1] *= -1
    return signed


def product(plane: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of an anchor (its planes x words) with one plane (words x vectors) of candidates."""
    out = np.zeros(plane.shape[1], np.int64)
    for own, weight in zip(anchor, weights(len(anchor)), strict=True):
        for word, other in zip(own, plane, strict=True):
            if word:
                out += weight * np.bitwise_count(other & word)
    return out


def narrowed(planes: np.ndarray, anchor: np.ndarray, some: np.ndarray, stays: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows `some`, those that `stays` (from lower and upper ends) keeps to the last plane, and their exact scores."""
    bits = np.unpackbits(np.ascontiguousarray(anchor).view(np.uint8).reshape(len(anchor), -1), axis=1, bitorder="little").astype(np.int64)
    q = weights(len(anchor)) @ bits
    below, above = int(np.minimum(q, 0).sum()), int(np.maximum(q, 0).sum())
    score = np.zeros(len(some), np.int64)
    for j in range(len(planes) - 1, -1, -1):
        score += weights(len(planes))[j] * product(planes[j][:, some], anchor)
        kept = stays(score + (2**j - 1) * below, score + (2**j - 1) * above)
        if not kept.all():
            some, score = some[kept], score[kept]
    return some, score


def among_best(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Stays: may be among the k best."""

    def stays(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(low), bool)

    return stays


def in_windows(windows: list[tuple[int, int]], k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Stays: may be among the k best of some window."""

    def stays(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(low), bool)
        for least, most in windows:
            sure = low[(low >= least) & (high <= most)]
            floor = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else least
            kept |= (high >= floor) & (low <= most)
        return kept

    return stays


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -score))[:k]


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(row, id, label, wanted, v) -> a row for each length of vector and block, its rows in the order of their labels."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, block = (k.as_py() for k in key)
        labels = table["label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        planes = sliced(whole(table["v"].to_pylist(), dim)[order])
        ids, wanted = table["id"].take(order), table["wanted"].take(order)
        one = {"dim": [dim], "block": [block], "rows": [table["row"].to_numpy()[order]], "ids": [ids.to_pylist()], "labels": [labels[order]], "wanted": [wanted.to_pylist()], "planes": [planes.tobytes()]}
        kinds = {"dim": pa.int32(), "block": pa.int32(), "planes": pa.binary(), "wanted": pa.list_(pa.list_(pa.int64()))}
        return pa.table({c: pa.array(x, kinds.get(c, pa.list_(pa.int64()))) for c, x in one.items()})

    dealt = rows.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")})
    return dealt.groupBy("dim", "block").applyInArrow(run, PACKED)


NO_ID = 2**63 - 1  # stands for a null id in ties: after any other


class Block:
    """A packed block, opened."""

    def __init__(self, table: pa.Table):
        row = {c: table[c][0] for c in ("dim", "rows", "ids", "labels", "wanted", "planes")}
        self.rows, self.labels = row["rows"].values.to_numpy(), row["labels"].values.to_numpy()
        self.ids, self.wanted = row["ids"].values, row["wanted"].values
        self.order = np.array([NO_ID if i is None else i for i in self.ids.to_pylist()], np.int64)
        words = -(-row["dim"].as_py() // 64)
        flat = np.frombuffer(row["planes"].as_py(), np.uint64)
        self.planes = flat.reshape(-1, words, len(self.rows)) if words else np.zeros((1, 0, len(self.rows)), np.uint64)


def met(anchors: DataFrame, others: DataFrame, per_pair: Callable[[Block, Block], pa.Table], schema: str) -> DataFrame:
    """per_pair() of every block of anchors with every block of others of the same length."""
    a_blocks, o_blocks = (t.agg(F.max("block")).first()[0] for t in (anchors, others))
    if a_blocks is None or o_blocks is None:
        return others.sparkSession.createDataFrame([], schema)
    pairs = (a_blocks + 1) * (o_blocks + 1)
    key = ["dim", "a", "o"]
    facing = lambda own, other, most: F.explode(F.sequence(F.lit(0), F.lit(most))).alias(other)
    left = anchors.select("*", F.col("block").alias("a"), facing("a", "o", o_blocks)).repartition(min(MOST_TASKS, pairs), *key)
    right = others.select("*", F.col("block").alias("o"), facing("o", "a", a_blocks)).repartition(min(MOST_TASKS, pairs), *key)

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(ours) or not len(theirs):
            return pa.schema([(c, pa.int32() if kind == "int" else pa.int64()) for c, kind in (x.split() for x in schema.split(", "))]).empty_table()
        return per_pair(Block(ours), Block(theirs))

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def label_ends(block: Block, label: int) -> tuple[int, int]:
    return int(np.searchsorted(block.labels, label, "left")), int(np.searchsorted(block.labels, label, "right"))


def positives_of(anchors: Block, others: Block, k: int) -> pa.Table:
    found: list[tuple] = []
    for i, (row, label) in enumerate(zip(anchors.rows.tolist(), anchors.labels.tolist(), strict=True)):
        some = np.arange(*label_ends(others, label))
        at, score = narrowed(others.planes, anchors.planes[:, :, i], some[others.rows[some] != row], among_best(k))
        top = best(score, others.order[at], k)
        found.append((np.full(len(top), row), at[top], score[top]))
    rows, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"row": rows, "id": others.ids.take(pa.array(at)), "score": score})


def negatives_of(anchors: Block, others: Block, k: int, low: int, high: int) -> pa.Table:
    found: list[tuple] = []
    for i, (row, label, wanted) in enumerate(zip(anchors.rows.tolist(), anchors.labels.tolist(), anchors.wanted.to_pylist(), strict=True)):
        start, stop = label_ends(others, label)
        some = np.concatenate([np.arange(start), np.arange(stop, len(others.rows))])
        windows = [(-(-low * s // 100), high * s // 100) for s in wanted]
        at, score = narrowed(others.planes, anchors.planes[:, :, i], some, in_windows(windows, k))
        for place, (least, most) in enumerate(windows):
            own = np.flatnonzero((score >= least) & (score <= most))
            own = own[best(score[own], others.order[at[own]], k)]
            found.append((np.full(len(own), row), np.full(len(own), place, np.int32), at[own], score[own]))
    rows, places, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"row": rows, "place": places, "id": others.ids.take(pa.array(at)), "score": score})


def hard_negatives(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = 8192, anchor_rows: int = 2048, least_blocks: int = 16) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` is a condition on vec_id, label and embedding. An anchor's positives are its best
    `positives` other rows of the same label by the product of floor(256 x); for each of them
    the best `negatives` rows of other labels whose score is low to high hundredths of the
    positive's are returned, ranked from 1. Ties go by vec_id, a null one after all others.
    Rows with a null label, a null vector, or a null or non-finite component take no part;
    vectors of another length than the anchor's are not compared with it; zero vectors take
    part. Rows that repeat a vec_id, or all of a row, are rows of their own. A component
    beyond what keeps products within 2**60 is held to that. Other columns are ignored; an
    empty table, or one without anchors, gives none.
    """
    sound_rows = embeddings.where(F.col("label").isNotNull() & sound(F.col("embedding")))
    kept = cut(sound_rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor")), "vectors")
    # Numbers of rows of a written table, in the order of its files: the same whenever they are read.
    rows = kept.withColumns({"row": F.monotonically_increasing_id(), "wanted": F.lit(None).cast("array<long>")})
    totals = kept.agg(F.count("*"), F.count_if("anchor")).first()
    others = cut(packed(rows, max(least_blocks, math.ceil(totals[0] / block_rows))), "blocks")
    a_blocks = max(1, math.ceil(totals[1] / anchor_rows))
    asking = cut(packed(rows.where("anchor"), a_blocks), "anchors")
    first = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    near = met(asking, others, lambda a, o: positives_of(a, o, positives), POSITIVES)
    near = cut(near.withColumn("place", first(["row"]) - 1).where(F.col("place") < positives), "positives")
    wanted = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("wanted"))
    ready = cut(packed(rows.where("anchor").drop("wanted").join(wanted, "row"), a_blocks), "anchors-with-windows")
    far = met(ready, others, lambda a, o: negatives_of(a, o, negatives, low, high), NEGATIVES)
    far = far.withColumn("rank", first(["row", "place"])).where(F.col("rank") <= negatives)
    told = near.join(rows.where("anchor").select("row", F.col("id").alias("anchor_id")), "row").select("row", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(told, ["row", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted(every: int = 7, labels: int = 10) -> Column:
    """The label, one further (cyclically) where vec_id is divisible by `every`."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))


def hard_negatives_sql() -> str:
    """The query's rows in DuckDB's SQL: every anchor with every row."""
    return """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
                   FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
        positives AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS place FROM scored WHERE same QUALIFY place <= 5)
        SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.r, p.place ORDER BY n.score DESC, n.id))::INTEGER AS rank,
               n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.r = p.r AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        QUALIFY rank <= 10
    """
