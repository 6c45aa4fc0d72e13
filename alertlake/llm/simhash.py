"""SimHash near-duplicates through vantage-point trees.

Fingerprints within 4 bits of each other are linked, exactly. Over all 64 bits a tree prunes
little at this radius (unrelated fingerprints lie at 32 +- 4), so there is a tree over each
third of the bits: two words within 4 bits of each other differ by 1 bit at most in one of
the first two thirds, or not at all in the last. Distance over a third of the bits obeys the
triangle inequality as well, and there the ball of radius 1 touches few rings.

In Spark, fingerprints too many for a task are dealt by pieces of a view's bits: words within
radius r are equal over one of r + 1 pieces, so five rows a fingerprint do, at any size. A
shard still too large is split by Hamming distance from vantage points, some of its own
fingerprints, each in two; what lies outside but no farther than the radius from the boundary
is copied inside, so a pair near enough meets in one shard. In a task every shard becomes a
vantage-point tree, whatever its size; all its fingerprints go down the tree together, each
into the branches that its ball touches by the triangle inequality.

Trees return a spanning forest of their links, so a group of n near copies costs n edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.components import components
from alertlake.llm.shared import cut, remove

SEED = 42
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALL_BITS = 2**64 - 1
THIRDS = ((1 << 21) - 1, ((1 << 21) - 1) << 21, ((1 << 22) - 1) << 42)
LEAF = 16  # members of a tree's leaf
#: What a ring leaves of a shard, copies counted; rings that a round draws at most for a shard.
SHRINKS, MOST_RINGS = 0.585, 12
AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of a whole text over the XXH64 of its shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def views(within: int) -> list[tuple[int, int]]:
    """(bits, radius) of each tree: words within `within` bits are within the radius over the bits of one view at least.

    If a pair differed by more than the radius in every view, it would differ by the radii's
    sum and 3 more, which is `within` + 1.
    """
    over = max(0, within - 2)
    return [(bits, over // 3 + (i < over % 3)) for i, bits in enumerate(THIRDS)]


class VantageTree:
    """A vantage-point tree over distinct fingerprints, by their distance over `bits`.

    A node whose members are all equal over `bits` is split over all 64 bits with the radius
    `within`: there they differ, so every node of more than LEAF members is split.
    """

    def __init__(self, points: np.ndarray, bits: int, radius: int, within: int):
        self.points, self.bits, self.radius, self.within = points, np.uint64(bits), radius, within
        # What a search met: nodes, rows asked for from outside a node, rows copied over a boundary, distances taken.
        self.inner = self.leaves = self.visits = self.boundary = self.compared = 0

    def _split(self, members: np.ndarray):
        """vantage, bits, ball, ring, and how far members are from the vantage point."""
        vantage, bits, ball = self.points[members[0]], self.bits, self.radius
        away = np.bitwise_count((self.points[members] ^ vantage) & bits)
        if not away.any():
            bits, ball = np.uint64(ALL_BITS), self.within
            away = np.bitwise_count(self.points[members] ^ vantage)
        ring = min(int(np.median(away)), int(away.max()) - 1)
        return vantage, bits, ball, ring, away

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a, b): pairs of rows within `within` bits; all that lie within the radius over the view's bits are among them.

        Members go down with their node. A member outside the ring visits the inside too if
        its ball reaches there; those inside needn't visit the outside, for they are met.
        """
        empty, open_ = np.empty(0, np.int64), [(np.arange(len(self.points)), np.empty(0, np.int64))]
        while open_:
            members, visitors = open_.pop()
            if len(members) <= LEAF:
                self.leaves += 1
                asking = np.concatenate([members, visitors])
                near = np.bitwise_count(self.points[asking][:, None] ^ self.points[members]) <= self.within
                self.compared += near.size
                near[: len(members)] &= np.tri(len(members), k=-1, dtype=bool)
                a, b = np.nonzero(near)
                if len(a):
                    yield asking[a], members[b]
                continue
            self.inner += 1
            vantage, bits, ball, ring, away = self._split(members)
            inside, reaches = away <= ring, (away > ring) & (away <= ring + ball)
            across = np.bitwise_count((self.points[visitors] ^ vantage) & bits) if len(visitors) else empty
            self.visits += len(visitors)
            self.boundary += int(reaches.sum())
            open_.append((members[inside], np.concatenate([visitors[across <= ring + ball], members[reaches]])))
            open_.append((members[~inside], visitors[across > ring - ball]))


class Forest:
    """Keeps the edges that join two trees of a forest over n rows."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def joining(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        apart, out = self.up[a] != self.up[b], []
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = self._top(i), self._top(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append((i, j))
        return out


def forest(points: np.ndarray, bits: int, radius: int, within: int) -> np.ndarray:
    """Edges (rows a, b) of a spanning forest of the pairs that the tree over distinct points finds."""
    joined, edges = Forest(len(points)), []
    for a, b in VantageTree(points, bits, radius, within).pairs():
        edges += joined.joining(a, b)
    return np.array(edges, np.int64).reshape(-1, 2)


def shard_links(rows: DataFrame, within: int) -> DataFrame:
    """(shard, view, fp) -> (a, b): a spanning forest of the links in each shard."""
    seen = views(within)

    def links(shard: np.ndarray, view: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            points = np.unique(fp[low:high])
            found = points[forest(points, *seen[view[low]], within)].view(np.int64)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, view, fp = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64)
        for batch in batches:
            shard = np.concatenate([shard, batch.column(0).to_numpy()])
            view = np.concatenate([view, batch.column(1).to_numpy()])
            fp = np.concatenate([fp, batch.column(2).to_numpy().view(np.uint64)])
            done = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0  # the last shard may go on
            if done:
                yield from links(shard[:done], view[:done], fp[:done])
            shard, view, fp = shard[done:], view[done:], fp[done:]
        if len(shard):
            yield from links(shard, view, fp)

    return rows.select("shard", "view", "fp").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def signed(word: int) -> int:
    return word - 2**64 if word >= 2**63 else word


def of_view(values: list[int]) -> Column:
    """The value of the row's view."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("view") + 1)


def pieces(bits: int, radius: int) -> list[int]:
    """The bits in `radius` + 1 pieces: words within the radius are equal over one piece at least."""
    own = [1 << i for i in range(64) if bits >> i & 1]
    return [sum(own[i * len(own) // (radius + 1) : (i + 1) * len(own) // (radius + 1)]) for i in range(radius + 1)]


def shards(fps: DataFrame, within: int = 4, most: int = 1 << 15) -> DataFrame:
    """(shard, view, fp): distinct fingerprints, a shard a view, or dealt until a shard has `most` at most.

    More than `most` are dealt by the hashed pieces of a view's bits to shards of half of
    `most` on average: a row for each piece, whatever the number of fingerprints, and a pair
    within the radius meets where a piece is equal. Shards that are too large still, with
    very many words alike, are split by rings around vantage points. A round splits each by
    as many as its size asks for, all in one pass: a fingerprint goes to the shard of the
    sides on which it lies, and over each boundary within the radius to the inside too.
    Rings are medians of distances; one that leaves less than a tenth outside is not used,
    and shards without any stay as they are. A pair within the radius of a view meets in a
    shard of it. Only rows of shards that are split pass through a round.
    """
    seen, n = views(within), fps.count()
    if n <= most:
        return fps.select(F.explode(F.array(*[F.lit(v) for v in range(len(seen))])).alias("view"), "fp").select(F.col("view").cast("long").alias("shard"), "view", "fp")
    dealt = lambda v, piece: F.pmod(F.xxhash64(F.lit(v), F.lit(signed(piece)), F.col("fp").bitwiseAND(F.lit(signed(piece)))), F.lit(math.ceil(2 * n / most)))
    to = [F.struct(F.lit(v).alias("view"), F.xxhash64(F.lit(v), F.lit(signed(piece)), dealt(v, piece)).alias("shard")) for v, (bits, radius) in enumerate(seen) for piece in pieces(bits, radius)]
    state = cut(fps.select("fp", F.explode(F.array(*to)).alias("to")).select("to.shard", "to.view", "fp"), "shards")
    settled: list[DataFrame] = []
    while True:
        sizes = cut(state.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most), "large-shards")
        largest = sizes.agg(F.max("n")).first()[0]
        if largest is None:
            return reduce(DataFrame.union, settled, state)
        asked = lambda n: min(MOST_RINGS, math.ceil(math.log(n / most) / math.log(1 / SHRINKS)))
        rings = range(max(1, asked(largest)))
        known = state.join(sizes, "shard").groupBy("shard", "n").agg(*[F.min_by("fp", F.xxhash64("fp", "shard", F.lit(k))).alias(f"v{k}") for k in rings])
        known = cut(known, "vantage-points")
        bits, ball = of_view([signed(b) for b, _ in seen]), of_view([r for _, r in seen]).cast("int")
        away = lambda vantage, bits: F.bit_count(F.col("fp").bitwiseXOR(vantage).bitwiseAND(bits))
        spread = state.join(known, "shard").groupBy("shard", "view", "n", *[f"v{k}" for k in rings])
        spread = spread.agg(*[F.percentile_approx(away(F.col(f"v{k}"), bits), [0.5, 0.9], 1000).alias(f"q{k}") for k in rings])
        wanted = F.ceil(F.log(F.col("n") / most) / math.log(1 / SHRINKS))
        ring = lambda k: F.when((F.lit(k) < wanted) & (F.col(f"q{k}")[0] + ball < F.col(f"q{k}")[1]), F.struct(F.col(f"v{k}").alias("vantage"), F.col(f"q{k}")[0].alias("ring")))
        split = spread.select("shard", F.filter(F.array(*[ring(k) for k in rings]), lambda r: r.isNotNull()).alias("rings"))
        split = cut(split.where(F.size("rings") > 0), "rings")
        if split.isEmpty():
            return reduce(DataFrame.union, settled, state)
        side = lambda s, r, outside: F.xxhash64(s, r["vantage"], F.lit(outside))

        def sides(paths: Column, r: Column) -> Column:
            d = away(r["vantage"], F.col("bits"))
            return F.flatten(F.transform(paths, lambda s: F.when(d <= r["ring"], F.array(side(s, r, 0))).when(d <= r["ring"] + F.col("ball"), F.array(side(s, r, 1), side(s, r, 0))).otherwise(F.array(side(s, r, 1)))))

        met = state.join(split, "shard").withColumns({"bits": bits, "ball": ball})
        settled.append(state.join(split, "shard", "left_anti").select("shard", "view", "fp"))
        state = cut(met.select(F.explode(F.aggregate("rings", F.array("shard"), sides)).alias("shard"), "view", "fp"), "shards")
        remove(fps.sparkSession, sizes, known)


def links(fps: DataFrame, within: int = 4, most: int = 1 << 15) -> DataFrame:
    """(a, b) edges that join exactly the components of distinct fingerprints within `within` bits."""
    dealt = shards(fps, within, most)
    # A shard that rings can't split is dealt by pairs of parts, a tree for each pair; rows of others stay out of it.
    sizes = cut(dealt.groupBy("shard").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1"), "unsplit-shards")
    if sizes.isEmpty():
        return shard_links(dealt, within)
    parted = dealt.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    paired = parted.select("fp", "view", "shard", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    paired = paired.select(F.xxhash64("shard", F.least("part", "other"), F.greatest("part", "other")).alias("shard"), "view", "fp")
    return shard_links(dealt.join(sizes, "shard", "left_anti").select("shard", "view", "fp").union(paired), within)


def near_duplicates(docs: DataFrame, shingle: int = 4, within: int = 4, most: int = 1 << 15) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id that links reach, its own included. A null text counts
    as empty; a text without words has fingerprint zero and is linked like any other; one
    with fewer words than a shingle is one shingle; rows that repeat a doc_id are each in a
    component of that id. Other columns are ignored; an empty table gives none.
    """
    own = cut(fingerprints(docs, shingle), "fingerprints")
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = components(links(nodes.select("fp"), within, most))
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("root"))
    rooted = cut(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = cut(rooted.join(least, "root").select("fp", "component_id"), "components")
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
