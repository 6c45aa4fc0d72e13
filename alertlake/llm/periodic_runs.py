"""Periodic runs of words: stretches that repeat with a period at least three times.

A document is a sequence of whole numbers, one for each distinct word. Its aligned blocks of
B words, B a power of two from 8 on, are keys of an automaton, and the document is searched
for them. An occurrence counts only at a distance that fits the block's scale, from B to
2 B - 1 words after it (from 1 for the smallest). That is enough: in a run of period q, at
least 24 and 3 q words long, an aligned block of the greatest B <= q (or of 8) begins within
the first B words and recurs q words on, still inside the run. Each seed, a place and a
distance, is extended word by word both ways as long as words that far apart are equal.

A block of B = 8 s words is a key of eight symbols, the names of its s-word pieces, and the
document is read once for each remainder of s, so automata take memory in proportion to the
document. Names double their length from scale to scale; a piece that occurs once can't lie
in a block that recurs, so such blocks are no keys, and where every piece occurs once the
search is over.

What is a run's smallest period: a multiple d of it is found too if the run is 3 d long, but
then on the same stretch, so the least distance found for a stretch is its smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = 8  # of a key
LEAST, TIMES = 24, 3  # words of a run, and of its period
BLANK = "[\\x20\\x09-\\x0D]+"
RUNS = "array<struct<start: long, length: long, period: long>>"
ROWS_AT_ONCE = 256


def numbered(words: list) -> np.ndarray:
    """A whole number for each distinct word."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of a and b are equal."""
    at, step, n = 0, 32, min(len(a), len(b))
    while at < n:
        same = a[at : min(n, at + step)] == b[at : min(n, at + step)]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + len(same), 2 * step
    return n


def extended(a: np.ndarray, at: int, distance: int, block: int) -> tuple[int, int]:
    """The stretch (start, end) around a seed whose words `distance` apart are equal."""
    before = reach(a[at - 1 :: -1] if at else a[:0], a[at + distance - 1 :: -1])
    after = reach(a[at + block :], a[at + block + distance :])
    return at - before, at + block + after + distance


def seeds(names: np.ndarray, repeated: np.ndarray, piece: int, n: int) -> np.ndarray:
    """(distance, place) of aligned blocks that recur at a distance of their scale, in order."""
    block = SYMBOLS * piece
    starts = np.arange(0, n - block + 1, block)
    symbols = starts[:, None] + piece * np.arange(SYMBOLS)
    possible = np.flatnonzero(repeated[symbols].all(axis=1))
    if not len(possible):
        return np.empty((0, 2), np.int64)
    automaton, kinds, kind_of = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}, [-1] * len(starts)
    for k, key in zip(possible.tolist(), map(tuple, names[symbols[possible]].tolist()), strict=True):
        if key not in kinds:
            kinds[key] = len(kinds)
            automaton.add_word(key, kinds[key])
        kind_of[k] = kinds[key]
    automaton.make_automaton()
    found, nearest = [], 1 if piece == 1 else block
    for rest in range(piece):
        for end, kind in automaton.iter(tuple(names[rest::piece].tolist())):
            place = rest + piece * (end - SYMBOLS + 1)
            for k in range((place - nearest) // block, max(-1, (place - 2 * block) // block), -1):
                if kind_of[k] == kind:
                    found.append((place - k * block, k * block))
    return np.array(sorted(found), np.int64).reshape(-1, 2)


def runs(a: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of a sequence, by start, then period."""
    n, piece, names = len(a), 1, a
    periods: dict[tuple[int, int], int] = {}
    owner_end, owner_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    while LEAST <= n and (piece == 1 or TIMES * SYMBOLS * piece <= n):
        repeated = np.bincount(names)[names] > 1
        if not repeated.any():
            break
        block, last = SYMBOLS * piece, {}
        some = seeds(names, repeated, piece, n)
        # Inside a known run a multiple of its period extends to that run again.
        known = (owner_end[some[:, 1]] >= some.sum(axis=1) + block) & (some[:, 0] % owner_period[some[:, 1]] == 0) & (block >= owner_period[some[:, 1]])
        for distance, at in some[~known].tolist():
            if at + block + distance <= last.get(distance, 0):
                continue
            if owner_end[at] >= at + distance + block and distance % owner_period[at] == 0 and block >= owner_period[at]:
                continue
            start, end = extended(a, at, distance, block)
            last[distance] = end
            if end - start >= max(LEAST, TIMES * distance):
                periods[start, end] = min(distance, periods.get((start, end), distance))
                wins = np.flatnonzero(owner_end[start:end] < end) + start
                owner_end[wins], owner_period[wins] = end, periods[start, end]
        if 2 * piece > n:
            break
        names = np.unique(names[:-piece] * n + names[piece:], return_inverse=True)[1]
        piece *= 2
    return sorted((s, e - s, q) for (s, e), q in periods.items())


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return edges[:n].cumsum() == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words long, runs array<struct<start, length, period: long>>, collapsed string, for every row.

    Words are `[^\\x20\\x09-\\x0D]+`, as they are, numbered from 0. A run is a stretch with
    smallest period q, of 24 and 3 q words at least, that no neighbouring word extends. In
    `collapsed` what a run holds after its first q words is taken out, and words are joined
    by one blank. A null or empty text has no words and collapses to an empty one; repeated
    rows and null ids are rows like others; other columns are ignored; an empty table gives
    none.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                some, out = batch.slice(at, ROWS_AT_ONCE), []
                for text in some.column(1):
                    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    found = runs(numbered(words))
                    left = [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()] if found else words
                    out.append((len(words), [{"start": s, "length": n, "period": q} for s, n, q in found], b" ".join(left).decode("utf-8", "surrogatepass")))
                n_words, found, collapsed = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x, kinds.field(k).type) for k, x in enumerate((n_words, found, collapsed), 1))], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs in which the tail of one document in ten, told by its doc_id's checksum, repeats its first words.

    With h the checksum and g = h div 10, words from a = g mod n on become those of the tail's
    first 1 + (n - a) div (3 + g mod 8) words, again and again.
    """
    words = F.filter(F.split("text", BLANK), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    own = docs.withColumn("planting", F.when(h % 10 == 0, F.struct(words.alias("words"), F.floor(h / 10).alias("g"))))
    n = "size(planting.words)"
    tail = f"(planting.g % {n})"
    period = f"(1 + ({n} - {tail}) div (3 + planting.g % 8))"
    # The array and the three numbers are bound once, by the lambda of an array of one.
    again = F.expr(f"transform(array(struct(planting.words AS w, cast({tail} AS int) AS a, cast({period} AS int) AS p)), x -> array_join(transform(x.w, (word, i) -> if(i < x.a, word, x.w[x.a + (i - x.a) % x.p])), ' '))[0]")
    return own.withColumn("text", F.when(F.col("planting").isNotNull() & F.expr(f"coalesce({n}, 0) > 0"), again).otherwise(F.col("text"))).drop("planting")


def digest(found: DataFrame) -> DataFrame:
    """The runs of each document in figures and checksums: the run of the greatest length / period, by exact fractions, and all."""
    better = "CASE WHEN a.length * b.period <> b.length * a.period THEN if(a.length * b.period > b.length * a.period, -1, 1) WHEN a.start <> b.start THEN if(a.start < b.start, -1, 1) ELSE if(a.period < b.period, -1, if(a.period > b.period, 1, 0)) END"
    top = found.withColumn("top", F.get(F.expr(f"array_sort(runs, (a, b) -> {better})"), F.lit(0)))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    milli = F.expr("1000 * top.length div top.period")
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", milli.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
