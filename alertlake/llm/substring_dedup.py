"""Substring dedup: words in a window of words that occurs elsewhere go.

Windows that are equal have the same least hash among their word m-grams (their minimizer),
at the same place. So each document is cut into segments, stretches of windows that share
the place of their minimizer, and segments are dealt to shards by its value: all windows
that can be equal meet in one shard. Minimizers of one segment only can't hold a repeat, and
such segments never leave their documents' tasks. Equal segments are one, with a weight.

A shard's segments make up its FM-index. Each of them is streamed through it backwards; the
matching statistics tell at every word the longest stretch from there on that weighs two or
more, and where it reaches a window's length the window is repeated. Words are numbered from
their own bytes in the shard, so hashes only choose candidates and shards.

A minimizer that very many different segments share (part of a passage found in much of the
corpus, amid other words) would make a shard of its own without bound. Its segments are cut
once more, to single windows, each with its own hash as minimizer; what occurs once goes,
and the rest is dealt out evenly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.fm_index import FMIndex
from alertlake.llm.shared import cut

WINDOW = 35
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BLANK = re.compile(rb"[\x20\x09-\x0D]")
SLICE, CHUNK = 1 << 20, 1 << 17  # bytes split at once; words cut into segments at once
LOW = np.uint64((1 << 20) - 1)
SEGMENTS = "v long, s long, k long, start int, n int"
REPEATS = "v long, s long, first int, past int"
MOST_TASKS = 4096


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_hashes(data: bytes) -> np.ndarray:
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(data):
        blank = BLANK.search(data, min(at + SLICE, len(data)))
        end = blank.start() if blank else len(data)
        words = data[at:end].split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end + 1
    return np.concatenate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Hashes of stretches of a sequence of 64-bit values, from sums by powers of BASE."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(BASE)[:n], dtype=np.uint64)])
        self.back = powers(pow(BASE, -1, 2**64))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])


def shingle_words(window: int) -> int:
    """Words of an m-gram: about a third of a window."""
    return (window + 2) // 3


def segments(hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """v, s, start, n: minimizer, hash of the words, first word and number of words of each segment."""
    m, parts = shingle_words(window), []
    for at in range(0, max(0, len(hashes) - window + 1), CHUNK):
        own = hashes[at : at + CHUNK + window - 1]
        sums = Sums(own)
        grams = sums.of(np.arange(len(own) - m + 1), np.arange(m, len(own) + 1))
        # The least m-gram of each window, the first of equal ones: places stand in the low bits.
        least, width, span = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64), 1, window - m + 1
        while width < span:
            step = min(width, span - width)
            least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
        place = (least & LOW).astype(np.int64)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        ends = np.append(starts[1:], len(place)) + window - 1
        parts.append((grams[place[starts]], sums.of(starts, ends), starts + at, ends - starts))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def doc_key() -> Column:
    return F.xxhash64("doc_id", "text")


def cut_up(docs: DataFrame, window: int) -> DataFrame:
    """(v, s, k, start, n): the segments of every row of docs, k its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, held = batch.column(0).to_numpy(), [], 0
            for i, text in enumerate(batch.column(1)):
                v, s, start, n = segments(word_hashes(bytes_of(text.as_py())), window)
                out.append((v, s, np.full(len(v), keys[i]), start, n))
                held += len(v)
                if held > 100_000 or i == len(batch) - 1:
                    v, s, k, start, n = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(s.view(np.int64)), pa.array(k), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["v", "s", "k", "start", "n"])
                    out, held = [], 0

    return docs.select(doc_key().alias("k"), "text").mapInArrow(run, SEGMENTS)


def offsets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
    return np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (k, v, s, weight, start, n) with `words`, the bytes from their first word to their last, read from docs."""
    per_doc = chosen.groupBy("k").agg(F.collect_list(F.struct("v", "s", "weight", "start", "n")).alias("asked"))
    met = docs.select(doc_key().alias("k"), "text").join(per_doc, "k").dropDuplicates(["k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data, asked = bytes_of(batch.column(0)[i].as_py()), pa.RecordBatch.from_struct_array(batch.column(1)[i].values)
                starts, ends = offsets(data)
                first, n = asked.column(3).to_numpy(), asked.column(4).to_numpy()
                words = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first + n - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(asked.column(c) for c in range(3)), pa.array(words, pa.binary())], ["v", "s", "weight", "words"])

    return met.select("text", "asked").mapInArrow(run, "v long, s long, weight long, words binary")


def repeats_in_shard(table: pa.Table, window: int) -> pa.Table:
    """(v, s, first, past): the words of each segment that repeated windows cover."""
    lists = [w.as_py().split() for w in table["words"]]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for words in lists for w in words), np.int64, int(sizes.sum()))
    del lists, index
    weight = table["weight"].to_numpy()
    total = np.bincount(ids, np.repeat(weight, sizes)) if len(ids) else np.zeros(0)
    # Words that weigh less than two lie in no repeat: they end matches, as separators do.
    symbols = np.where(total >= 2, np.cumsum(total >= 2), 0)[ids]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    since = np.arange(len(symbols)) - np.maximum.accumulate(np.where(symbols == 0, np.arange(len(symbols)), np.repeat(starts, sizes) - 1)) if len(symbols) else symbols
    full = np.flatnonzero(np.maximum.reduceat(since, starts) >= window) if len(symbols) else np.empty(0, np.int64)
    none = np.empty(0, np.int64)
    first, past, own = none, none, none
    if len(full):
        sizes = sizes[full]
        spread = np.concatenate([[0], np.cumsum(sizes + 1)])
        at, stop = spread[:-1], spread[1:] - 1
        text, weights = np.zeros(spread[-1], np.int64), np.zeros(spread[-1], np.int64)
        into = np.arange(sizes.sum()) + np.repeat(np.arange(len(full)), sizes)
        text[into] = symbols[np.arange(sizes.sum()) + np.repeat(starts[full] - (np.cumsum(sizes) - sizes), sizes)]
        weights[into] = np.repeat(weight[full], sizes)
        found = FMIndex(text, weights, int(sizes.max())).matching(text, at, stop, 2)
        hits = np.flatnonzero(found >= window)
        # All windows of a segment hold its minimizer, so those repeated cover one stretch.
        of = np.searchsorted(at, hits, "right") - 1
        own, begins = np.unique(of, return_index=True)
        first = hits[begins] - at[own]
        past = hits[np.append(begins[1:], len(hits)) - 1] - at[own] + window if len(hits) else none
        own = full[own]
    return pa.table({"v": table["v"].take(pa.array(own)), "s": table["s"].take(pa.array(own)), "first": pa.array(first, pa.int32()), "past": pa.array(past, pa.int32())})


def repeats(texts: DataFrame, window: int, shard_segments: int) -> DataFrame:
    """(v, s, weight, words) -> (v, s, first, past), a shard for about `shard_segments` segments."""
    shards = max(1, math.ceil(texts.count() / shard_segments))
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).repartition(min(MOST_TASKS, 2 * shards), "shard")
    return dealt.groupBy("shard").applyInArrow(lambda table: repeats_in_shard(table, window), REPEATS)


def single_windows(texts: DataFrame, window: int) -> DataFrame:
    """(v, s, weight, words) -> (v, s, weight, at, w): the windows of segments and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                hashes = word_hashes(batch.column(3)[i].as_py())
                at = np.arange(len(hashes) - window + 1)
                repeat = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(repeat) for c in range(3)), pa.array(at.astype(np.int32)), pa.array(Sums(hashes).of(at, at + window).view(np.int64))], ["v", "s", "weight", "at", "w"])

    return texts.select("v", "s", "weight", "words").mapInArrow(run, "v long, s long, weight long, at int, w long")


def window_texts(texts: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """chosen (w, weight, v, s, at) -> (v, s, weight, words) with w as the minimizer, read from texts."""
    asked = chosen.groupBy("v", "s").agg(F.collect_list(F.struct("w", "weight", "at")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words, some = batch.column(0)[i].as_py().split(), pa.RecordBatch.from_struct_array(batch.column(1)[i].values)
                own = [b" ".join(words[a : a + window]) for a in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.zeros(len(some), np.int64)), some.column(1), pa.array(own, pa.binary())], ["v", "s", "weight", "words"])

    return texts.join(asked, ["v", "s"]).select("words", "asked").mapInArrow(run, "v long, s long, weight long, words binary")


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_segments: int = 8_000, hot_segments: int = 8_000) -> DataFrame:
    """(k, spans): for each row hash with repeats, array<struct<first, past>> of stretches of words to take out, by `first`."""
    found = cut_up(docs, window)
    several = cut(found.groupBy("v").agg(F.count("*").alias("met")).where("met > 1").select("v"), "repeated-minimizers")
    held = cut(found.join(several, "v", "left_semi"), "segments")
    rep = F.min(F.struct("k", "start", "n")).alias("rep")
    distinct = cut(held.groupBy("v", "s").agg(F.count("*").alias("weight"), rep).select("v", "s", "weight", "rep.*"), "distinct-segments")
    texts = cut(texts_of(docs, distinct), "segment-texts")
    hot = cut(texts.groupBy("v").agg(F.count("*").alias("met")).where(F.col("met") > hot_segments).select("v"), "hot-minimizers")
    spans = repeats(texts.join(hot, "v", "left_anti"), window, shard_segments)
    if not hot.isEmpty():
        crowded = cut(texts.join(hot, "v", "left_semi"), "crowded-segments")
        windows = single_windows(crowded, window)
        twice = windows.groupBy("w").agg(F.sum("weight").alias("weight"), F.min(F.struct("v", "s", "at")).alias("rep")).where("weight > 1")
        twice = cut(twice.select("w", "weight", "rep.*"), "repeated-windows")
        proved = repeats(window_texts(crowded, twice, window), window, shard_segments).select(F.col("v").alias("w"))
        more = windows.join(cut(proved, "proved-windows"), "w").groupBy("v", "s").agg(F.min("at").alias("first"), (F.max("at") + window).alias("past"))
        spans = spans.union(more)
    spans = cut(spans, "repeats")
    placed = held.join(spans, ["v", "s"]).select("k", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("past")).alias("past"))
    # Rows alike in id and text have the same segments: each once.
    return placed.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("first", "past"))).alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed long, text string: each row without the words of repeated windows.

    Words are `[^\\x20\\x09-\\x0D]+`, as they are. A word goes if one of the `window`-word
    windows over it also starts elsewhere, in another row or in the same one; windows are
    judged on the input. Words kept are joined by one blank. Rows that repeat both id and
    text repeat each other's windows; a null or empty text has no words and an empty text
    left; other columns are ignored; an empty table gives none. Rows are told apart by 64
    bits of hash of id and text.
    """
    spans = cut(repeated_spans(docs, window, **sizes), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some, out = batch.slice(at, 256), []
                for text, own in zip(some.column(1), some.column(2), strict=True):
                    words = bytes_of(text.as_py()).split()
                    n, left, upto = len(words), [], 0
                    for span in own.as_py() or []:
                        left += words[upto : max(upto, span["first"])]
                        upto = max(upto, span["past"])
                    left += words[upto:]
                    out.append((n, n - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
                n, removed, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    own = docs.select(F.col("doc_id").cast("long"), "text", doc_key().alias("k")).join(spans, "k", "left")
    return own.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def dedup_substrings_sql(window: int = WINDOW) -> str:
    """The query's rows in DuckDB's SQL: every window written out and grouped."""
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\x0c\\r]+') AS words FROM documents),
        windows AS (SELECT r, i, md5(array_to_string(list_slice(words, i, i + {window - 1}), ' ')) AS h FROM d, unnest(range(1, len(words) - {window - 2})) AS t(i)),
        repeated AS (SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT r, i + j AS i FROM repeated, unnest(range({window})) AS t(j)),
        left_ AS (SELECT r, string_agg(words[t.i], ' ' ORDER BY t.i) AS kept, count(*) AS n FROM d, unnest(range(1, len(words) + 1)) AS t(i)
                  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = d.r AND g.i = t.i) GROUP BY r)
        SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN left_ USING (r)
    """
