"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer.

A text is split at the special tokens' strings, normalised, and cut into words. Each word is
a doubly linked list of symbols; a priority queue holds the rank and place of every pair
that the vocabulary merges. The least entry is popped, skipped if one of its symbols has
changed since, else merged, and the pairs at both sides are queued. Decoding concatenates
the strings of the vocabulary. Words repeat, so each worker keeps the ids of those it met.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The word pattern of the vocabulary file, white space being dropped.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
REMEMBERED = 200_000
REMEMBERED_LENGTH = 64
_loaded: dict[str, Bpe] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def unknown_here() -> str:
    """The code points that Python's Unicode tables don't know yet."""
    return "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")


def newer_lower_case(unknown: str) -> dict[int, str]:
    """Lower case, as the tokenizers library has it, of letters that Python's tables don't know yet."""
    from tokenizers.normalizers import Lowercase

    lowered = Lowercase().normalize_str(unknown)
    if len(lowered) == len(unknown):
        return {ord(c): low for c, low in zip(unknown, lowered, strict=True) if c != low}
    return {ord(c): low for c in unknown if (low := Lowercase().normalize_str(c)) != c}


def stand_ins(unknown: str, path: str) -> dict[int, str]:
    """For code points whose class the regex module may see otherwise than the library: a letter, a digit or a sign that both see alike."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    kind = lambda c: "ж" if len(split(f"a{c}")) == 1 else "0" if len(split(f"!{c}")) == 2 else "!"
    return {ord(c): kind(c) for c in regex.findall(r"[\p{L}\p{N}]", unknown)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings = {i: s for s, i in {**self.ids, **self.special}.items()}
        # (left id, right id) -> (rank, merged id)
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        symbols = byte_symbols()
        self.inner = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.end] for s in symbols]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(WORDS)
        self.known: dict[str, tuple[int, ...]] = {}
        unknown = unknown_here()
        self.newer, self.stand_ins = newer_lower_case(unknown), stand_ins(unknown, path)
        self.special_care = frozenset(map(chr, [*self.newer, *self.stand_ins]))
        # Most texts have no character so far up: one range is looked for first.
        self.far_up = regex.compile(f"[{min(self.special_care)}-\U0010ffff]" if self.special_care else r"(?!)")

    def needs_care(self, text: str) -> bool:
        """Whether a text has characters that Python's tables don't know as the library's do."""
        return not text.isascii() and self.far_up.search(text) is not None and not self.special_care.isdisjoint(text)

    def normalised(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if self.needs_care(text):
            text = text.translate(self.newer)
        # Lower case goes character by character: a final sigma has no form of its own.
        return text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))

    def words_of(self, text: str) -> list[str]:
        if not self.needs_care(text):
            return self.words.findall(text)
        return [text[m.start() : m.end()] for m in self.words.finditer(text.translate(self.stand_ins))]

    def word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8")
        symbol = [self.inner[b] for b in data[:-1]]
        symbol.append(self.last[data[-1]])
        n = len(symbol)
        if n == 1:
            return (symbol[0],)
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                queue.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # stale
            symbol[i], symbol[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((merged, symbol[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, merged, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, symbol[h], merged, found[1]))
        return tuple(s for s in symbol if s >= 0)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for part in self.special_split.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            for word in self.words_of(self.normalised(part)):
                ids = known.get(word)
                if ids is None:
                    ids = self.word(word)
                    if len(word) <= REMEMBERED_LENGTH:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """As the vocabulary names no decoder, the strings stand with a space between them."""
        return " ".join(map(self.strings.__getitem__, ids))


def load(vocabulary: str) -> Bpe:
    if vocabulary not in _loaded:
        import public_tokenizers

        _loaded[vocabulary] = Bpe(public_tokenizers.path(vocabulary))
    return _loaded[vocabulary]


def encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, text) -> (doc_id, ids): ids of the whole text; a null text has none. A row per row, other columns ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            ids = [np.asarray(bpe.encode(t.as_py() or ""), dtype=np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = [bpe.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    encode() and decode() in one pass, so that the ids needn't leave the task. A null text
    counts as empty; an empty text has no tokens; rows with equal ids or texts are judged each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                of_text.append(sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
