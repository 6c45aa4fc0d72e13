"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams of orders 1 to 3 that both hold,
over the root of the product of how many each holds (a blended spectrum of presences).
Nystroem landmarks turn it into features, on which one ridge regression per language is
fitted, one language versus the rest. Scoring a batch of texts is a product of matrices:
the presences of the landmarks' n-grams, times the landmarks, times the weights.

Only the fit is of bounded size (`per_language` texts of a language); every row is scored,
on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlake.llm.shared import cut, release

UNKNOWN = "und"
NO_LETTER = np.int64((1 << 21) - 1)  # above all code points
CELLS = 1 << 21  # of a batch's matrix of presences


@cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of orders 1 to 3 of a text, in order; what is no letter counts as one symbol.

    A code point takes 21 bits, so three of them in a 63-bit code are told apart whatever the script.
    """
    codes = points(text)
    codes = np.where(is_letter()[codes], codes, NO_LETTER).astype(np.int64)
    pairs = (codes[:-1] << 21) | codes[1:]
    return np.unique(np.concatenate([codes, pairs, (pairs[:-1] << 21) | codes[2:]]))


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # the landmarks' n-grams, in order
    landmarks: np.ndarray  # n-gram x landmark, each column over the root of its sum
    weights: np.ndarray  # landmark x language, the Nystroem map folded in

    def kernels(self, texts: list[str]) -> np.ndarray:
        out, batch = np.empty((len(texts), self.landmarks.shape[1]), np.float32), max(1, CELLS // max(1, len(self.grams)))
        for at in range(0, len(texts), batch):
            some = texts[at : at + batch]
            rows, sizes = np.zeros((len(some), len(self.grams)), np.float32), np.empty(len(some), np.float32)
            for i, text in enumerate(some):
                own = grams(text)
                place = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
                rows[i, place[self.grams[place] == own]], sizes[i] = 1, max(1, len(own))
            out[at : at + batch] = (rows @ self.landmarks) / np.sqrt(sizes)[:, None]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernels(texts) @ self.weights


def fit(texts: list[str], languages: list[str], landmarks_each: int, ridge: float = 1e-2, landmark_chars: int = 2000) -> Model:
    """Landmarks are the first texts of a language of at most `landmark_chars` characters, then its shortest others."""
    names, chosen = sorted(set(languages)), []
    for name in names:
        own = sorted((max(0, len(texts[i]) - landmark_chars), i) for i, of in enumerate(languages) if of == name)
        chosen += [i for _, i in own[:landmarks_each]]
    held = [grams(texts[i]) for i in chosen]
    all_ = np.unique(np.concatenate(held))
    landmarks = np.zeros((len(all_), len(chosen)), np.float32)
    for k, own in enumerate(held):
        landmarks[np.searchsorted(all_, own), k] = 1 / np.sqrt(max(1, len(own)))
    model = Model(names, all_, landmarks, np.eye(len(chosen)))
    among = landmarks.T.astype(float) @ landmarks
    values, vectors = np.linalg.eigh(among)
    kept = values > 1e-6 * values[-1]
    to_features = vectors[:, kept] / np.sqrt(values[kept])
    features = model.kernels(texts) @ to_features
    signs = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    # A language with many rows weighs no more than one with few.
    weight = 1 / np.array([languages.count(n) for n in names])[np.searchsorted(names, languages)]
    gram = features.T @ (features * weight[:, None])
    solved = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), features.T @ (signs * weight[:, None]))
    model.weights = to_features @ solved
    return model


def learn(docs: DataFrame, per_language: int = 300, landmarks_each: int = 32, most_chars: int = 20_000, most_rows: int = 6_000, least_each: int = 8) -> Model | None:
    """Fit on `per_language` texts of each language at most, those with the least hashes.

    Learns from rows with a language, a text with a letter, and crc32(doc_id as text) mod 3
    other than 1; None where there is none. All languages are learned. A text that several
    rows of a language have counts once. Of a text over `most_chars` characters a piece of so
    many is learned, from a place told by its hash. With so many languages that the sample
    would pass `most_rows` texts, each has fewer, `least_each` at least: the sample that
    reaches the driver has most_rows texts, or least_each for each language where that is more.
    """
    own = docs.select("text", "lang").where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    own = own.where(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text"))
    texts = own.select("lang", "hash").distinct()
    # Of a language's texts those with the least hashes are ranked only, about 2 * per_language + 100 of them, so that
    # the ranking gets as many rows whatever the input. The counts that tell how many that is have one row a language.
    texts = cut(texts, "labelled-texts")
    counts = cut(texts.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    languages = counts.count()
    if not languages:
        return None
    per_language = min(per_language, max(least_each, most_rows // languages))
    share = F.shiftrightunsigned("hash", 11) * F.lit(2.0**-53)
    low = texts.join(counts, "lang").where(share < (2 * per_language + 100) / F.col("rows"))
    order = Window.partitionBy("lang").orderBy(share, "hash")
    narrow = low.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    # The sample's hashes, then their texts: a piece of each.
    chosen = narrow.orderBy("lang", "place").select("hash", "lang", "place").collect()
    ids = docs.sparkSession.createDataFrame([(r["hash"], r["lang"], r["place"]) for r in chosen], "hash long, lang string, place int")
    piece = F.substr("text", 1 + F.pmod("hash", F.greatest(F.lit(1), F.length("text") - most_chars + 1)).cast("int"), F.lit(most_chars))
    rows = own.join(F.broadcast(ids), ["hash", "lang"]).groupBy("lang", "place").agg(F.min(piece).alias("text")).orderBy("lang", "place").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], landmarks_each)


def scorer(spark: SparkSession, model: Model | None):
    """A column function: text -> struct(lang_pred, score), on whole texts in batches.

    `und` with score 0 where the text is null or has no letter, or nothing could be learned.
    The score is the winner's, (1 + s) / 2 held to 0..1. Ties go to the first name.
    """
    sent = spark.sparkContext.broadcast(model)  # n-grams x landmarks of a bounded number of bounded texts

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, letter = sent.value, is_letter()
        for batch in batches:
            names, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            known = np.array([i for i, t in enumerate(batch) if model and t and letter[points(t)].any()], int)
            for at in range(0, len(known), 64):
                rows = known[at : at + 64]
                found = model.scores(batch.iloc[rows].tolist())
                names[rows] = np.array(model.languages, object)[found.argmax(axis=1)]
                scores[rows] = np.clip((1 + found.max(axis=1)) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": names, "score": scores})
        release()

    return score


def identified(docs: DataFrame, **bounds: int) -> DataFrame:
    """docs with a column `language`: struct(lang_pred, score); one of that name is replaced, other columns pass."""
    return docs.withColumn("language", scorer(docs.sparkSession, learn(docs, **bounds))("text"))


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Rows held out (crc32 of doc_id as text mod 3 is 1) were never learned from. A null
    doc_id is neither held out nor learned from; repeated rows are judged each; an empty
    table gives none; other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identified(docs.select("doc_id", "text", "lang"), **bounds).select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score")
