"""Line dedup: lines equal to, or one edit from, an earlier line of the corpus go.

Near lines are found by their deletion neighbourhoods: every line emits itself and all its
variants with one character deleted, as hashed keys. Two lines are one substitution apart
iff variants that lack the same place are equal, and one insertion apart iff a variant of
one equals the other. Joined pairs are verified by edit distance. The bound is one edit for
lines of every length; a long line's variants are made and sent in slices.

Variants are many, so lines that can have no partner are left out first, at no loss: of two
lines one edit apart either the first or the last half is the same. Only lines that share a
half with a different line emit variants. In a group of equal variants all lines are
compared with the earliest, never with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.shared import cut, release

BLANKS = " \t\r"
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
VARIANTS = "v long, pos int, doc_id long, of long, line_no int"
ROWS, SLICE = 50_000, 1 << 16  # variants in a batch, characters hashed at once
NO_ID = -(2**63)  # stands for a null doc_id: before any other


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit value for each code point (the finaliser of splitmix64)."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(SLICE, BASE, np.uint64), dtype=np.uint64)])


def neighbourhood(line: str, most: int = ROWS) -> Iterator[np.ndarray]:
    """Hashes of the line (first) and of its variants lacking character 0, 1, ..., in slices of about `most`; linear in the line's length."""
    raw = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    sums, scale = np.zeros(len(raw) + 1, np.uint64), 1
    for at in range(0, len(raw), SLICE):
        points = _mixed(raw[at : at + SLICE])
        sums[at + 1 : at + 1 + len(points)] = sums[at] + np.cumsum(points * (POWERS[: len(points)] * np.uint64(scale)), dtype=np.uint64)
        scale = scale * int(POWERS[SLICE]) % 2**64
    back = np.uint64(pow(BASE, -1, 2**64))
    yield sums[-1:]
    for at in range(0, len(raw), most):
        # What stands after the deleted place moves one to the left: divided by the base.
        yield sums[at : at + most][: len(raw) - at] + (sums[-1] - sums[at + 1 : at + 1 + most]) * back


def variants(texts: DataFrame) -> DataFrame:
    """(doc_id, of, line_no, line) -> (v, pos, doc_id, of, line_no); pos is -1 for the line itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gathered(batch: pa.RecordBatch, hashes: list, places: list, owners: list) -> pa.RecordBatch:
            owner = pa.array(np.repeat(np.array(owners), [len(h) for h in hashes]))
            columns = [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places)), *(batch.column(k).take(owner) for k in range(3))]
            return pa.RecordBatch.from_arrays(columns, ["v", "pos", "doc_id", "of", "line_no"])

        for batch in batches:
            hashes, places, owners, held = [], [], [], 0
            for i, line in enumerate(batch.column(3)):
                place = -1
                for some in neighbourhood(line.as_py()):
                    hashes.append(some)
                    places.append(np.arange(place, place + len(some), dtype=np.int32))
                    owners.append(i)
                    place, held = place + len(some), held + len(some)
                    if held >= ROWS:
                        yield gathered(batch, hashes, places, owners)
                        hashes, places, owners, held = [], [], [], 0
            if held:
                yield gathered(batch, hashes, places, owners)
        release()

    return texts.select("doc_id", "of", "line_no", "line").mapInArrow(run, VARIANTS)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, of, text) of texts that aren't null."""
    return docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("of"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, of, line_no, line) of lines that aren't blank, trimmed. `of` tells apart rows that share a doc_id."""
    rows = _keyed(docs).select("doc_id", "of", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return rows.select("doc_id", "of", "line_no", F.trim("raw", F.lit(BLANKS)).alias("line")).where("line <> ''")


def _halves() -> list:
    """Hashes of the halves of `line`, as a line of length n and as the longer one of a pair."""
    n = F.length("line")
    own, other = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    hashed = lambda side, length, text: F.xxhash64(F.lit(side), length, text)
    line = F.col("line")
    return [
        hashed(0, n, line.substr(F.lit(1), own)),
        hashed(1, n, line.substr(own + 1, n)),
        hashed(0, n - 1, line.substr(F.lit(1), other)),
        hashed(1, n - 1, line.substr(other + 2, n)),
    ]


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(doc_id, of, line_no) of first occurrences that have an earlier line one edit away."""
    at = lambda d: F.struct(*(F.col(f"{d}{c}").alias(c) for c in ("doc_id", "line_no", "of")))
    half = first.select("k1", "doc_id", "of", "line_no", F.explode(F.array("h0", "h1", "h2", "h3")).alias("half"))
    shared = cut(half.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("half"), "shared-halves")
    asked = half.join(shared, "half", "left_semi").groupBy("doc_id", "of").agg(F.collect_set("line_no").alias("asked"))
    asked = cut(asked, "candidate-lines")
    split = _keyed(docs).join(asked, ["doc_id", "of"]).dropDuplicates(["doc_id", "of"])
    texts = split.select("doc_id", "of", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"), "asked").where("array_contains(asked, line_no)")
    texts = cut(texts.select("doc_id", "of", "line_no", F.trim("raw", F.lit(BLANKS)).alias("line")), "candidate-texts")
    emitted = variants(texts)
    line = F.xxhash64("doc_id", "of", "line_no")
    met = cut(emitted.groupBy("v").agg(F.min(line).alias("a"), F.max(line).alias("b")).where("a <> b").select("v"), "shared-variants")
    near = cut(emitted.join(met, "v", "left_semi").withColumn("at", at("")).select("v", "pos", "at"), "variants")
    lacking, whole = near.where("pos >= 0"), near.where("pos < 0").select("v", F.col("at").alias("whole"))
    earliest = lacking.groupBy("v", "pos").agg(F.min("at").alias("y"))
    same_place = lacking.join(earliest, ["v", "pos"]).select(F.col("at").alias("x"), "y").where("x <> y")
    inserted = lacking.join(whole, "v").select(F.greatest("at", "whole").alias("x"), F.least("at", "whole").alias("y")).where("x <> y")
    pairs = same_place.union(inserted).distinct()
    text = lambda c: texts.select(at("").alias(c), F.col("line").alias(f"{c}_line"))
    verified = pairs.join(text("x"), "x").join(text("y"), "y").where(F.levenshtein("x_line", "y_line", 1) >= 0)
    return verified.select("x").distinct().select("x.doc_id", "x.of", "x.line_no")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of `text`, and columns n_lines and n_dropped.

    The order of lines is (doc_id, line number). A line goes if an earlier line is equal to
    it, or is one edit (a character put in, left out or changed) from it, whatever its length.
    Blanks at a line's ends don't count. The earlier line need not itself stay.
    Blank lines always stay. A null text stays null with no lines; a text that loses all
    lines becomes empty; rows alike in doc_id and text are one document and keep the same
    lines; a null doc_id is before any other. Other columns pass, whatever their names, but
    that columns named n_lines and n_dropped are replaced; an empty table gives none.
    """
    own = docs.select("doc_id", "text")
    lines = _lines(own)
    keys = {"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")}
    narrow = lines.withColumns(keys)
    halves = [h.alias(f"h{i}") for i, h in enumerate(_halves())]
    at = F.struct("doc_id", "line_no", "of")
    per_key = narrow.select("k1", "k2", at.alias("at"), *halves).groupBy("k1", "k2").agg(F.min("at").alias("at"), F.count("*").alias("n"), *(F.first(f"h{i}").alias(f"h{i}") for i in range(4)))
    first = cut(per_key.select("k1", "k2", "n", "at.doc_id", "at.line_no", "at.of", *(f"h{i}" for i in range(4))), "first-lines")
    repeated = cut(first.where("n > 1").select("k1", "k2", F.struct("doc_id", "line_no", "of").alias("first")), "repeated-lines")
    later = narrow.select("k1", "k2", "doc_id", "of", "line_no").join(repeated, ["k1", "k2"]).where(at != F.col("first")).select("doc_id", "of", "line_no")
    drops = later.union(near_lines(own, first)).groupBy("doc_id", "of").agg(F.sort_array(F.collect_set("line_no")).alias("drops"))
    drops = cut(drops, "drops")
    # The caller's columns travel in one struct, so none can clash with those of this work.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row")["text"]
    found = rows.withColumns({"doc_id": F.coalesce(F.col("row")["doc_id"].cast("long"), F.lit(NO_ID)), "of": F.xxhash64(text)}).join(drops, ["doc_id", "of"], "left")
    found = found.withColumn("lines", F.split(text, "\n"))
    # Runs of lines between the dropped ones.
    found = found.withColumn("cuts", F.when(F.col("drops").isNotNull(), F.expr("concat(array(-1), drops, array(size(lines)))")))
    kept = F.expr("array_join(flatten(transform(sequence(0, size(cuts) - 2), i -> slice(lines, cuts[i] + 2, cuts[i + 1] - cuts[i] - 1))), '\\n')")
    new = {"text": F.when(F.col("drops").isNotNull(), kept).otherwise(text), "n_lines": F.coalesce(F.when(text.isNotNull(), F.size("lines")), F.lit(0)), "n_dropped": F.coalesce(F.when(F.col("drops").isNotNull(), F.size("drops")), F.lit(0))}
    out = found.select("row", F.struct(*[v.alias(c) for c, v in new.items()]).alias("new"))
    passing = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("new" if c in new else "row").getField(c).alias(c) for c in [*passing, "n_lines", "n_dropped"]])


def dedup_lines_sql() -> str:
    """The digest of dedup_lines() in DuckDB's SQL, with each variant written out."""
    return """
        WITH raw AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS raw
                     FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i) WHERE text IS NOT NULL),
        lines AS (SELECT doc_id, line_no, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM raw),
        firsts AS (SELECT line, min((doc_id, line_no)) AS place, length(line) AS n FROM lines WHERE line <> '' GROUP BY line),
        halves AS (SELECT line, place, n, n AS l, 0 AS side, substring(line, 1, n // 2) AS half FROM firsts
             UNION ALL SELECT line, place, n, n, 1, substring(line, n // 2 + 1) FROM firsts
             UNION ALL SELECT line, place, n, n - 1, 0, substring(line, 1, (n - 1) // 2) FROM firsts
             UNION ALL SELECT line, place, n, n - 1, 1, substring(line, (n - 1) // 2 + 2) FROM firsts),
        shared AS (SELECT l, side, half FROM halves GROUP BY ALL HAVING count(DISTINCT line) > 1),
        candidates AS MATERIALIZED (SELECT DISTINCT line, place, n FROM halves JOIN shared USING (l, side, half)),
        lacking AS MATERIALIZED (SELECT line, place, p, md5(substring(line, 1, p - 1) || substring(line, p + 1)) AS v FROM candidates, unnest(range(1, n + 1)) AS t(p)),
        near AS (SELECT a.place AS x FROM lacking a JOIN (SELECT v, p, min(place) AS m FROM lacking GROUP BY ALL) b ON a.v = b.v AND a.p = b.p WHERE m < a.place
             UNION SELECT greatest(a.place, c.place) FROM lacking a JOIN candidates c ON a.v = md5(c.line)),
        marked AS (SELECT l.doc_id, l.line_no, l.raw, l.line <> '' AND ((l.doc_id, l.line_no) <> f.place OR (l.doc_id, l.line_no) IN (SELECT x FROM near)) AS dropped
                   FROM lines l LEFT JOIN firsts f ON l.line = f.line)
        SELECT doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (coalesce(dropped, false))::INTEGER AS n_dropped,
               sha256(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT coalesce(dropped, false)), '')) AS text_sha256
        FROM marked GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
    """
