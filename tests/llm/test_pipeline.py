import math
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import corpus_pipeline as p
import duckdb
from pyspark.sql import functions as F

from alertlake.llm.line_dedup import dedup_lines_sql

from .conftest import ODD
from .test_near_texts import least
from .test_packing import REFERENCE


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").cache()
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "simhash", "pii", "packing"]
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns, name
        ids, old = [r.doc_id for r in kept.select("doc_id").collect()], {r.doc_id: r for r in before.collect()}
        assert len(ids) == len(set(ids)) and set(ids) <= set(old)
        rows = {r.doc_id: r for r in kept.collect()}
        if name == "language_id":
            assert len(ids) >= 0.99 * len(old)
        if name == "line_dedup":
            # Held against the other engine's SQL, which writes every variant out.
            con = duckdb.connect()
            con.register("documents", before.toPandas())
            want = {i: (n, h) for i, _, n, h in con.execute(dedup_lines_sql()).fetchall()}
            assert all(sha256(rows[i].text.encode()).hexdigest() == want[i][1] and rows[i].n_chars == len(rows[i].text) for i in rows)
            assert all(want[i][0] > 0 for i in old if i not in rows)
        if name == "simhash":
            order = sorted(old)
            lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
            _, first = least([b" ".join((old[i].text or "").encode().translate(lower).split()).decode() for i in order])
            assert set(ids) == {order[f] for f in first}
        if name == "pii":
            assert len(ids) == len(old) and not any(re.search(r"@mail\d|AKIA[A-Z0-9]*[0189]|\b[4]\d{15}\b", r.text) for r in rows.values())
    tokens = defaultdict(int)
    for r in p.packing(spark, kept, sf).collect():
        tokens[r.doc_id] += r.length
    assert tokens == {r.doc_id: len(REFERENCE.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept.collect()}


def test_odd_rows_and_empty(spark, docs_of, sf):
    docs = docs_of(ODD * 2)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert p.packing(spark, docs, sf).count() > 0
    docs = docs_of([])
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []


def test_run(spark, sf):
    assert p.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


UNLEARNED = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
    "qzx vkjw pqgh zzrk xwvt jjqk bvcx mnqz wkzx plqj hgvk xqzr " * 5,
]


def test_languages_not_learned_go(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    strange = spark.createDataFrame([(10**9 + i, t, None, None, len(t)) for i, t in enumerate(UNLEARNED)], docs.schema)
    kept = {r.doc_id for r in p.language_id(spark, docs.union(strange), sf).select("doc_id").collect()}
    assert not {i for i in kept if i >= 10**9} and len(kept) >= 0.995 * docs.count()


def test_the_level_is_told_by_all_rows_kept_out(spark):
    """More rows kept out than a sample of 5,000, each with a score of its own; some without a language, given or predicted."""
    n, of = 40_000, lambda i: 0.7 + i * 7919 % 40_000 / 10**6
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 11 > 0, F.lit("en")).alias("lang"))
    score = F.struct(F.when(F.col("doc_id") % 13 > 0, "en").otherwise("und").alias("lang_pred"), (0.7 + F.col("doc_id") * 7919 % n / 10**6).alias("score"))
    held = sorted(of(i) for i in range(n) if zlib.crc32(str(i).encode()) % 3 == 1 and i % 11 and i % 13)
    assert len(held) > 10_000
    assert p.least_score(docs, score) == (0.5 + held[math.ceil(0.01 * len(held)) - 1]) / 2


def test_percentile_of_every_kind_of_scores(spark):
    rng = random.Random(4)
    for scores in ([0.0], [1.0], [1.0] * 300 + [0.0] * 2, [0.7] * 1000, [rng.random() for _ in range(3000)], [0.6 + rng.random() * 2**-50 for _ in range(2000)], [(1 + k * 2**-30) / 2 for k in range(500)]):
        rows = spark.createDataFrame([(x,) for x in scores], "score double")
        for share in (0.01, 0.5, 1.0):
            assert abs(p.lowest(rows, share) - sorted(scores)[math.ceil(share * len(scores)) - 1]) <= 2**-60
    assert p.lowest(rows.where("score < 0"), 0.01) is None


def test_callers_columns_and_null_ids(spark, docs_of, sf):
    """Columns named like those that operators make come out as they went in."""
    clash = ("language", "n_lines", "n_dropped", "n_entities", "row", "text_key", "found", "drops", "component_id")
    base = "this is some text of the language that all documents here are in, number "
    texts = [f"{base}{i} and more of it x{i}@y.com" for i in range(30)] + [f"{base}3 and more of it x3@y.com", None]
    docs = docs_of(texts, ids=[*range(30), None, 31]).withColumns({c: F.lit("mine") for c in clash})
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns[5:] == list(clash) and {r[c] for r in docs.collect() for c in clash} == {"mine"}, name
    assert docs.count() > 0


def test_rows_that_share_an_id_are_told_apart_by_their_text(spark, docs_of, sf):
    texts = ["one two three four five six seven", "one two three four five six seven", "other words that are not near to them"]
    kept = p.simhash(spark, docs_of(texts, ids=[3, 5, 5]), sf).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, texts[0]), (5, texts[2])]


def test_one_of_near_copies_stays_whatever_its_id(spark, docs_of, sf):
    words = [f"w{i}" for i in range(200)]
    one, other = " ".join(words), " ".join([*words[:100], "changed", *words[101:]])
    for texts, ids in (([one, other], [1, None]), ([one, other], [None, None]), ([one, other], [4, 4]), ([one] * 5, [None] * 5), ([one] * 3 + [other], [7] * 4)):
        kept = p.simhash(spark, docs_of([*texts, "something else"], ids=[*ids, 9]), sf).collect()
        assert len(kept) == 2 and {r.doc_id for r in kept} == {9, *([min(i for i in ids if i is not None)] if any(i is not None for i in ids) else [None])}
