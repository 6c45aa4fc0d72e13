import hashlib
import random
import re
from collections import Counter

import pytest

from alertlake.llm import substring_dedup as sd
from tests.llm.conftest import ODD


def plain(rows, window):
    """Every window of every row, counted."""
    split = [[w.decode("utf-8", "surrogatepass") for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode("utf-8", "surrogatepass"))] for _, t in rows]
    met = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, split, strict=True):
        gone = {i + j for i in range(len(words) - window + 1) if met[tuple(words[i : i + window])] > 1 for j in range(window)}
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def found(spark, docs, window, **sizes):
    got = sd.dedup_substrings(docs, window, **sizes)
    assert got.columns == ["doc_id", "n_words", "n_removed", "text"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed, n=60, window=35):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda k: rng.choices(vocabulary, k=k)
    passages = [words(k) for k in (window - 1, window, window + 1, 60, 150)]
    texts = []
    for _ in range(n):
        parts = [words(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            cut = rng.randrange(len(p)) if rng.random() < 0.3 else 0
            parts += [p[cut:], words(rng.randrange(0, 50))]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(w for p in parts for w in p))
    texts += [texts[3], texts[3], texts[5] + " more", "same " * 300, "a b c " * 40, "once " * (window - 1), "twice " * (window + 1)]
    return texts


@pytest.mark.parametrize("sizes", [{}, {"shard_segments": 7}, {"hot_segments": 1, "shard_segments": 20}])
@pytest.mark.parametrize("window", [35, 6])
def test_against_every_window(spark, docs_of, window, sizes):
    texts = corpus(window, window=window)
    want = plain(list(enumerate(texts)), window)
    assert 10 < sum(r[2] > 0 for r in want) < len(want)
    assert found(spark, docs_of(texts), window, **sizes) == want


def test_nulls_repeats_and_odd_texts(spark, docs_of):
    long = " ".join(f"x{i}" for i in range(70))
    texts = [*ODD, long, long, long + " end", long]
    ids = [*range(len(ODD)), 500, 500, None, None]
    docs = docs_of(texts, ids=ids).withColumnRenamed("lang", "spans").withColumnRenamed("source", "k")
    assert found(spark, docs, 35) == plain(list(zip(ids, texts, strict=True)), 35)


def test_a_passage_in_most_rows(spark, docs_of):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(45))
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) + " " + passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(300)]
    want = plain(list(enumerate(texts)), 35)
    assert all(r[2] == 45 for r in want)
    assert found(spark, docs_of(texts), 35, hot_segments=50, shard_segments=100) == want


def test_segments_over_chunks(monkeypatch):
    hashes = sd.word_hashes(b" ".join(b"%d" % (i * i % 977) for i in range(3000)))
    window_of = lambda segs: {(int(s) + i): int(v) for v, _, s, n in zip(*segs, strict=True) for i in range(int(n) - 34)}
    whole = window_of(sd.segments(hashes, 35))
    monkeypatch.setattr(sd, "CHUNK", 100)
    assert window_of(sd.segments(hashes, 35)) == whole and sorted(whole) == list(range(3000 - 34))
    monkeypatch.setattr(sd, "SLICE", 37)
    assert (sd.word_hashes(b" ".join(b"%d" % (i * i % 977) for i in range(3000))) == hashes).all()
    equal = {}
    for i in whole:
        assert equal.setdefault(hashes[i : i + 35].tobytes(), whole[i]) == whole[i]


def test_empty(spark, docs_of):
    assert found(spark, docs_of([]), 35) == []
    assert found(spark, docs_of([None, "few words"]), 35) == [(0, 0, 0, ""), (1, 2, 0, "few words")]


def test_query_against_its_sql(spark, sf):
    import duckdb

    from alertlake.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['op12_substring_dedup']})").fetchall()
    got = [tuple(r) for r in QUERIES["op12_substring_dedup"](spark, sf).select(*columns).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] > 0 for r in got) > 10
    assert {r[3] for r in got if r[1] == r[2]} == {hashlib.sha256(b"").hexdigest()}
