import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from alertlake.llm import periodic_runs as pr
from alertlake.llm.queries import QUERIES
from tests.llm.conftest import ODD

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def smallest_period(s):
    fail = [0] * len(s)
    for i in range(1, len(s)):
        k = fail[i - 1]
        while k and s[i] != s[k]:
            k = fail[k - 1]
        fail[i] = k + (s[i] == s[k])
    return len(s) - fail[-1]


def plain_runs(a):
    """Every distance at every place; a stretch counts if the distance is its smallest period."""
    a, out = list(a), []
    for q in range(1, len(a) // 3 + 1):
        i = 0
        while i + q < len(a):
            if a[i] != a[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(a) and a[i] == a[i + q]:
                i += 1
            length = i + q - start
            if length >= max(24, 3 * q) and smallest_period(a[start : start + length]) == q:
                out.append((start, length, q))
    return sorted(out)


def sequences():
    rng = random.Random(3)
    yield from ([], [1], [1] * 23, [1] * 24, [1] * 25, [1] * 500, [1, 2] * 12, [1, 2] * 300, [1, 2, 3] * 8, list(range(24)) * 3, list(range(100)), list(range(33)) * 3 + [0], list(range(7)) * 3 + list(range(3)))
    for n in (24, 60, 200, 700):
        for letters in (1, 2, 3, 30):
            yield [rng.randrange(letters) for _ in range(n)]
    for _ in range(60):  # planted runs, one into another, with an odd word here and there
        s = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.randrange(rng.choice([2, 4, 40])) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 50]))]
            s += unit * rng.randrange(1, 8) + unit[: rng.randrange(len(unit) + 1)]
            if rng.random() < 0.5 and s:
                s[rng.randrange(len(s))] = 99
        yield s
    unit = [rng.randrange(2) for _ in range(6)]
    yield (unit * 5 + [5]) * 4  # runs inside a run
    fib = [[1], [0]]
    for _ in range(13):
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]


def test_runs_against_plain():
    some = 0
    for s in sequences():
        want = plain_runs(s)
        assert pr.runs(np.array(s, np.int64)) == want, s
        some += len(want)
    assert some > 100


def test_many_equal_words_take_little_time():
    assert pr.runs(np.zeros(40_000, np.int64)) == [(0, 40_000, 1)]
    assert pr.runs(np.arange(40_000) % 1000) == [(0, 40_000, 1000)]


def plain_row(doc_id, text, plant=True):
    words = [w.decode("utf-8", "surrogatepass") for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode("utf-8", "surrogatepass"))]
    n = len(words)
    if plant and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(pr.numbered(words))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_plain(spark, sf):
    import pyarrow.parquet as pq

    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).select(*COLUMNS).collect()}
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    short = [r for r in rows if len((r["text"] or "").split()) < 1500]
    assert len(got) == len(rows) and len(short) > 100
    for r in short:
        assert got[r["doc_id"]] == plain_row(r["doc_id"], r["text"])
    assert sum(g[1] > 0 for g in got.values()) > 5


@pytest.mark.parametrize("query", [True, False])
def test_nulls_and_odd_texts(spark, docs_of, query):
    texts = [*ODD, "\x1c\x85  words " * 30, "one two\tthree\n" * 9, None, "z " * 24]
    ids = [*range(len(texts) - 2), None, None]
    docs = docs_of(texts, ids=ids).withColumnRenamed("lang", "runs").withColumnRenamed("source", "planting")
    found = pr.digest(pr.periodic_runs(pr.planted(docs.drop("planting")) if query else docs))
    assert found.columns == COLUMNS
    got = sorted(map(str, (tuple(r) for r in found.collect())))
    assert got == sorted(str(plain_row(i, t, query)) for i, t in zip(ids, texts, strict=True))


def test_empty(spark, docs_of):
    assert pr.digest(pr.periodic_runs(pr.planted(docs_of([])))).collect() == []
