import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertlake.llm.line_dedup import dedup_lines, neighbourhood

from .conftest import ODD


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    """rows of different ids -> {id: text left}"""
    seen, out = [], {}
    for i, text in sorted(rows):
        if text is None:
            out[i] = None
            continue
        kept = []
        for raw in text.split("\n"):
            line = raw.strip(" \t\r")
            if not line:
                kept.append(raw)
                continue
            old = any(within_one(line, s) for s in seen)
            if not old:
                kept.append(raw)
            seen.append(line)
        out[i] = "\n".join(kept)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("abA é😀", max_size=12), st.integers(1, 5))
def test_variant_hashes(line, most):
    whole = lambda t: next(neighbourhood(t))[0]
    got = np.concatenate(list(neighbourhood(line, most)))
    assert got.tolist() == [whole(line), *(whole(line[:i] + line[i + 1 :]) for i in range(len(line)))]


def test_long_lines_are_hashed_and_sent_in_slices(docs_of):
    line = "".join(chr(97 + i * i % 23) for i in range(200_000))
    slices = list(neighbourhood(line, 50_000))
    assert [len(s) for s in slices] == [1, 50_000, 50_000, 50_000, 50_000]
    whole = lambda t: next(neighbourhood(t))[0]
    assert np.concatenate(slices)[[1, 70_001, 200_000]].tolist() == [whole(line[1:]), whole(line[:70_000] + line[70_001:]), whole(line[:-1])]
    assert [r.n_dropped for r in dedup_lines(docs_of([line, line[:150_000] + "~" + line[150_001:], line[::-1]])).orderBy("doc_id").collect()] == [0, 1, 0]


def edited(line, rng):
    i, c = rng.randrange(len(line)), rng.choice("xyzé")
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + c + line[i:], line[:i] + c + line[i + 1 :], line])


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(docs_of, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randrange(18, 30))) for _ in range(12)] + ["short", "shore"]
    texts = ["\n".join(rng.choice(["  ", "", "\t"]) + edited(edited(rng.choice(base), rng), rng) + rng.choice(["", " \r"]) for _ in range(rng.randrange(1, 8))) for _ in range(40)]
    got = {r.doc_id: r for r in dedup_lines(docs_of(texts)).collect()}
    want = brute(list(enumerate(texts)))
    assert {i: got[i].text for i in want} == want
    assert all(got[i].n_lines == len(t.split("\n")) and got[i].n_lines - got[i].n_dropped >= 0 for i, t in enumerate(texts))


def test_a_large_group_at_one_place_keeps_the_earliest(docs_of):
    texts = [f"the count of this long line is {chr(97 + i % 26)} today" for i in range(200)]
    rows = dedup_lines(docs_of(texts)).collect()
    assert [r.doc_id for r in rows if r.text] == [0]


def test_odd_texts_and_repeated_rows(docs_of):
    texts = [*ODD, "y" * 3000, "y" * 2999, "same line of some length here", "same line of some length here"]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    df = docs_of(texts, ids=ids).withColumns({c: F.lit(1) for c in ("line", "k1", "of", "drops", "at", "v", "__doc_id", "__text", "__lines", "row", "lines", "cuts", "a.b")})
    out = dedup_lines(df)
    assert set(df.columns) | {"n_lines", "n_dropped"} == set(out.columns)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(texts)
    # the two last rows are the same document
    assert got.count((len(texts) - 2, texts[-1])) == 2
    by_id = dict(got)
    assert by_id[0] is None and by_id[1] == "" and by_id[4] == "a" and by_id[5] == "" and by_id[6] == "" and by_id[3] == "\n\n"
    assert by_id[len(ODD)] == "y" * 3000 and by_id[len(ODD) + 1] == ""


def test_same_id_with_other_text(docs_of):
    rows = dedup_lines(docs_of(["one line that is long enough\nb", "other line that is long enough\nb"], ids=[7, 7])).collect()
    assert sorted(r.n_dropped for r in rows) == [0, 1]


def test_empty(docs_of):
    assert dedup_lines(docs_of([])).collect() == []


def test_null_ids_come_first(docs_of):
    texts = ["this line here is long enough a", "this line here is long enough b", "this line here is long enough b\nx"]
    got = {(r.doc_id, r.text) for r in dedup_lines(docs_of(texts, ids=[0, None, 3])).collect()}
    assert got == {(None, texts[1]), (0, ""), (3, "x")}


def test_the_bound_is_one_edit_at_every_length(docs_of):
    rng, texts = random.Random(3), []
    for n in [1, 2, 3, 5, 8, 13, 19, 20, 21, 40, 60, 90]:
        base = "".join(rng.choice("abcdefgh") for _ in range(n))
        texts += [base, edited(base, rng), edited(edited(edited(base, rng), rng), rng)]
    texts = [t for t in texts if t]
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_rows_that_share_an_id_count_as_documents_by_their_text(docs_of):
    rows = dedup_lines(docs_of(["a", "a", "other\na"], ids=[None, None, 1]).withColumn("n_lines", F.lit("mine"))).collect()
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in rows) == [("1", "other", 2, 1), ("None", "a", 1, 0), ("None", "a", 1, 0)]
