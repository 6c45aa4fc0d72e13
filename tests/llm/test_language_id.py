import random
import zlib

import numpy as np

from alertlake.llm.language_id import fit, identify, learn

from .conftest import ODD


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.98


def test_labels_of_held_out_rows_are_not_read(docs_of):
    texts = ["der die und das ist " * 5, "the and of to in is " * 5] * 40
    langs = ["de", "en"] * 40
    wrong = ["xx" if zlib.crc32(str(i).encode()) % 3 == 1 else x for i, x in enumerate(langs)]
    one, other = (sorted(map(tuple, identify(docs_of(texts, v)).collect())) for v in (langs, wrong))
    assert one == other and {r[2] for r in one} == {"de", "en"}


def test_odd_texts(docs_of):
    rows = {r.doc_id: r for r in identify(docs_of(ODD, ["a", "b", None] * 5 + ["a", "b"])).collect()}
    assert len(rows) == len(ODD)
    for i, t in enumerate(ODD):
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))


def test_nothing_to_learn_from(docs_of):
    assert identify(docs_of([])).collect() == []
    assert [r.lang_pred for r in identify(docs_of(["some text"], [None])).collect()] == ["und"]


def test_kernel_is_the_share_of_common_ngrams():
    texts, langs = ["abcab", "bcd", "xyz xyz"], ["u", "v", "w"]
    model = fit(texts, langs, landmarks_each=1)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    got = model.kernels(["abd", "xyz"])
    for row, text in zip(got, ["abd", "xyz"], strict=True):
        want = [len(grams(text) & grams(t)) / np.sqrt(len(grams(text)) * len(grams(t))) for t in texts]
        np.testing.assert_allclose(row, want, rtol=1e-5)


def words_in(script, rng, kinds=30):
    return ["".join(chr(rng.choice(script)) for _ in range(rng.randrange(2, 5))) for _ in range(kinds)]


def test_scripts_with_thousands_of_letters(docs_of):
    """Two languages over disjoint alphabets of 1,000 letters, and three scripts at once."""
    rng = random.Random(1)
    alphabets = {"x1": range(0x4E00, 0x51E8), "x2": range(0x51E8, 0x55D0), "ko": range(0xAC00, 0xAE00), "ja": range(0x3041, 0x3097), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3C9), "fr": [*range(97, 123), *range(0xE0, 0xFD)]}
    own = {k: words_in(v, rng, 400) for k, v in alphabets.items()}
    langs = [k for k in own for _ in range(60)]
    texts = [" ".join(rng.choices(own[k], k=40)) for k in langs]
    rows = identify(docs_of(texts, langs)).collect()
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 100 and np.mean(held) >= 0.99


def test_every_language_is_learned(docs_of):
    """More languages than the sample has rows for at 300 each."""
    rng = random.Random(2)
    own = {f"l{i}": words_in(range(97, 123), rng) for i in range(230)}
    langs = [k for k in own for _ in range(12)]
    texts = [" ".join(rng.choices(own[k], k=60)) for k in langs]
    rows = identify(docs_of(texts, langs), most_rows=1000, landmarks_each=4).collect()
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) >= 0.95 and len({r.lang_pred for r in rows}) == 230


def test_against_a_plain_fit_and_score(docs_of):
    """The dual form over all n-grams as sets: kernel, Nystroem features by the inverse root, ridge by least squares."""
    rng = random.Random(3)
    own = {k: words_in(range(97, 123), rng) for k in ("aa", "bb", "cc")}
    langs = [k for k in own for _ in range(20)]
    texts = [" ".join(rng.choices(own[k], k=8)) for k in langs]
    model = fit(texts, langs, landmarks_each=5)

    def kernel(s, t):
        a, b = ({"".join(c if c.isalpha() else "\0" for c in x[i : i + n]) for n in (1, 2, 3) for i in range(len(x) - n + 1)} for x in (s, t))
        return len(a & b) / np.sqrt(len(a) * len(b))

    marks = [t for k in own for t in [x for x, y in zip(texts, langs, strict=True) if y == k][:5]]
    among = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(among)
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    phi = np.array([[kernel(t, m) for m in marks] for t in texts]) @ root / np.sqrt(20)
    lam = 1e-2 * np.trace(phi.T @ phi) / len(marks)
    target = np.array([[1.0 if y == k else -1.0 for k in own] for y in langs]) / np.sqrt(20)
    stacked = np.linalg.lstsq(np.vstack([phi, np.sqrt(lam) * np.eye(len(marks))]), np.vstack([target, np.zeros((len(marks), 3))]), rcond=None)[0]
    asked = [" ".join(rng.choices(own[k], k=6)) for k in own] + ["zzz qqq"]
    want = np.array([[kernel(t, m) for m in marks] for t in asked]) @ root @ stacked
    np.testing.assert_allclose(model.scores(asked), want, atol=1e-3)


def test_ties_and_null_ids(docs_of):
    """Two languages with the same texts score alike; the first name is taken."""
    texts = ["one two three", "one two three"] * 20
    rows = identify(docs_of(texts, ["b", "a"] * 20, ids=[*range(39), None])).collect()
    assert len(rows) == 40 and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert len({(r.lang_pred, r.score) for r in rows}) == 1


def test_a_language_of_one_repeated_text_or_of_long_texts_is_learned(docs_of):
    spanish, german = "el perro corre por la calle y la casa es grande", "der hund läuft durch die strasse und das haus ist gross"
    long = " ".join("il cane corre per la strada e la casa che vedo è molto grande davvero".split() * 2500)
    for doc_id in (0, 2, 5):
        texts = [spanish] * 600 + [f"{german} {i}" for i in range(300)] + [f"{long} {i}" for i in range(3)]
        langs, ids = ["es"] * 600 + ["de"] * 300 + ["it"] * 3, [doc_id] * 600 + list(range(1000, 1300)) + [2, 2, 2]
        docs = docs_of(texts, langs, ids)
        model = learn(docs)
        assert model.languages == ["de", "es", "it"]
        got = identify(docs).groupBy("doc_id", "lang_pred").count().where(f"doc_id = {doc_id}").collect()
        assert {"es"} <= {r.lang_pred for r in got} and max(got, key=lambda r: r["count"]).lang_pred == "es"
