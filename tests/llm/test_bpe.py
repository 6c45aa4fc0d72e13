import unicodedata
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from alertlake.llm.bpe import decode, encode, load, round_trip

from .conftest import ODD

REFERENCE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
REFERENCE.no_padding()
REFERENCE.no_truncation()


@pytest.mark.parametrize("text", [t or "" for t in ODD])
def test_odd_texts(text):
    ours, want = load("word_bpe_49k.json"), REFERENCE.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == want and ours.decode(want) == REFERENCE.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdefghijk 'sltre.&1"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_any_text(text):
    assert load("word_bpe_49k.json").encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_every_code_point_by_itself_and_in_a_word():
    """All code points but surrogates, assigned or not, 64 to a text, each after a letter and before one."""
    ours = load("word_bpe_49k.json")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 8 == 4 or unicodedata.category(chr(c)) not in ("Lo", "Co", "Cn") or c in ours.newer)]
    for at in range(0, len(points), 64):
        some = points[at : at + 64]
        for text in ("".join(f"a{chr(c)}b " for c in some), " ".join(map(chr, some))):
            assert ours.encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids, f"{some[0]:x}"


def test_letters_newer_than_pythons_tables():
    assert 0xA7DC in load("word_bpe_49k.json").newer or unicodedata.category("\ua7dc") != "Cn"
    for text in ("A\ua7dcB", "\u1c89\u1c8a", "\U00010d50x\U00010d70", "Ω\ua7dcΣ"):
        assert load("word_bpe_49k.json").encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in round_trip(docs).collect()}
    for r in docs.collect():
        ids = REFERENCE.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == sha256(REFERENCE.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(docs_of):
    docs = docs_of(ODD)
    texts = {r.doc_id: r.text for r in decode(encode(docs)).collect()}
    assert texts == {i: REFERENCE.decode(REFERENCE.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(ODD)}


def test_empty(docs_of):
    assert round_trip(docs_of([])).collect() == []


def test_null_and_repeated_ids(docs_of):
    rows = round_trip(docs_of(["a b", "c", "a b", None], ids=[None, 4, 4, None])).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("4", 1), ("4", 2), ("None", 0), ("None", 2)]
