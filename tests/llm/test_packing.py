import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from alertlake.llm.packing import best_fit, encoder, pack

from .conftest import ODD

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_best_fit(lengths, window):
    rooms, where = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            room, at = min(fits)
            rooms[at] -= n
        else:
            at = len(rooms)
            rooms.append(window - n)
        where.append(at)
    return rooms


@settings(deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([64, 65, 100]))
def test_segment_tree_is_best_fit(lengths, window):
    lengths.sort(reverse=True)
    where, offsets = best_fit(lengths, window)
    used = defaultdict(list)
    for n, at, offset in zip(lengths, where, offsets, strict=True):
        assert offset == sum(used[at])
        used[at].append(n)
    assert sorted(window - sum(v) for v in used.values()) == sorted(plain_best_fit(lengths, window))


def test_ids_equal_those_of_the_tokenizers_library():
    for text in ODD:
        assert encoder("byte_bpe_50k")(text or "") == REFERENCE.encode(text or "", add_special_tokens=False).ids


def test_every_id_lies_in_one_piece(docs_of):
    texts = ODD * 3 + ["some words here " * n for n in range(60)]
    rows = pack(docs_of(texts), window=64, pack_pieces=200).collect()
    ours, pieces, sequences = encoder("byte_bpe_50k"), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids, at = np.array([*ours(text or ""), 1], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
        padding += 64 - at
    assert padding < 0.05 * 64 * len(sequences)


def test_empty(docs_of):
    assert pack(docs_of([])).collect() == []


def test_null_and_repeated_ids_in_packs(docs_of):
    """Rows without an id, and with the same one, are packed each by itself; many packs share them out."""
    texts = [f"{'word ' * (i % 40)}{i}" for i in range(200)]
    rows = pack(docs_of(texts, ids=[None if i % 2 else 7 for i in range(200)]), window=64, pack_pieces=20).collect()
    encode = encoder("byte_bpe_50k")
    assert sum(r.length for r in rows) == sum(len(encode(t)) + 1 for t in texts)
    used, packs = {}, {r.sequence_id >> 32 for r in rows}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 64 and len(packs) > 5 and {r.doc_id for r in rows} == {None, 7}


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_ids_are_those_of_the_library(text):
    assert encoder("byte_bpe_50k")(text) == REFERENCE.encode(text, add_special_tokens=False).ids
