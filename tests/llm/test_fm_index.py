import numpy as np
import pytest

from alertlake.llm.fm_index import FMIndex, WaveletTree


@pytest.mark.parametrize("symbols", [1, 2, 3, 40, 700])
def test_ranks(symbols):
    rng = np.random.default_rng(symbols)
    sequence = np.minimum(rng.geometric(0.1, 3000) if symbols > 3 else rng.integers(0, 3, 3000), symbols - 1).astype(np.int64)
    tree = WaveletTree(sequence, symbols)
    asked, at = rng.integers(0, symbols, 500), rng.integers(0, 3001, 500)
    assert tree.rank(asked, at).tolist() == [int((sequence[:i] == c).sum()) for c, i in zip(asked, at, strict=True)]


def test_a_skewed_sequence_is_compressed():
    sequence = np.zeros(100_000, np.int64)
    sequence[::50] = np.arange(2000) % 255 + 1
    bits = sum(64 * len(w) for w in WaveletTree(sequence, 256).words)
    assert bits < 1.4 * len(sequence)  # eight bits a symbol in a level row of equal codes


def occurrences(parts, weights, pattern):
    k = len(pattern)
    return sum(w * sum(part[i : i + k] == pattern for i in range(len(part) - k + 1)) for part, w in zip(parts, weights, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    letters, longest = [2, 3, 5, 30, 2, 4][seed], 31
    parts = [rng.integers(1, letters + 1, rng.integers(1, longest)).tolist() for _ in range(30)]
    parts += [parts[0][3:] + parts[1][:5], [1] * 30, parts[2]]
    parts = [p[:longest] for p in parts]
    weights = rng.integers(1, 3, len(parts)).tolist()
    text = np.concatenate([np.array([*p, 0]) for p in parts])
    weight = np.concatenate([np.array([*[w] * len(p), 0]) for p, w in zip(parts, weights, strict=True)])
    index = FMIndex(text, weight, longest)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = ends - [len(p) for p in parts]
    for least in (1, 2, 4):
        got = index.matching(text, starts, ends, least)
        for part, s in zip(parts, starts.tolist(), strict=True):
            for i in range(len(part)):
                k = 0
                while i + k < len(part) and occurrences(parts, weights, part[i : i + k + 1]) >= least:
                    k += 1
                assert got[s + i] == k
