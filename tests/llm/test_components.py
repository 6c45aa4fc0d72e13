import random

import pytest

from alertlake.llm.components import components


def brute(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 1), (None, 2), (3, None)],
        [(i, i + 1) for i in range(400)],
        [(0, i) for i in range(1, 300)] + [(i, 0) for i in range(1, 50)],
        [(random.Random(i).randrange(500), random.Random(-i).randrange(500)) for i in range(300)],
        [(-(2**63), 2**63 - 1), (5, -7)],
    ],
)
def test_against_union_find(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = brute(edges)
    assert sorted(r.node for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.label, set()).add(want[r.node])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(want.values()))
