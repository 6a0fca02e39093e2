import random

import numpy as np
import pyarrow as pa
import pytest

from blamegrid.llm.blocks import forest, pairs, whole_groups
from blamegrid.llm.components import connected_components


def brute(edges):
    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(40)] + [(500, 500 + k) for k in range(50)] + [(1, 1), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == brute(edges)


def test_strings_and_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []
    got = connected_components(spark.createDataFrame([("b", "a"), ("b", "c"), ("b", "b")], "a string, b string")).collect()
    assert sorted(map(tuple, got)) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_groups_and_pairs():
    rng = random.Random(1)
    bucket, side = [], []
    for g in range(30):
        kind, n = rng.choice(("all", "cross", "lead")), rng.randrange(1, 9)
        own = [None] * n if kind == "all" else sorted(rng.choice((0, 1 if kind == "cross" else 2)) for _ in range(n))
        bucket += [f"g{g:02}"] * n
        side += own
    table = pa.RecordBatch.from_pydict({"bucket": bucket, "side": pa.array(side, pa.int32()), "row": list(range(len(side)))})
    want = {
        (i, j)
        for i in range(len(side))
        for j in range(i + 1, len(side))
        if bucket[i] == bucket[j] and (side[i] is None or side[i] == 0 and side[j] > 0 or side[i] == 2)
    }
    for step in (1, 3, 7, 100):
        seen = []
        for whole, starts in whole_groups([table.slice(k, step) for k in range(0, len(side), step)], 10):
            row = np.asarray(whole.column("row"))
            for left, right in pairs(starts, np.asarray(whole.column("side").fill_null(-1)), 5):
                seen += zip(row[left].tolist(), row[right].tolist())
        assert len(seen) == len(set(seen)) and set(seen) == want


def test_forest():
    rng = np.random.default_rng(4)
    left, right = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    label = forest(60, left, right)
    expected = dict(brute([(int(a), int(b)) for a, b in zip(left, right)]))
    assert [int(x) for x in label] == [expected.get(k, k) for k in range(60)]
