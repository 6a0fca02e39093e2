import math

import numpy as np
import pytest

from blamegrid.llm import blocks, embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, threshold=0.98):
    n = len(rows)
    good = [x is not None and label is not None and None not in x and all(map(math.isfinite, x)) and any(x) for _, x, label, *_ in rows]
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min([x for x in (least.get(root(i)), rows[i][0]) if x is not None], default=None)
    kept = lambda i: rows[i][0] == least[root(i)] if None not in (rows[i][0], least[root(i)]) else None
    return sorted(((rows[i][0], links[i], least[root(i)], kept(i)) for i in range(n)), key=repr)


def result(spark, rows, schema=SCHEMA, **more):
    got = embeddings.near_duplicates(spark.createDataFrame(rows, schema), **more).collect()
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=repr)


def vectors(seed, n=150, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            base = np.array(rows[rng.integers(len(rows))][1])
            x = base + rng.normal(size=dim) * np.linalg.norm(base) / math.sqrt(dim) * rng.choice([0.0, 0.05, 0.15, 0.2, 0.25, 0.4])
        else:
            x = rng.normal(size=dim)
        rows.append((int(1000 - k), [float(np.float32(v)) for v in x], int(rng.integers(3)), "x"))
    return rows


@pytest.mark.parametrize("block", (1024, 5))
def test_random_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "in_blocks", lambda rows, keys, row_id: blocks.in_blocks(rows, keys, row_id, block))
    rows = vectors(block)
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    x, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (1, x, 1, ""), (2, x, 1, ""), (2, x, 1, ""), (3, [2.0, 4.0, 6.0], 1, ""), (4, x, 2, ""), (5, x, None, ""), (6, None, 1, ""), (7, [0.0, 0.0, 0.0], 1, ""),
        (8, [1.0, None, 2.0], 1, ""), (9, [nan, 1.0, 1.0], 1, ""), (10, [inf, 1.0, 1.0], 1, ""), (11, [], 1, ""), (12, [1.0, 2.0], 1, ""), (13, [-1.0, -2.0, -3.0], 1, ""),
        (14, [1e-30, 2e-30, 3e-30], 1, ""), (15, [1e30, 2e30, 3e30], 1, ""),
    ]
    want = brute(rows[:14] + [(14, x, 1, ""), (15, x, 1, "")])
    assert result(spark, rows) == want
    assert result(spark, []) == []
    assert result(spark, [(1, x, "a", 5), (2, x, "a", 5)], "vec_id long, embedding array<double>, label string, keys int") == [(1, 1, 1, True), (2, 1, 1, False)]


def test_null_and_repeated_ids_lose_no_link(spark):
    """A chain whose middle has no vec_id, and one vec_id with two vectors of different components."""
    turn = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), 0.0]
    rows = [(1, turn(0), 1, ""), (None, turn(10), 1, ""), (3, turn(20), 1, ""), (3, turn(120), 1, ""), (4, turn(128), 1, ""), (None, turn(240), 1, ""), (None, turn(240), 1, "")]
    rows += [(5, turn(60), None, ""), (None, None, 1, "")]
    want = brute(rows)
    assert (1, 1, 1, True) in want and (None, 2, 1, None) in want and (3, 1, 1, False) in want and (3, 1, 3, True) in want
    assert result(spark, rows) == want


@pytest.mark.parametrize("threshold, dim", ((0.5, 24), (0.98, 2), (0.98, 1), (0.0, 8), (1.0, 4)))
def test_any_threshold_and_dimension(spark, threshold, dim):
    """What keys can't find in time is compared in blocks."""
    rng = np.random.default_rng(dim)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=dim)], int(rng.integers(2)), "") for k in range(120)]
    rows += [(200 + k, [4.0 * v for v in rows[k][1]], rows[k][2], "") for k in range(10)]
    if threshold == 1.0:  # equality of rounded products can't be told from outside
        codes = embeddings.Codes(dim, 100, threshold)
        assert codes.keys <= embeddings.MOST_KEYS
    else:
        assert result(spark, rows, threshold=threshold) == brute(rows, threshold)


def test_number_of_keys_is_bounded_and_misses_are_rare():
    for dim in (1, 2, 16, 64, 256):
        for threshold in (0.98, 0.9, 0.7, 0.5):
            codes = embeddings.Codes(dim, 10_000, threshold)
            assert 1 <= codes.keys <= embeddings.MOST_KEYS and codes.chosen.shape == (codes.keys, codes.bits)
            rng = np.random.default_rng(dim)
            a, b = rng.normal(size=(2, 400, dim))
            if dim > 2 and (a := embeddings.unit(a)) is not None:
                b = embeddings.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
                b = threshold * a + math.sqrt(1 - threshold**2) * b
                assert (codes.encode(a)[2] == codes.encode(b)[2]).any(axis=1).all()
    assert embeddings.Codes(2, 4096).bits < 16


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    codes = embeddings.Codes(64, 1000)
    a, b = embeddings.unit(rng.normal(size=(400, 64))), rng.normal(size=(400, 64))
    b = embeddings.unit(0.9 * a + 0.05 * b)
    true = (a * b).sum(axis=1)
    packed, factors, keys = codes.encode(a)
    signs = np.unpackbits(packed, axis=2)[:, :, :64].astype(float) * 2 - 1
    estimate = (signs * codes.turned(b)).sum(axis=2) / 8 / factors
    assert abs((estimate.mean(axis=1) - true).mean()) < 0.01
    error = embeddings.CONFIDENCE * np.sqrt(1 - factors**2) / factors / math.sqrt(63)
    assert (np.abs(estimate - true[:, None]) <= error).all()
    assert keys.shape == (400, codes.keys)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    codes = embeddings.Codes(32, 10_000)
    a = embeddings.unit(rng.normal(size=(4000, 32)))
    b = rng.normal(size=a.shape)
    b = embeddings.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = 0.9801 * a + math.sqrt(1 - 0.9801**2) * b
    assert ((codes.encode(a)[2] == codes.encode(b)[2]).any(axis=1)).mean() > 0.999
