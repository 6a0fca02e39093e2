"""MinHash near-dedup against brute force over all pairs."""

import random

import numpy as np
import pytest

from blamegrid.llm import minhash

SCHEMA = "doc_id long, text string, extra string"


def shingles(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent=80):
    sets = [shingles(t, width) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[root(i)] = min([x for x in (least.get(root(i)), d) if x is not None], default=None)
    kept = lambda d, least: None if None in (d, least) else d == least
    return sorted(((d, len(sets[i]), least[root(i)], kept(d, least[root(i)])) for i, (d, *_) in enumerate(rows)), key=repr)


def result(spark, rows, width=2, schema=SCHEMA):
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema), width).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to in".split()) if rng.random() < 0.4 else f"w{rng.randrange(400)}"
    texts = []
    while len(texts) < n:
        if texts and rng.random() < 0.6:
            base = rng.choice(texts).split(" ")
            for _ in range(rng.choice((0, 1, 1, 2, 4, 8))):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(word() for _ in range(rng.choice((3, 5, 12, 40, 80)))))
    ids = rng.sample(range(10_000), n)
    return [(d, t, "x") for d, t in zip(ids, texts)]


@pytest.mark.parametrize("width", (2, 5))
def test_random_corpus(spark, width):
    rows = corpus(width)
    assert result(spark, rows, width) == brute(rows, width)


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for d in range(70):  # similarities from well below to well above the threshold
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(60)] = f"n{rng.randrange(1000)}"
        rows.append((d, " ".join(own), None))
    got = result(spark, rows)
    assert got == brute(rows, 2)
    assert len({r[2] for r in got}) > 1


def test_null_and_repeated_ids_lose_no_link(spark):
    """Components bridged by rows without doc_id, and one doc_id with texts of several components."""
    words = [f"w{k}" for k in range(60)]
    a, b, c = words, [*words[:54], *(f"x{k}" for k in range(4))], [*(f"y{k}" for k in range(4)), *words[5:54], *(f"x{k}" for k in range(4))]
    far = [f"z{k}" for k in range(40)]
    rows = [(1, a), (None, b), (3, c), (3, far), (9, [*far, "end"]), (None, ["no", "body"]), (None, ["no", "body"]), (None, [])]
    rows = [(d, " ".join(x), "x") for d, x in rows]
    want = brute(rows, 2)
    assert (3, len(c) - 1, 1, False) in want and (None, len(b) - 1, 1, None) in want and (3, 39, 3, True) in want
    assert not any(r == (3, len(c) - 1, 3, True) for r in want)
    assert result(spark, rows) == want


def test_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SET_BYTES", 2000)
    rows = corpus(9, 80)
    assert result(spark, rows) == brute(rows, 2)


def test_edges(spark):
    rows = [
        (9, None, "x"), (8, "", "x"), (7, " \t\n ", "x"), (6, "One", "x"), (5, "one", "x"), (4, "one two", "x"), (3, "a b c d e f g h i j", "x"),
        (2, "A B\tC\nD e f g h i j", "x"), (2, "A B\tC\nD e f g h i j", "x"), (1, "a b c d e f g h i k", "x"), (11, "É é", "x"), (12, "é é", "x"), (10, "x " * 30_000, "x"),
    ]
    got = result(spark, rows)
    assert got == brute(rows, 2)
    assert (3, 9, 1, False) in got and (2, 9, 1, False) in got  # 8 of 10 shingles: 0.8 exactly


def test_exactly_at_the_threshold(spark):
    rows = []
    for k in range(40):  # 36 of 45 shingles in common: 0.8; and 35 of 45, just below
        words = [f"k{k}w{i}" for i in range(42)]
        rows += [(10 * k, " ".join(words[:42]), ""), (10 * k + 1, " ".join(words[:37] + [f"k{k}x{i}" for i in range(4)]), "")]
    assert result(spark, rows) == brute(rows, 2)


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, [], schema=SCHEMA) == []
    clash = "doc_id long, text string, n_shingles string, node string, component string, digest int, wanted string, token long"
    rows = [(1, "a b c d", "x", "y", "z", 1, "w", 2), (2, "a b c d", "x", "y", "z", 1, "w", 2)]
    assert [r[2] for r in result(spark, rows, schema=clash)] == [1, 1]


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    sign = minhash.signatures([np.sort(a[:800]), np.sort(a[100:])])
    assert abs((sign[0] == sign[1]).mean() - 700 / 900) < 0.2


def test_matches_bound():
    """A pair at the threshold agrees in fewer coordinates than MATCHES about twice in a million."""
    from math import comb

    miss = sum(comb(minhash.SIZE, k) * 0.8**k * 0.2 ** (minhash.SIZE - k) for k in range(minhash.MATCHES))
    assert miss < 5e-6
