"""The toxicity network against plain loops and finite differences, its windows, whole query and cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blamegrid.llm import toxicity as tx

WORDS = [b"a", b"bb", b"ccc", b"dd", "é".encode()]


@pytest.fixture(scope="module")
def network():
    net = tx.Network({b"a": 1, b"bb": 2}).start(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


@pytest.fixture(scope="module")
def windows():
    w = np.full((4, tx.WINDOW), -1)
    w[0, :3], w[1, :1], w[2] = [0, 1, 2], [3], np.arange(tx.WINDOW) % 5
    return w


def plain_odds(net, words, window):
    """One window, one word, one number at a time."""
    p, h = net.p, tx.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    own = [words[k] for k in window if k >= 0]
    inputs = []
    for w in own:
        codes, _ = tx.grams([w])
        inputs.append(np.concatenate([p["word"][net.vocabulary.get(w, 0)], p["char"][codes].mean(axis=0)]))
    sides = []
    for s in "fb":
        state, seen = np.zeros(h), []
        for x in inputs if s == "f" else inputs[::-1]:
            g, r = x @ p[f"w{s}"] + p[f"c{s}"], state @ p[f"u{s}"]
            z, reset = sigmoid(g[:h] + r[:h]), sigmoid(g[h : 2 * h] + r[h : 2 * h])
            new = np.tanh(g[2 * h :] + reset * r[2 * h :])
            state = (1 - z) * new + z * state
            seen.append(state)
        sides.append(seen if s == "f" else seen[::-1])
    if not own:
        return float(p["o0"][0])
    states = np.hstack([np.array(x) for x in sides])
    weight = np.exp(np.tanh(states @ p["a"] + p["a0"]) @ p["v"])
    return float((weight / weight.sum()) @ states @ p["o"] + p["o0"][0])


def test_forward_equals_plain_loops(network, windows):
    odds = network.forward(network.projected(network.inputs(WORDS)[0]), windows)
    assert odds == pytest.approx([plain_odds(network, WORDS, w) for w in windows], abs=1e-5)


def test_gradients_equal_differences(network, windows):
    labels, weight = np.array([1.0, 0, 1, 0]), np.array([0.4, 0.2, 0.3, 0.1])
    _, grad = network.gradients(WORDS, windows, labels, weight)
    draw = np.random.default_rng(0)
    codes, _ = tx.grams(WORDS)
    for name, values in network.p.items():
        for _ in range(5):
            at = tuple(draw.integers(0, n) for n in values.shape)
            at = (draw.integers(1, 3), at[1]) if name == "word" else (int(draw.choice(codes)), at[1]) if name == "char" else at
            before, losses = values[at], []
            for step in (1e-3, -1e-3):
                values[at] = before + step
                losses.append(network.gradients(WORDS, windows, labels, weight)[0])
            values[at] = before
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grad[name][at], abs=2e-6), (name, at)


def test_grams_of_each_word():
    codes, first = tx.grams([b"abcd", b"x", b"abcd"])
    ends = [*first[1:], len(codes)]
    own = [sorted(codes[a:b]) for a, b in zip(first, ends)]
    assert [len(x) for x in own] == [4 + 2, 1 + 0, 4 + 2] and own[0] == own[2] != own[1]
    assert tx.grams([b"y"])[0] == tx.grams([b"q", b"y"])[0][1:]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 56, 57, 500])
def test_windows_overlap_and_cover_every_word(n):
    firsts = tx.window_starts(n)
    covered = {k for f in firsts for k in range(f, min(f + tx.WINDOW, n))}
    assert covered == set(range(n)) and (n <= tx.WINDOW or all(f + tx.WINDOW <= n for f in firsts))
    assert all(b - a <= tx.STRIDE for a, b in zip(firsts, firsts[1:]))


def test_long_texts_go_piece_by_piece(network, monkeypatch):
    net = tx.Network(network.vocabulary, {k: v.astype(np.float32) for k, v in network.p.items()})
    draw = np.random.default_rng(1)
    long = b" ".join(WORDS[k] for k in draw.integers(0, 5, 3000))
    documents = [long, b"", b"a bb", long[:777], b"ccc" * 500]
    whole = {(nr, first): odds for nr, first, odds in net.windows_of(documents)}
    monkeypatch.setattr(tx, "BLOCK", 300)
    pieces = {(nr, first): odds for nr, first, odds in net.windows_of(documents)}
    assert set(pieces) == set(whole) and {nr for nr, _ in whole} == set(range(5))
    assert all(pieces[k] == pytest.approx(whole[k], abs=1e-4) for k in whole)
    assert sorted(f for nr, f in whole if nr == 0) == tx.window_starts(3000)


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, tx.fit(tx.training_rows(docs, labels))


def test_held_out_documents_and_planted_ones(spark, learnt):
    docs, labels, model = learnt
    held = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").filter((tx.crc_mod(F.col("doc_id"), 5) == 0) & (F.col("doc_id") % 2 == 0))
    got = tx.score_texts(held, model).select("toxic", "score").collect()
    right = [(r["score"] >= 0.5) == r["toxic"] for r in got]
    assert len(right) > 300 and sum(right) / len(right) > 0.96
    clean = b"The and attion to thanedble the, anea. Eriner thanea ndent. " * 300
    scores = model.score([clean, clean + b"you stupid pathetic idiot, worthless scum " + clean])
    assert scores[0] < 0.5 < scores[1]


def test_cases(spark, learnt):
    model = learnt[2]
    odd = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, " \n", 7), (None, "idiot", 8), (None, "idiot", 8), (4, "é" * 300_000, 9)], "doc_id long, text string, score long").withColumn("window", F.lit(1))
    found = tx.score_texts(odd, model).collect()
    assert len(found) == 6 and len({r["score"] for r in found if r["doc_id"] in (1, 2, 3)}) == 1 and all(0 <= r["score"] <= 1 for r in found)
    assert tx.score_texts(odd.limit(0), model).count() == 0
    by_window = tx.score_windows(odd, model).groupBy("doc_id").agg(F.max("score").alias("score")).collect()
    assert {r["doc_id"]: round(r["score"], 5) for r in by_window} == {r["doc_id"]: round(r["score"], 5) for r in found}


def test_whole_query(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(tx.training_rows(docs, labels))
    want = {r["doc_id"]: float(model.score([(r["text"] or "").encode()])[0]) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in tx.op11_toxicity(spark, folder).collect()}
    assert {k: r["score"] for k, r in got.items()} == pytest.approx(want, abs=1e-4)
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())


def test_without_labels_and_of_one_label(spark):
    rows = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "z", None), (4, "w", 7)], "doc_id long, text string, label int")
    assert tx.fit(rows).constant == 1.0
    assert tx.fit(rows.limit(0)).constant == 0.5
    assert tx.score_texts(rows, tx.fit(rows.limit(0))).select("score").distinct().collect()[0][0] == 0.5


def test_sample_is_bounded_and_heeds_null_and_repeated_ids(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).cast("long").alias("doc_id"), F.concat(F.lit("text nr "), "id").alias("text"), (F.col("id") % 2).cast("int").alias("label"))
    taken = []
    original, tx.train = tx.train, lambda samples, epochs: taken.extend(samples)
    try:
        tx.fit(rows, per_label=100)
    finally:
        tx.train = original
    assert [sum(y == k for y, _ in taken) for k in (0, 1)] == [100, 100]
