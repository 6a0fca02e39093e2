"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters.

A text is lower-cased (A-Z) and cut into words; windows of WINDOW words start every STRIDE words, so that they overlap, and the
last one ends with the text. A word's input is a learnt vector of the word, if it is of the vocabulary, beside the mean of learnt vectors of
its hashed character trigrams and fivegrams, the word's ends included. Two gated recurrent layers read a window forwards and
backwards, attention weighs their states into one vector, a linear layer turns that into log odds. A text's score is that
of its most toxic window, and all windows of all texts are scored, a long text piece by piece.

Labels tell texts, not windows: training (in numpy, by Adam on gradients worked out by hand) draws windows of toxic texts by their present
odds, and takes of a clean text the most toxic one, random ones, and one that repeats a word of it all along. It sees a bounded sample: PER_LABEL labelled rows of each label, those least by a hash
of id and text, with WINDOWS_PER_TEXT windows each, spread over the whole text. The vocabulary is of words in MIN_TEXTS texts of
the sample or more; what is rarer is known by its characters.

Cases: null and empty texts, and texts without words, have one empty window, whose score is that of nothing (the network's bias);
a null toxic, or one that is neither 0 nor 1, isn't learnt from; without both labels among the training rows every score is the share of
label 1 (0.5 without rows); repeated rows are judged one by one; several labels of one doc_id are all learnt from; an empty table gives an empty
result; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, crc_mod, discard, materialize, slices, table, texts

WINDOW, STRIDE = 32, 24
PER_LABEL, WINDOWS_PER_TEXT = 2000, 24
VOCABULARY, MIN_TEXTS = 20_000, 3
WORD_DIM, CHAR_DIM, CHAR_BITS = 12, 12, 13
HIDDEN, ATTENTION = 16, 16
EPOCHS, BATCH, RATE, DECAY = 7, 192, 0.012, 0.02
PICKS = 2  # windows of a text in an epoch
DROPPED = (0.1, 0.4)  # of words' own vectors and of their characters', in training
STEPS = 160  # at least: small samples are gone through more often
CLEAN_WEIGHT = 0.6  # of the loss, whatever the labels' numbers
BLOCK = 1 << 20  # bytes of text whose words are numbered together
CHUNK = 2048  # windows that go through the network together
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, ...) sums of the rows that are for each place."""
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    found = np.zeros((n, rows.shape[1]), np.float32)
    found[places] = np.add.reduceat(rows[order], first, axis=0)
    return found


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the character trigrams and fivegrams of all words, word after word, and where each word's begin."""
    joined = b"".join(b"\x02" + w + b"\x03" for w in words)
    c = np.frombuffer(joined, np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(c)) - first[owner]
    codes, owners = [], []
    for n, seed in ((3, 0x9E3779B1), (5, 0x85EBCA77)):
        at = np.flatnonzero(inside + n <= sizes[owner]) if n > 3 else np.flatnonzero(inside + np.minimum(n, sizes[owner]) <= sizes[owner])
        code = np.full(len(at), seed, np.uint32)
        for k in range(n):
            code = (code ^ c[np.minimum(at + k, len(c) - 1)]) * np.uint32(0x01000193)
        codes.append((code ^ (code >> np.uint32(15))) >> np.uint32(0) & np.uint32((1 << CHAR_BITS) - 1))
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(codes)[order], np.searchsorted(owners[order], np.arange(len(words)))


@dataclass
class Network:
    """Parameters, and what the vocabulary is; row 0 of ``word`` is that of all other words and stays zero."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None  # the score of everything, where nothing could be learnt

    def start(self, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        inputs = WORD_DIM + CHAR_DIM

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": draw(len(self.vocabulary) + 1, WORD_DIM, scale=0.1), "char": draw(1 << CHAR_BITS, CHAR_DIM, scale=0.3)}
        for side in "fb":
            self.p |= {f"w{side}": draw(inputs, 3 * HIDDEN, scale=inputs**-0.5), f"u{side}": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": draw(2 * HIDDEN, ATTENTION, scale=0.2), "a0": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION, scale=0.3), "o": draw(2 * HIDDEN, scale=0.2), "o0": np.full(1, -1.0, np.float32)}
        self.p["word"][0] = 0
        return self

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(input vectors, rows of the vocabulary, grams' codes, their first places) of distinct words."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        codes, first = grams(words)
        sums = np.add.reduceat(self.p["char"][codes], first, axis=0)
        share = np.diff(np.append(first, len(codes)))[:, None].astype(np.float32)
        return np.hstack([self.p["word"][ids], sums / share]), ids, codes, first

    def projected(self, x: np.ndarray) -> list[np.ndarray]:
        """What words contribute to the gates of both directions; a last row for what lies beyond a window's end."""
        return [np.vstack([x @ self.p[f"w{s}"] + self.p[f"c{s}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for s in "fb"]

    def forward(self, gates: list[np.ndarray], windows: np.ndarray, keep: bool = False):
        """Log odds of ``windows`` (n, WINDOW) of numbers of words, -1 beyond the end; with what ``backward`` needs if ``keep``."""
        n, length = windows.shape
        mask = windows >= 0
        full = mask.all(axis=0)
        states = np.empty((length, n, 2 * HIDDEN), np.float32)
        kept: list[list] = [[], []]
        for side, name in enumerate("fb"):
            u = self.p[f"u{name}"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(length) if side == 0 else range(length - 1, -1, -1):
                g = gates[side][windows[:, t]]
                r = h @ u
                zr = _sigmoid(g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
                z, reset, inner = zr[:, :HIDDEN], zr[:, HIDDEN:], r[:, 2 * HIDDEN :]
                new = np.tanh(g[:, 2 * HIDDEN :] + reset * inner)
                after = new + z * (h - new)
                if not full[t]:
                    after = np.where(mask[:, t, None], after, h)
                if keep:
                    kept[side].append((t, h, z, reset, inner, new))
                h = after
                states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
        hidden = np.tanh(states @ self.p["a"] + self.p["a0"])
        score = np.where(mask.T, hidden @ self.p["v"], np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight *= mask.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        odds = pooled @ self.p["o"] + self.p["o0"]
        return (odds, (mask, states, kept, hidden, weight, pooled)) if keep else odds

    def backward(self, d_odds: np.ndarray, windows: np.ndarray, memory, n_words: int) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        """Gradients of the parameters behind the words, and of the gates of ``n_words`` words, for d loss / d log odds."""
        mask, states, kept, hidden, weight, pooled = memory
        grad = {"o": pooled.T @ d_odds, "o0": d_odds.sum(keepdims=True)}
        d_pooled = np.outer(d_odds, self.p["o"])
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["v"] = np.einsum("tn,tna->a", d_score, hidden)
        d_hidden = d_score[:, :, None] * self.p["v"] * (1 - hidden * hidden)
        grad["a0"] = d_hidden.sum(axis=(0, 1))
        grad["a"] = np.tensordot(states, d_hidden, axes=((0, 1), (0, 1)))
        d_states = d_states + d_hidden @ self.p["a"].T
        d_gates = []
        for side, name in enumerate("fb"):
            u = self.p[f"u{name}"]
            d_u, d_h = np.zeros_like(u), np.zeros((windows.shape[0], HIDDEN), np.float32)
            d_in = np.empty((windows.shape[1], len(windows), 3 * HIDDEN), np.float32)
            for t, h, z, reset, inner, new in reversed(kept[side]):
                d_after = d_h + d_states[t, :, side * HIDDEN : (side + 1) * HIDDEN]
                seen = mask[:, t, None]
                d_own = np.where(seen, d_after, 0)
                d_new = d_own * (1 - z) * (1 - new * new)
                d_z = d_own * (h - new) * z * (1 - z)
                d_reset = d_new * inner * reset * (1 - reset)
                d_in[t, :, :HIDDEN], d_in[t, :, HIDDEN : 2 * HIDDEN], d_in[t, :, 2 * HIDDEN :] = d_z, d_reset, d_new
                d_r = np.hstack([d_z, d_reset, d_new * reset])
                d_u += h.T @ d_r
                d_h = np.where(seen, d_own * z + d_r @ u.T, d_after)
            grad[f"u{name}"] = d_u
            d_gates.append(summed(windows.T.ravel() + 1, d_in.reshape(-1, 3 * HIDDEN), n_words + 1)[1:])
        return grad, d_gates

    def gradients(self, words: list[bytes], windows: np.ndarray, labels: np.ndarray, importance: np.ndarray, kept: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted sum of the logistic loss of windows over ``words``, and the gradients of all parameters; ``kept`` scales the words' inputs."""
        x, ids, codes, first = self.inputs(words)
        x = x if kept is None else x * kept
        odds, memory = self.forward(self.projected(x), windows, keep=True)
        chance = _sigmoid(np.clip(odds, -30, 30))
        loss = float((importance * (np.logaddexp(0, odds) - labels * odds)).sum())
        grad, d_gates = self.backward((importance * (chance - labels)).astype(np.float32), windows, memory, len(words))
        d_x = sum(d @ self.p[f"w{s}"].T for s, d in zip("fb", d_gates))
        d_x = d_x if kept is None else d_x * kept
        for s, d in zip("fb", d_gates):
            grad[f"w{s}"], grad[f"c{s}"] = x.T @ d, d.sum(axis=0)
        grad["word"] = summed(ids, d_x[:, :WORD_DIM], len(self.p["word"]))
        grad["word"][0] = 0
        sizes = np.diff(np.append(first, len(codes)))
        grad["char"] = summed(codes, np.repeat(d_x[:, WORD_DIM:] / sizes[:, None], sizes, axis=0), len(self.p["char"]))
        return loss, grad

    def windows_of(self, documents: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(number of the text, first word, log odds) of every window of every text; one window for a text without words.

        Words are numbered block by block of BLOCK bytes; a text that is longer goes on in the next block where its last window began.
        """
        words: dict[bytes, int] = {}
        places: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for nr, document in enumerate(documents):
            start, carried, done, at = 0, [], 0, 0  # done: windows at the front of ``carried`` that are scored already
            while True:
                gap = _GAP.search(document, at + BLOCK)
                stop = gap.start() if gap else len(document)
                found = carried + document[at:stop].translate(ALNUM_TABLE).split()
                size += stop - at
                at = stop
                last = at >= len(document)
                numbers = np.fromiter((words.setdefault(w, len(words)) for w in found), np.int64, len(found))
                firsts = window_starts(len(found), last)
                places += [(nr, start + f, numbers[f : f + WINDOW]) for f in firsts[done:]]
                if firsts:
                    found, start, done = found[firsts[-1] :], start + firsts[-1], 1
                carried = found
                if size >= BLOCK:
                    yield from self._score(words, places)
                    words, places, size = {}, [], 0
                if last:
                    break
        yield from self._score(words, places)

    def _score(self, words: dict[bytes, int], places: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, float]]:
        if not places:
            return
        gates = self.projected(self.inputs(list(words))[0]) if words else [np.zeros((1, 3 * HIDDEN), np.float32)] * 2
        for low in range(0, len(places), CHUNK):
            part = places[low : low + CHUNK]
            for (nr, first, _), odds in zip(part, self.forward(gates, padded([w for _, _, w in part]))):
                yield nr, first, float(odds)

    def score(self, documents: list[bytes]) -> np.ndarray:
        """The score of each text's most toxic window."""
        if self.constant is not None:
            return np.full(len(documents), self.constant)
        best = np.full(len(documents), -np.inf)
        for nr, _, odds in self.windows_of(documents):
            best[nr] = max(best[nr], odds)
        return _sigmoid(np.clip(best, -30, 30))


def window_starts(n: int, last: bool = True) -> list[int]:
    """First words of the windows over ``n`` words: every STRIDE words, the last one flush with the end. If more words follow, full windows alone."""
    if n <= WINDOW:
        return [0] if last or n == WINDOW else []
    firsts = list(range(0, n - WINDOW + 1, STRIDE))
    return [*firsts, n - WINDOW] if last and firsts[-1] < n - WINDOW else firsts


def padded(windows: list[np.ndarray]) -> np.ndarray:
    full = np.full((len(windows), WINDOW), -1, np.int64)
    for k, w in enumerate(windows):
        full[k, : len(w)] = w
    return full


def spread_windows(document: bytes, most: int = WINDOWS_PER_TEXT) -> list[bytes]:
    """At most ``most`` windows of a text (their words, blank between them), spread evenly over all of it."""
    words = document.translate(ALNUM_TABLE).split()
    firsts = window_starts(len(words))
    if len(firsts) > most:
        firsts = [firsts[k * (len(firsts) - 1) // (most - 1)] for k in range(most)]
    return [b" ".join(words[f : f + WINDOW]) for f in firsts]


def train(samples: list[tuple[int, list[bytes]]], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Learns from (label, windows) of texts, in their order."""
    labels = np.array([y for y, _ in samples], float)
    if len(set(labels)) < 2:
        return Network(constant=float(labels.mean()) if len(labels) else 0.5)
    known = Counter(w for _, own in samples for w in {w for x in own for w in x.split()})
    frequent = sorted((w for w, n in known.items() if n >= MIN_TEXTS), key=lambda w: (-known[w], w))[:VOCABULARY]
    network = Network({w: k + 1 for k, w in enumerate(frequent)}).start(seed)
    names: dict[bytes, int] = {}
    windows = padded([np.array([names.setdefault(w, len(names)) for w in x.split()], np.int64) for _, own in samples for x in own])
    words = list(names)
    sizes = np.array([len(own) for _, own in samples])
    first = np.cumsum(sizes) - sizes
    share = {y: part / (labels == y).sum() for y, part in ((0.0, CLEAN_WEIGHT), (1.0, 1 - CLEAN_WEIGHT))}
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    epochs = max(epochs, -(-STEPS * BATCH // (len(labels) * (PICKS + 1))))
    owner = np.repeat(np.arange(len(labels)), sizes)
    clean = np.flatnonzero(labels == 0)
    for epoch in range(epochs):
        picks = [first + rng.integers(0, sizes) for _ in range(PICKS)]
        if epoch >= epochs // 4:
            gates = network.projected(network.inputs(words)[0])
            odds = np.concatenate([network.forward(gates, windows[k : k + CHUNK]) for k in range(0, len(windows), CHUNK)])
            # a toxic text's windows are drawn by their odds; of a clean one the most toxic comes and the others are as they are
            for k in range(PICKS):
                drawn = np.lexsort((odds + rng.gumbel(size=len(odds)), owner))[first + sizes - 1]
                picks[k] = np.where(labels == 1, drawn, picks[k])
            picks[0] = np.where(labels == 0, np.lexsort((odds, owner))[first + sizes - 1], picks[0])
        other = windows[picks[1][clean]]
        said = other[np.arange(len(clean)), rng.integers(0, WINDOW, len(clean)) % np.maximum((other >= 0).sum(axis=1), 1)]
        chosen = np.concatenate([*(windows[p] for p in picks), np.repeat(said[:, None], WINDOW, axis=1)])
        of = np.concatenate([*(np.arange(len(labels)) for _ in picks), clean])
        weight = np.where(labels[of] == 1, share[1.0] / PICKS, share[0.0] / (PICKS + 1))
        order = rng.permutation(len(chosen))
        for low in range(0, len(order), BATCH):
            own = order[low : low + BATCH]
            numbers, local = np.unique(chosen[own], return_inverse=True)
            beyond = int(numbers[0] == -1)
            drop = np.repeat(rng.random((len(numbers) - beyond, 2)) >= DROPPED, (WORD_DIM, CHAR_DIM), axis=1) / np.repeat(1 - np.array(DROPPED), (WORD_DIM, CHAR_DIM))
            loss, grad = network.gradients([words[k] for k in numbers[beyond:]], local.reshape(len(own), WINDOW) - beyond, labels[of[own]], weight[own] / weight[own].sum(), drop.astype(np.float32))
            step += 1
            rate = RATE * min(1.0, 2.0 * (1 - epoch / epochs)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                if k in ("word", "char"):
                    network.p[k] *= np.float32(1 - rate * DECAY)
                network.p[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return network


def fit(rows: DataFrame, per_label: int = PER_LABEL, epochs: int = EPOCHS) -> Network:
    """Learns from ``rows(doc_id, text, label)``; the driver receives windows of 2 x ``per_label`` texts at most, of WINDOW words each."""
    keyed = rows.filter(F.col("label").isin(0, 1)).withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))

    def cut(batches):
        for part in slices(batches, "text"):
            own = [spread_windows(t) for t in texts(part, "text")]
            yield pa.RecordBatch.from_pydict({"label": part.column("label"), "key": part.column("key"), "windows": pa.array(own, pa.list_(pa.binary()))})

    samples = []
    for label in (0, 1):
        least = keyed.filter(F.col("label") == label).select("key").orderBy("key").limit(per_label)
        border = least.agg(F.max("key")).first()[0]
        if border is not None:
            met = keyed.filter((F.col("label") == label) & (F.col("key") <= border)).select("label", "key", "text")
            found = met.mapInArrow(cut, "label int, key long, windows array<binary>").orderBy("key", "windows").limit(per_label).collect()
            samples += [(r["key"], r["label"], [bytes(w) for w in r["windows"]]) for r in found]
    return train([(label, windows) for _, label, windows in sorted(samples)], epochs)


def score_texts(docs: DataFrame, model: Network) -> DataFrame:
    """``docs`` with a column ``score``, in one pass over their ``text``."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for part in slices(batches, "text"):
            columns = {name: part.column(name) for name in part.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(shared.value.score(texts(part, "text")), pa.float64())})

    return docs.mapInArrow(score, T.StructType([*docs.schema, T.StructField("score", T.DoubleType())]))


def score_windows(docs: DataFrame, model: Network) -> DataFrame:
    """doc_id, first (number of its first word) and score of every window of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])

    def score(batches):
        for part in slices(batches, "text"):
            ids, held = part.column("doc_id").to_pylist(), []
            model = shared.value
            found = model.windows_of(texts(part, "text")) if model.constant is None else ((k, 0, np.log(model.constant / max(1 - model.constant, 1e-12))) for k in range(len(ids)))
            for nr, first, odds in found:
                held.append((ids[nr], first, float(_sigmoid(np.clip(odds, -30, 30)))))
                if len(held) == CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, first long, score double")


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, text and label of the training fold (crc32(doc_id) mod 5 is not 0): of each label the ``per_label`` rows of ``labels`` of the least hashes that have a text; stored.

    Ids alone are joined and chosen; texts meet no more than the chosen ids, which are broadcast.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("key", F.xxhash64(F.col("doc_id").cast("string")))
    chosen = [there.filter(F.col("label") == y).orderBy("key", "doc_id").limit(per_label) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]).drop("key"))  # 2 x per_label rows
    return materialize(docs.select("doc_id", "text").join(few, "doc_id"), "training")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = training_rows(docs, table(spark, sf_dir, "labels"))
    model = fit(rows)
    discard(rows)
    return score_texts(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
