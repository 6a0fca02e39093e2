"""Language identification in two steps: first the family, then one-versus-one linear SVMs inside it.

A text becomes a unit vector of square-rooted counts of hashed letter trigrams (whole text, blanks for
whatever is no letter). Families are separated by linear SVMs for each pair of families, the languages
of a family by linear SVMs for each pair of them; each SVM (squared hinge loss) is fitted by dual
coordinate descent in a Spark task of its own, and its margin is turned into a probability by a logistic
fit. The score of a prediction is the probability of the family times that of the language in it.

Learning uses ``per_language`` labelled rows of each language (a documented bound of the model's input): those of the
least hashes of id and text; prediction covers every text.

Cases: a text that is null or without letters is ``und`` with score 0; so is every text when no labelled
row exists; a language outside FAMILIES is a family of its own; rows without doc_id, and rows that share one, are learnt from like
others, by their texts; rows equal in id and text are learnt from once and judged one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, slices, table, texts

DIM = 2048
PER_LANGUAGE = 1000
COST, EPOCHS = 1.0, 20
UNKNOWN = "und"

#: ISO 639-1 codes of each family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "bn", "ur", "pa", "mr", "gu", "ne"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_SHIFT = np.uint32(32 - 11)  # DIM is 2 ** 11


def family(lang: str) -> str:
    return FAMILY_OF.get(lang, f"only {lang}")


def trigrams(text: bytes) -> np.ndarray | None:
    """The unit vector of a text, or None if it has no letters."""
    lowered = text.decode("utf-8", "replace").lower()
    data = b" ".join(lowered.encode().translate(_LETTERS).split())
    if not data or not (any(97 <= b <= 122 for b in data[:64]) or any(c.isalpha() for c in lowered)):
        return None
    c = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    code = (c[:-2] * _MIX[0] + c[1:-1]) * _MIX[1] + c[2:]
    code = (code ^ (code >> np.uint32(15))) * _MIX[2]
    x = np.sqrt(np.bincount(code >> _SHIFT, minlength=DIM))
    return (x / np.sqrt((x * x).sum())).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights and, last, the bias of a linear SVM with squared hinge loss; classes weigh alike."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    diagonal = share / cost  # 1 / (2 C), C being cost / (2 share)
    norm = (x * x).sum(axis=1) + diagonal
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1.0 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def fit_logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Platt's smoothed targets, Newton steps)."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.stack([margin, np.ones_like(margin)])
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(theta @ z, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))) @ z.T + 1e-3 * np.eye(2), z @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


@dataclass
class Node:
    """Classes and the SVM of each pair of them: score > 0 speaks for the first."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None  # (pairs, DIM + 1)
    logistic: np.ndarray | None = None  # (pairs, 2)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class with most pairwise probability, and that probability's mean."""
        if not self.pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        p = 1 / (1 + np.exp(-np.clip(margin * self.logistic[:, 0] + self.logistic[:, 1], -30, 30)))
        total = np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(self.pairs):
            total[:, a] += p[:, k]
            total[:, b] += 1 - p[:, k]
        best = total.argmax(axis=1)
        return best, total[np.arange(len(x)), best] / (len(self.classes) - 1)


@dataclass
class Identifier:
    root: Node
    inner: dict[str, Node]

    def predict(self, documents: list[bytes]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(documents), np.zeros(len(documents))
        vectors = [(i, v) for i, v in enumerate(map(trigrams, documents)) if v is not None]
        if not vectors or not self.root.classes:
            return langs, scores
        rows, x = np.array([i for i, _ in vectors]), np.stack([v for _, v in vectors])
        group, sure = self.root.decide(x)
        for k, name in enumerate(self.root.classes):
            own = np.flatnonzero(group == k)
            if len(own):
                best, p = self.inner[name].decide(x[own])
                for i, b in zip(rows[own], best):
                    langs[i] = self.inner[name].classes[b]
                scores[rows[own]] = sure[own] * p
        return langs, scores


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the vector (float32 bytes) of each text with letters."""

    def measure(batches):
        for part in slices(batches, "text"):
            rows = [
                (d, lang, v.tobytes())
                for d, lang, v in zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), map(trigrams, texts(part, "text")))
                if v is not None
            ]
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()))], ["doc_id", "lang", "vector"]
            )

    return docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(measure, "doc_id long, lang string, vector binary")


KEYS = 1 << 40  # hashes of rows


def row_key() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(9)), F.lit(KEYS))


def least_keys(known: DataFrame, counts: dict[str, int], most: int) -> dict[str, int]:
    """By language, the ``most``-th of the distinct keys of ``known(lang, key)``, in order; the last one where there are fewer.

    Only keys below a bound are gathered, some four times as many as asked for; where rows are repeated so often that
    these are too few, the bound is raised and the language looked at again.
    """
    bounds = {x: min(KEYS, 4 * most * KEYS // n + 1) for x, n in counts.items()}
    found: dict[str, int] = {}
    while bounds:
        bound = F.element_at(F.create_map(*(F.lit(v) for x, b in bounds.items() for v in (x, b))), F.col("lang"))
        keys = known.filter(F.col("lang").isin(*bounds)).filter(F.col("key") < bound).select("lang", "key").distinct()
        placed = keys.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("key"))).filter(F.col("place") <= most)
        ends = {r["lang"]: r for r in placed.groupBy("lang").agg(F.max("key").alias("key"), F.max("place").alias("n")).collect()}  # one row per language
        for x, b in list(bounds.items()):
            if (x in ends and ends[x]["n"] >= most) or b == KEYS:
                found[x] = ends[x]["key"] if x in ends else -1
                del bounds[x]
            else:
                bounds[x] = min(KEYS, 32 * b)
    return found


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Identifier:
    """Learns from ``docs(doc_id, text, lang)``; rows without lang are left out."""
    known = docs.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(counts)
    root = Node(sorted({family(x) for x in langs}))
    inner = {f: Node([x for x in langs if family(x) == f]) for f in root.classes}
    problems: list[tuple[Node, int, int]] = []
    member: dict[str, list[tuple[int, int]]] = {x: [] for x in langs}  # language: (problem, +1 or -1)
    for node, class_of in [(root, family), *((n, lambda x: x) for n in inner.values())]:
        for a in range(len(node.classes)):
            for b in range(a + 1, len(node.classes)):
                for x in langs:
                    if class_of(x) in (node.classes[a], node.classes[b]):
                        member[x].append((len(problems), 1 if class_of(x) == node.classes[a] else -1))
                problems.append((node, a, b))
    if problems:
        keyed = known.withColumn("key", row_key())
        ends = least_keys(keyed, counts, per_language)
        end = F.element_at(F.create_map(*(F.lit(v) for x in langs for v in (x, ends[x]))), F.col("lang"))
        sample = keyed.filter(F.col("key") <= end).dropDuplicates(["lang", "key"])
        places = F.create_map(
            *(v for x in langs for v in (F.lit(x), F.array(*(F.struct(F.lit(k).alias("problem"), F.lit(s).alias("side")) for k, s in member[x]))))
        )
        rows = vectors(sample).withColumn("place", F.explode(F.element_at(places, F.col("lang"))))

        def learn(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["doc_id", "vector"])
            x = np.frombuffer(b"".join(rows["vector"]), np.float32).reshape(-1, DIM)
            y = rows["side"].to_numpy(float)
            if len(np.unique(y)) < 2:
                w = np.concatenate([np.zeros(DIM), [y[0]]])
            else:
                w = fit_svm(x, y)
            slope = fit_logistic(x @ w[:-1] + w[-1], y)
            return pd.DataFrame({"problem": [rows["problem"].iloc[0]], "weights": [w.tolist()], "logistic": [list(slope)]})

        fitted = (
            rows.select("doc_id", "vector", "place.problem", "place.side")
            .groupBy("problem")
            .applyInPandas(learn, "problem int, weights array<double>, logistic array<double>")
            .collect()
        )  # one row per pair of classes
        found = {r["problem"]: r for r in fitted}
        neutral = {"weights": [0.0] * (DIM + 1), "logistic": [1.0, 0.0]}
        for k, (node, a, b) in enumerate(problems):
            r = found.get(k, neutral)
            node.pairs.append((a, b))
            node.weights = np.array([r["weights"]]) if node.weights is None else np.vstack([node.weights, r["weights"]])
            node.logistic = np.array([r["logistic"]]) if node.logistic is None else np.vstack([node.logistic, r["logistic"]])
    return Identifier(root, inner)


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """``docs`` (with a ``text``) plus lang_pred and lang_score."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for part in slices(batches, "text"):
            langs, scores = shared.value.predict(texts(part, "text"))
            columns = {name: part.column(name) for name in part.schema.names}
            columns |= {"lang_pred": pa.array(langs, pa.string()), "lang_score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(predict, T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows of the training fold: crc32(doc_id) mod 4 is not 2."""
    return docs.select("doc_id", "text", "lang").filter(crc_mod(F.col("doc_id"), 4) != 2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
