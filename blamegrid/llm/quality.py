"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (logs of sizes, logits of shares). For both
classes the mean and covariance follow from sums over all labelled training rows, gathered by Spark as
one sum per matrix cell. A covariance is shrunk towards the pooled one and then towards a multiple of
the identity; its Cholesky factor is computed once and kept in the model. How much it is shrunk is chosen by
cross-validation over FOLDS folds: the density of held-out rows follows from their own sums, so the sums by fold
are all that is needed. The score is the logistic
function of the difference of the two log densities (from Mahalanobis distances) plus the log prior odds.

Cases: a null or empty text has its statistics at their lower ends and gets a score like any other; a
null quality isn't learnt from; without both classes among the training rows every score is the share of
label 1 (0.5 without rows); repeated rows count as often as they come; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, materialize, slices, table, texts

#: Shrinkage that is tried: towards the pooled covariance, and towards a multiple of the identity.
TO_POOLED, TO_IDENTITY = (0.0, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0), (0.001, 0.01, 0.03, 0.1, 0.3)
FOLDS = 5

#: Statistics in the order of the vector.
STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "symbols", "exclaims", "bars", "stops",
    "line_words", "distinct_words", "repeated_lines", "symbol_words", "echoes", "entropy",
)
DIM = len(STATISTICS)

_CLASS = np.zeros(256, np.int64)  # 0 letter or other byte of a character, 1 upper, 2 digit, 3 white space, 4 stop or comma, 5 !, 6 |, 7 other symbol
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 7
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-?"]] = 4
_CLASS[33], _CLASS[124] = 5, 6
_CONTINUES = np.zeros(256, bool)
_CONTINUES[128:192] = True
_ODD = re.compile(rb"[^\w\s.,;:'\"?!()\x80-\xff-]{2,}")


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole - part, 0.0) + 0.5 + 0.02 * whole)))


def statistics(text: bytes) -> list[float]:
    """The vector of a text: finite for every text, the empty one too."""
    codes = np.frombuffer(text, np.uint8)
    seen = np.bincount(codes, minlength=256)
    kinds = np.bincount(_CLASS, weights=seen, minlength=8)
    chars = float(len(codes) - seen[128:192].sum())
    words = text.split()
    lines = [s for s in (line.strip() for line in text.split(b"\n")) if s]
    n = float(len(words))
    inked = chars - kinds[3]
    share = seen[seen > 0] / max(len(codes), 1)
    extra = sum(len(x) for x in lines) - sum(len(x) for x in set(lines))
    return [
        np.log1p(chars),
        np.log1p(n),
        np.log1p(inked / max(n, 1.0)),
        _logit(kinds[1], inked),
        _logit(kinds[2], inked),
        _logit(kinds[7], inked),
        _logit(kinds[5], n),
        _logit(kinds[6], n),
        _logit(kinds[4], n),
        np.log1p(n / max(len(lines), 1)),
        np.log((len(set(words)) + 1.0) / (n + 1.0)) / np.log(n + 3.0),
        _logit(extra, chars),
        _logit(len(_ODD.findall(text)), n),
        _logit(sum(map(eq, words, words[1:])), n),
        float(-(share * np.log(share)).sum()),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the vector ``stats`` of each text."""

    def measure(batches):
        for part in slices(batches, "text"):
            rows = [statistics(t) for t in texts(part, "text")]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "stats": pa.array(rows, pa.list_(pa.float64()))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, "doc_id long, stats array<double>")


@dataclass
class Discriminant:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # lower Cholesky factors, cached
    offset: float  # log prior odds and half the difference of log determinants

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.offset)
        far = [(np.linalg.solve(f, (x - m).T) ** 2).sum(axis=0) for m, f in zip(self.means, self.factors)]
        odds = self.offset + 0.5 * (far[0] - far[1])
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))


CELLS = 1 + DIM + DIM * DIM


def moments(rows: DataFrame) -> DataFrame:
    """fold, label, cell, total of ``rows(label, stats)``: count, sums and products, summed per task, then per cell.

    A row's fold is a hash of its statistics: equal rows are in one fold.
    """

    def part(batches):
        total = np.zeros((FOLDS, 2, CELLS))
        for batch in batches:
            labels, folds = np.asarray(batch.column("label")), np.asarray(batch.column("fold"))
            x = np.array(batch.column("stats").to_pylist(), float).reshape(-1, DIM)
            for f in range(FOLDS):
                for k in (0, 1):
                    own = x[(labels == k) & (folds == f)]
                    total[f, k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        fold, label, cell = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"fold": fold.ravel(), "label": label.ravel(), "cell": cell.ravel(), "total": total.ravel()})

    dealt = rows.select("label", "stats", F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).alias("fold"))
    return dealt.mapInArrow(part, "fold long, label long, cell long, total double").groupBy("fold", "label", "cell").agg(F.sum("total").alias("total"))


def _moments_of(total: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and mean product of (CELLS,) sums."""
    n = max(total[0], 1.0)
    return float(total[0]), total[1 : 1 + DIM] / n, total[1 + DIM :].reshape(DIM, DIM) / n


def shrunk(total: np.ndarray, to_pooled: float, to_identity: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Means and shrunk covariances of both classes, of (2, CELLS) sums."""
    parts = [_moments_of(t) for t in total]
    means = [m for _, m, _ in parts]
    spread = [p - np.outer(m, m) for _, m, p in parts]
    pooled = sum(n * s for (n, _, _), s in zip(parts, spread)) / max(total[:, 0].sum(), 1.0)
    found = []
    for s in spread:
        s = (1 - to_pooled) * s + to_pooled * pooled
        level = max(np.trace(s) / DIM, 1e-6)
        found.append((1 - to_identity) * s + to_identity * level * np.eye(DIM))
    return means, found


def held_out_density(total: np.ndarray, to_pooled: float, to_identity: float) -> float:
    """Log density of each fold's rows under the model of the other folds, summed; of (FOLDS, 2, CELLS) sums."""
    found = 0.0
    for own in total:
        means, spread = shrunk(total.sum(axis=0) - own, to_pooled, to_identity)
        for k in (0, 1):
            n, mean, product = _moments_of(own[k])
            m = means[k]
            around = product - np.outer(m, mean) - np.outer(mean, m) + np.outer(m, m)
            found -= 0.5 * n * (np.linalg.slogdet(spread[k])[1] + np.trace(np.linalg.solve(spread[k], around)))
    return found


def fit(rows: DataFrame, to_pooled: float | Sequence[float] = TO_POOLED, to_identity: float | Sequence[float] = TO_IDENTITY) -> Discriminant:
    """Fits the model to ``rows(label, stats)``; the driver receives 2 (1 + d + d²) numbers for each fold.

    Of several strengths of shrinkage those of the greatest density of held-out rows are taken.
    """
    total = np.zeros((FOLDS, 2, CELLS))
    for r in moments(rows).collect():
        total[r["fold"], r["label"], r["cell"]] = r["total"]
    whole = total.sum(axis=0)
    n = whole[:, 0]
    if not n.all():
        return Discriminant([], [], float(n[1] / n.sum()) if n.sum() else 0.5)
    choices = list(itertools.product(*(np.atleast_1d(x).tolist() for x in (to_pooled, to_identity))))
    best = max(choices, key=lambda c: held_out_density(total, *c)) if len(choices) > 1 else choices[0]
    means, spread = shrunk(whole, *best)
    factors = [np.linalg.cholesky(s) for s in spread]
    logdet = [2.0 * np.log(np.diag(f)).sum() for f in factors]
    return Discriminant(means, factors, float(np.log(n[1] / n[0]) + 0.5 * (logdet[0] - logdet[1])))


def apply(rows: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of ``rows(doc_id, stats)``."""

    def score(batches):
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), float).reshape(-1, DIM)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(x), pa.float64())})

    return rows.mapInArrow(score, "doc_id long, score double")


def score_texts(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``docs`` with a column ``score``, in one pass over their ``text``."""
    docs = docs.drop("score")

    def score(batches):
        for part in slices(batches, "text"):
            x = np.array([statistics(t) for t in texts(part, "text")]).reshape(-1, DIM)
            columns = {name: part.column(name) for name in part.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(model.score(x), pa.float64())})

    return docs.mapInArrow(score, T.StructType([*docs.schema, T.StructField("score", T.DoubleType())]))


def measured(docs: DataFrame, column: str = "stats") -> DataFrame:
    """``docs`` with the statistics of their ``text`` in ``column``, for those who need the texts and their scores: each text is measured once."""

    def measure(batches):
        for part in slices(batches, "text"):
            rows = pa.array([statistics(t) for t in texts(part, "text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({name: part.column(name) for name in part.schema.names} | {column: rows})

    return docs.mapInArrow(measure, T.StructType([*docs.schema, T.StructField(column, T.ArrayType(T.DoubleType()))]))


def score_measured(docs: DataFrame, model: Discriminant, column: str = "stats", score: str = "score") -> DataFrame:
    """``docs`` of ``measured`` with a column ``score`` instead of their statistics."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(column).to_pylist(), float).reshape(-1, DIM)
            columns = {name: batch.column(name) for name in batch.schema.names if name != column}
            yield pa.RecordBatch.from_pydict(columns | {score: pa.array(model.score(x), pa.float64())})

    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema if f.name != column), T.StructField(score, T.DoubleType())]))


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows of the training fold: crc32(doc_id) mod 3 is not 1."""
    known = labels.filter(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 3) != 1))
    return stats.join(known.select("doc_id", F.col("quality").cast("long").alias("label")), "doc_id").select("label", "stats")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(with_statistics(table(spark, sf_dir, "documents")), "stats")
    model = fit(training_rows(stats, table(spark, sf_dir, "labels")))
    return apply(stats, model).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
