"""Event-level conditional logit: scaler, distributed Newton fit, scoring, out-of-fold prediction.

The loss of an event is the log-sum-exp of its candidates' scores less the root's score; an L2 term is
added once. With a positive L2 factor the objective is strictly convex, so damped Newton steps from zero
reach its one optimum. Each iteration is one pass over the persisted events: every partition returns its
part of loss, gradient and curvature for all folds at once, and the driver steps. A case is stored once: the models of all
folds but its own learn from it.

An event of many candidates lies in several rows, and maybe tasks. What a task knows of such an event is a partial
softmax: greatest score, mass, mean, and covariance around that mean; two of them merge into one of both, so
the event's own part of the sums is found after a shuffle of one partial per task, not of its candidates.

Up to WIDE features the curvature is the Hessian, and sums are added up in tasks until DRIVER_CELLS numbers or one
row a fold are left. Beyond that a Newton step is solved by conjugate gradients, whose passes return
products of the Hessian with a vector: d numbers a fold, and nothing of size d x d anywhere.

The same events give the same bits. The scaler's means come from sums in the order of a shuffle, so
fits of the same table agree to about 1e-15, well inside of the tolerance of a replay (1e-12).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import FEATURE_DIGEST, FEATURE_NAMES
from ..sources.scratch import materialize
from .contracts import integrity_verdict, model_violations
from .ranking import case_metrics, metric_diff, metric_groups, prediction_diff, ranked

#: A feature whose spread is below this share of its size counts as constant.
CONSTANT = 1e-12
#: Numbers of candidates' vectors in a partition (16 MB) and in a row (4 MB); partitions of small tables.
CELLS, BLOCK_CELLS, LEAST_PARTS = 2_000_000, 500_000, 8
FAN_IN, DRIVER_CELLS = 64, 1_000_000
#: Features up to which the Hessian is added up as a matrix.
WIDE = 256
BROADCAST_EVENTS = 100_000


def scaler_stats(vectors: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, ix, n, mean, scale): mean and population deviation over the candidate rows of a fold's training cases."""
    long = vectors.join(training_cases(folds), "case_id").select("fold", F.posexplode("features").alias("ix", "value"))
    stats = long.groupBy("fold", "ix").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    flat = F.col("sd") <= CONSTANT * F.greatest(F.abs(F.col("mean")), F.lit(1.0))
    return stats.select("fold", "ix", "n", "mean", F.when(flat, 1.0).otherwise(F.col("sd")).alias("scale"))


def training_cases(folds: DataFrame) -> DataFrame:
    """(fold, case_id) of the training side: all cases of other folds."""
    names = folds.agg(F.array_sort(F.collect_set("fold")).alias("folds"))
    spread = folds.join(F.broadcast(names)).select("case_id", F.col("fold").alias("own"), F.explode("folds").alias("fold"))  # one row: the folds
    return spread.filter(F.col("fold") != F.col("own")).select("fold", "case_id")


def event_parts(vectors: DataFrame, cells: int = CELLS) -> int:
    """Partitions for a fit: as many as the vectors' numbers ask for, ``cells`` of them each, LEAST_PARTS at least."""
    return max(LEAST_PARTS, (vectors.agg(F.sum(F.size("features"))).first()[0] or 0) // cells + 1)


@dataclass
class Events:
    """Rows of events (case_id, fold, block, blocks, x, n, root), dealt into ``parts``; ``received`` counts the numbers that came to the driver."""

    table: DataFrame
    parts: int
    spans: bool
    received: int = 0


def event_table(vectors: DataFrame, labels: DataFrame, folds: DataFrame, parts: int | None = None, block_cells: int | None = None) -> Events:
    """The events of a fit: case_id, fold (its own), x (candidates' numbers, one after the other), n and root (a place among them, or -1).

    An event of more than ``block_cells`` numbers comes in several blocks of its candidates, by a hash of their names.
    Blocks are dealt into ``parts`` partitions, always in the same way.
    """
    block_cells = block_cells or BLOCK_CELLS
    parts = parts or event_parts(vectors)
    sizes = vectors.groupBy("case_id").agg(F.sum(F.size("features")).alias("cells"))
    large = sizes.filter(F.col("cells") > block_cells).select(F.col("case_id").alias("of"), F.ceil(F.col("cells") / block_cells).cast("int").alias("blocks"))
    large = materialize(large, "large-events")
    count = large.limit(BROADCAST_EVENTS + 1).count()
    rows = vectors.withColumn("blocks", F.lit(1))
    if count:
        side = F.broadcast(large) if count <= BROADCAST_EVENTS else large  # its number is checked
        rows = vectors.join(side, F.col("case_id") == F.col("of"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("service"), F.col("blocks").cast("long"))).otherwise(F.lit(0)).cast("int")
    own = rows.groupBy("case_id", block.alias("block"), "blocks").agg(F.sort_array(F.collect_list(F.struct("service", "features"))).alias("own"))  # block_cells numbers
    met = own.join(labels.select("case_id", "root"), "case_id", "left").join(folds.select("case_id", "fold"), "case_id")
    names = F.transform("own", lambda o: o["service"])
    events = met.select(
        "case_id", "fold", "block", "blocks", F.flatten(F.transform("own", lambda o: o["features"])).alias("x"), F.size("own").alias("n"),
        (F.coalesce(F.array_position(names, F.col("root")), F.lit(0)) - 1).cast("int").alias("root"),
    )
    return Events(events.repartition(parts, "case_id", "block").sortWithinPartitions("case_id", "block"), parts, bool(count))


class Partial:
    """What is known of an event's softmax from some of its candidates; ``merge`` adds what is known from others."""

    def __init__(self, top: float, mass: float, mean: np.ndarray, other: np.ndarray, spread: np.ndarray, root: np.ndarray | None, root_score: float) -> None:
        self.top, self.mass, self.mean, self.other, self.spread, self.root, self.root_score = top, mass, mean, other, spread, root, root_score

    @classmethod
    def of(cls, x: np.ndarray, w: np.ndarray, right: np.ndarray, root: int) -> Partial:
        """Of candidates ``x``: means of ``x`` and of ``right`` and the covariance of the two, by the softmax of ``x @ w``."""
        score = x @ w
        top = score.max()
        p = np.exp(score - top)
        mass = p.sum()
        p /= mass
        mean, other = p @ x, p @ right
        return cls(top, mass, mean, other, (x - mean).T @ (p[:, None] * (right - other)), x[root] if root >= 0 else None, score[root] if root >= 0 else 0.0)

    def merge(self, more: Partial) -> Partial:
        top = max(self.top, more.top)
        masses = self.mass * np.exp(self.top - top), more.mass * np.exp(more.top - top)
        mass = sum(masses)
        own, share = masses[0] / mass, masses[1] / mass
        far, off = more.mean - self.mean, more.other - self.other
        spread = own * self.spread + share * more.spread + own * share * np.outer(far, off)
        with_root = self if self.root is not None else more
        return Partial(top, mass, self.mean + share * far, self.other + share * off, spread, with_root.root, with_root.root_score)

    def sums(self) -> tuple[float, np.ndarray, np.ndarray]:
        """The event's loss, gradient and curvature."""
        if self.root is None:
            raise ValueError("the root isn't among the candidates")
        return self.top + np.log(self.mass) - self.root_score, self.mean - self.root, self.spread


#: Sums of events that are done (case_id is null), or one partial of an event.
PART = "part int, fold int, case_id string, loss double, gradient array<double>, curvature array<double>, mass double, other array<double>, root array<double>, root_score double"
Right = Callable[[np.ndarray, int], np.ndarray]


def _row(part: int, fold: int, case: str | None, found: Partial | list) -> tuple:
    if isinstance(found, list):
        return part, fold, None, found[0], found[1].tolist(), found[2].ravel().tolist(), 0.0, [], [], 0.0
    root = [] if found.root is None else found.root.tolist()
    return part, fold, case, found.top, found.mean.tolist(), found.spread.ravel().tolist(), found.mass, found.other.tolist(), root, found.root_score


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PART.split(", ")])


def _parts(weights: dict[int, np.ndarray], right: Right):
    """Sums over a partition's events, for each fold over the events of all others; events in several blocks stay partials.

    ``weights`` are for numbers as stored; ``right`` gives what the curvature is the covariance of numbers with.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        total, partial = {}, {}
        for batch in batches:
            for case, own, blocks, flat, n, root in zip(batch["case_id"], batch["fold"], batch["blocks"], batch["x"], batch["n"], batch["root"]):
                x = np.asarray(flat, float).reshape(int(n), -1)
                for fold, w in weights.items():
                    if fold == own:
                        continue
                    found = Partial.of(x, w, right(x, fold), int(root))
                    if blocks > 1:
                        partial[case, fold] = partial[case, fold].merge(found) if (case, fold) in partial else found
                    else:
                        total[fold] = [a + b for a, b in zip(total[fold], found.sums())] if fold in total else list(found.sums())
        yield _frame([_row(part, f, None, total[f]) for f in sorted(total)] + [_row(part, f, case, found) for (case, f), found in partial.items()])

    return run


def _added_up(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of sums of rows of sums, or of the partials of one event."""
    rows = rows.sort_values("part")
    part, fold, case = rows["part"].iloc[0], rows["fold"].iloc[0], rows["case_id"].iloc[0]
    if case is None:
        sums = [rows["loss"].sum(), *(np.sum(np.stack(rows[c].to_numpy()), axis=0) for c in ("gradient", "curvature"))]
    else:
        whole = None
        for r in rows.itertuples():
            mean, other = np.asarray(r.gradient), np.asarray(r.other)
            root = np.asarray(r.root) if len(r.root) else None
            found = Partial(r.loss, r.mass, mean, other, np.asarray(r.curvature).reshape(len(mean), len(other)), root, r.root_score)
            whole = found if whole is None else whole.merge(found)
        sums = list(whole.sums())
    return _frame([_row(part, fold, None, sums)])


def _sums(events: Events, weights: dict[int, np.ndarray], right: Right, width: int, parts: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, curvature) by fold, of one job; added up in a fixed order."""
    d = len(next(iter(weights.values())))
    sums = events.table.mapInPandas(_parts(weights, right), PART)
    if events.spans:
        sums = sums.groupBy("fold", "case_id", F.when(F.col("case_id").isNull(), F.col("part"))).applyInPandas(_added_up, PART)
        parts = max(parts, FAN_IN + 1)  # the partials' rows come on top
    while parts > 1 and (parts > FAN_IN or parts * len(weights) * (1 + d + d * width) > DRIVER_CELLS):
        sums = sums.groupBy("fold", F.floor(F.col("part") / FAN_IN)).applyInPandas(_added_up, PART)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        parts = -(-parts // FAN_IN)
    found = {}
    for r in sorted(sums.select("part", "fold", "loss", "gradient", "curvature").collect(), key=lambda r: (r["fold"], r["part"])):
        own = r["loss"], np.array(r["gradient"]), np.array(r["curvature"]).reshape(d, width)
        events.received += 1 + d + d * width
        found[r["fold"]] = tuple(a + b for a, b in zip(found[r["fold"]], own)) if r["fold"] in found else own
    nothing = 0.0, np.zeros(d), np.zeros((d, width))
    return {f: found.get(f, nothing) for f in weights}


def evaluate(events: Events, weights: dict[int, np.ndarray], scales: dict[int, np.ndarray], l2: float, parts: int | None = None, curvature: bool = True) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and (with ``curvature``) Hessian by fold, of weights for scaled numbers; one job.

    The driver receives one row of sums a fold, or a few where these hold no more than DRIVER_CELLS numbers.
    """
    stored = {f: w / scales[f] for f, w in weights.items()}
    width = len(next(iter(weights.values()))) if curvature else 0
    sums = _sums(events, stored, (lambda x, fold: x) if curvature else (lambda x, fold: x[:, :0]), width, parts or events.parts)
    found = {}
    for f, (loss, gradient, spread) in sums.items():
        w, s = weights[f], scales[f]
        hessian = l2 * np.eye(len(w)) + spread / np.outer(s, s) if curvature else spread
        found[f] = loss + 0.5 * l2 * float(w @ w), l2 * w + gradient / s, hessian
    return found


def hessian_products(events: Events, weights: dict[int, np.ndarray], vectors: dict[int, np.ndarray], scales: dict[int, np.ndarray], l2: float) -> dict[int, np.ndarray]:
    """The Hessian at ``weights`` times a vector, by fold; one job that returns d numbers a fold and task."""
    stored = {f: w / scales[f] for f, w in weights.items()}
    along = {f: v / scales[f] for f, v in vectors.items()}
    sums = _sums(events, stored, lambda x, fold: (x @ along[fold])[:, None], 1, events.parts)
    return {f: l2 * vectors[f] + sums[f][2][:, 0] / scales[f] for f in weights}


def _newton_steps(events: Events, weights: dict[int, np.ndarray], gradients: dict[int, np.ndarray], scales: dict[int, np.ndarray], l2: float) -> dict[int, np.ndarray]:
    """Newton steps of several folds by conjugate gradients, side by side: one job an iteration, as exact as the gradient is small."""
    step = {f: np.zeros_like(g) for f, g in gradients.items()}
    rest, way = {f: g.copy() for f, g in gradients.items()}, {f: g.copy() for f, g in gradients.items()}
    enough = {f: min(0.1, np.sqrt(np.linalg.norm(g))) * np.linalg.norm(g) for f, g in gradients.items()}
    for _ in range(max(len(g) for g in gradients.values()) + 1):
        open_ = [f for f in sorted(rest) if np.linalg.norm(rest[f]) > enough[f]]
        if not open_:
            break
        for f, product in hessian_products(events, {f: weights[f] for f in open_}, {f: way[f] for f in open_}, scales, l2).items():
            square = rest[f] @ rest[f]
            length = square / (way[f] @ product)
            step[f] = step[f] + length * way[f]
            rest[f] = rest[f] - length * product
            way[f] = rest[f] + (rest[f] @ rest[f]) / square * way[f]
    return step


def fold_scales(stats: DataFrame) -> dict[int, np.ndarray]:
    """The scales of ``scaler_stats`` by fold, on the driver: folds x d numbers."""
    found: dict[int, dict[int, float]] = {}
    for r in stats.select("fold", "ix", "scale").collect():
        found.setdefault(r["fold"], {})[r["ix"]] = r["scale"]
    return {f: np.array([own[k] for k in range(len(own))]) for f, own in sorted(found.items())}


def fit(
    events: Events, scales: dict[int, np.ndarray], l2: float = 1.0, tolerance: float = 1e-8, max_iter: int = 50, parts: int | None = None, wide: bool | None = None
) -> list[dict]:
    """Fits the models of all folds of ``events`` side by side, each on the cases of the other folds; one dict per fold.

    Keys: fold, weights, initial_loss, final_loss, gradient_norm (largest component), iterations, converged. With ``wide``
    (by default beyond WIDE features) steps come from conjugate gradients, else from the Hessian.
    """
    if not scales:
        raise ValueError("no training events")
    wide = max(len(s) for s in scales.values()) > WIDE if wide is None else wide
    table = events.table
    events.table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = {f: np.zeros(len(s)) for f, s in sorted(scales.items())}
        now = evaluate(events, weights, scales, l2, parts, not wide)
        first = {f: v[0] for f, v in now.items()}
        steps, size, iterations = {}, dict.fromkeys(weights, 1.0), dict.fromkeys(weights, 0)

        def plan_steps(folds: Sequence[int]) -> None:
            if wide and folds:
                steps.update(_newton_steps(events, {f: weights[f] for f in folds}, {f: now[f][1] for f in folds}, scales, l2))
            else:
                steps.update({f: np.linalg.solve(now[f][2], now[f][1]) for f in folds})

        open_ = {f for f, v in now.items() if np.abs(v[1]).max() > tolerance}
        plan_steps(sorted(open_))
        for _ in range(max_iter):
            if not open_:
                break
            tried = {f: weights[f] - size[f] * steps[f] for f in sorted(open_)}
            new = evaluate(events, tried, scales, l2, parts, not wide)
            nearer_ones = []
            for f in sorted(open_):
                slack = 8 * np.spacing(abs(now[f][0]))
                nearer = np.abs(new[f][1]).max() < np.abs(now[f][1]).max()
                if new[f][0] < now[f][0] or (new[f][0] <= now[f][0] + slack and nearer):
                    weights[f], now[f], size[f] = tried[f], new[f], 1.0
                    iterations[f] += 1
                    if np.abs(now[f][1]).max() <= tolerance:
                        open_.discard(f)
                    else:
                        nearer_ones.append(f)
                elif size[f] > 2.0**-30:
                    size[f] /= 2
                else:
                    open_.discard(f)
            plan_steps(nearer_ones)
    finally:
        events.table.unpersist()
        events.table = table
    return [
        {
            "fold": f,
            "weights": w,
            "initial_loss": first[f],
            "final_loss": now[f][0],
            "gradient_norm": float(np.abs(now[f][1]).max()),
            "iterations": iterations[f],
            "converged": bool(np.abs(now[f][1]).max() <= tolerance),
        }
        for f, w in weights.items()
    ]


def fit_table(spark, fits: Sequence[dict]) -> DataFrame:
    """(fold, initial_loss, final_loss, gradient_norm, iterations, converged): one row per fold."""
    keys = ("fold", "initial_loss", "final_loss", "gradient_norm", "iterations", "converged")
    rows = [tuple(f[k] for k in keys) for f in fits]
    return spark.createDataFrame(rows, "fold int, initial_loss double, final_loss double, gradient_norm double, iterations int, converged boolean")


def weight_table(spark, fits: Sequence[dict], stats: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """(fold, ix, name, weight, mean, scale, digest): the model's state, one row per fold and feature."""
    rows = [(f["fold"], k, names[k] if k < len(names) else f"percentile {k}", float(w)) for f in fits for k, w in enumerate(f["weights"])]
    weights = spark.createDataFrame(rows, "fold int, ix int, name string, weight double")
    return weights.join(stats.select("fold", "ix", "mean", "scale"), ["fold", "ix"]).withColumn("digest", F.lit(FEATURE_DIGEST))


def predict(vectors: DataFrame, folds: DataFrame, weights: DataFrame) -> DataFrame:
    """(case_id, fold, service, score, rank): each case is scored by the model of its own fold.

    A case without a fold, or whose fold has no model, raises; ``unscored`` names the latter.
    """
    models = weights.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("ix", "weight", "mean", "scale"))).alias("model"))
    terms = F.zip_with("features", "model", lambda x, m: (x - m["mean"]) / m["scale"] * m["weight"])
    score = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    rows = vectors.join(folds.select("case_id", "fold"), "case_id", "left").join(models, "fold", "left")
    none = F.raise_error(F.concat(F.lit("no model for case "), F.col("case_id").cast("string"))).cast("double")
    return ranked(rows.select("case_id", "fold", "service", F.when(F.col("model").isNull(), none).otherwise(score).alias("score")))


def unscored(folds: DataFrame, weights: DataFrame) -> DataFrame:
    return folds.join(weights.select("fold").distinct(), "fold", "left_anti").select("case_id", "fold")


def fit_out_of_fold(vectors: DataFrame, labels: DataFrame, folds: DataFrame, l2: float = 1.0):
    """(predictions, weights, fits): models of all folds, and the held-out cases ranked by them."""
    spark = vectors.sparkSession
    vectors = materialize(vectors.select("case_id", "service", "features"), "vectors")
    stats = materialize(scaler_stats(vectors, folds), "scaler")
    fits = fit(event_table(vectors, labels, folds), fold_scales(stats), l2)
    weights = weight_table(spark, fits, stats)
    return predict(vectors, folds, weights), weights, fit_table(spark, fits)


def replay_verdict(vectors: DataFrame, labels: DataFrame, fresh: DataFrame, stored: DataFrame, fits: DataFrame) -> DataFrame:
    """One row: do predictions from ``stored`` weights agree with ``fresh`` ones, in ranks, scores and all metrics?"""
    again = predict(vectors, labels, stored)
    groups = [metric_groups(case_metrics(p, labels.select("case_id", "root", "fault", "fold"))) for p in (fresh, again)]
    return integrity_verdict(prediction_diff(fresh, again), metric_diff(*groups), fits)


def save_model(weights: DataFrame, fits: DataFrame, path: str) -> None:
    """Writes the model's state; an existing one is an error."""
    weights.write.parquet(f"{path}/weights")
    fits.write.parquet(f"{path}/fits")


def load_model(spark, path: str, names: Sequence[str] = FEATURE_NAMES) -> tuple[DataFrame, DataFrame]:
    """(weights, fits) as saved; raises if dimension, names, digest or numbers aren't what they must be."""
    weights, fits = spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/fits")
    wrong = [tuple(r) for r in model_violations(weights, names).collect()]  # a row or two per fold
    wrong += [(r["fold"], "digest") for r in weights.filter(F.col("digest") != FEATURE_DIGEST).select("fold").distinct().collect()]
    if wrong:
        raise ValueError(f"the stored model is not valid: {wrong}")
    return weights, fits
