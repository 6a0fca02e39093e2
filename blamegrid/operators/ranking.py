"""Rankings of candidates, their scores as probabilities, and what a ranking is worth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("AC@1", "AC@3", "AC@5", "Avg@5", "MRR")


def ranked(scores: DataFrame, score: str = "score") -> DataFrame:
    """``scores(case_id, service, score)`` with rank: best score first, then by name."""
    order = W.partitionBy("case_id").orderBy(F.col(score).desc_nulls_last(), F.col("service"))
    return scores.withColumn("rank", F.row_number().over(order))


def event_softmax(scores: DataFrame) -> DataFrame:
    """With p: the softmax of the scores of a case, shifted by their maximum."""
    event = W.partitionBy("case_id")
    lifted = scores.withColumn("lifted", F.exp(F.col("score") - F.max("score").over(event)))
    return lifted.withColumn("p", F.col("lifted") / F.sum("lifted").over(event)).drop("lifted")


def hits(k: int):
    """Column AC@k of a root's rank."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k is a positive integer")
    return (F.col("rank") <= k).cast("double").alias(f"AC@{k}")


def _worth(labelled: DataFrame, columns: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """AC@k, Avg@5 and MRR beside ``columns``, of rows with a ``rank``; without one the root isn't in the ranking, an error."""
    missing = F.raise_error(F.concat(F.lit("the root is not in the ranking of "), F.coalesce(F.col("case_id").cast("string"), F.lit("null"))))
    known = labelled.withColumn("rank", F.when(F.col("rank").isNull(), missing).otherwise(F.col("rank")).cast("int"))
    return known.select(*columns, "rank", *(hits(k) for k in ks), (F.greatest(F.lit(0), 6 - F.col("rank")) / 5.0).alias("Avg@5"), (1.0 / F.col("rank")).alias("MRR"))


def case_metrics(ranking: DataFrame, labels: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Per case of ``labels(case_id, root, ...)``: its columns, rank, AC@k, Avg@5, MRR; a root without a rank raises."""
    roots = ranking.select("case_id", F.col("service").alias("root"), "rank")
    return _worth(labels.join(roots, ["case_id", "root"], "left"), labels.columns, ks)


def root_metrics(scores: DataFrame, labels: DataFrame, ks: Sequence[int] = (1, 3, 5), score: str = "score") -> DataFrame:
    """``case_metrics`` of ``scores(case_id, service, score)`` that nobody has ranked: only the root's rank is asked for.

    It is one more than the number of candidates before the root, of a better score or, at its score, of a lesser
    name: a count by case, summed up in each task first, so that an event of any size needs neither a sort nor a task to itself.
    A null score comes after all others.
    """
    low = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    rows = scores.select("case_id", "service", low.alias("_score"))
    roots = labels.select("case_id", F.col("root").alias("_root")).join(rows.select(F.col("case_id").alias("_of"), F.col("service").alias("_named"), F.col("_score").alias("_own")), (F.col("case_id") == F.col("_of")) & (F.col("_root") == F.col("_named")))
    roots = roots.select(F.col("case_id").alias("_of"), "_root", "_own")
    ahead = (F.col("_score") > F.col("_own")) | ((F.col("_score") == F.col("_own")) & (F.col("service") < F.col("_root")))
    counted = rows.join(roots, F.col("case_id") == F.col("_of")).groupBy("_of").agg((F.count(F.when(ahead, 1)) + 1).alias("rank"))
    return _worth(labels.join(counted, F.col("case_id") == F.col("_of"), "left"), labels.columns, ks)


def metric_groups(cases: DataFrame, by: Sequence[str] = ("fault", "root", "fold")) -> DataFrame:
    """Averages over all cases and by each column of ``by``, in one pass over grouping sets; no cases are an error."""
    view = cases.select(*by, *METRICS, F.lit(1).alias("real"))
    # a row that counts for nothing, so that there is an overall group to see that there are no cases
    blank = cases.sparkSession.range(1).select(*(F.lit(None).cast(view.schema[c].dataType).alias(c) for c in (*by, *METRICS)), F.lit(0).alias("real"))
    view = view.unionByName(blank)
    means = [F.avg(F.col(f"`{m}`")).alias(m) for m in METRICS]
    sets = [[], *([c] for c in by)]
    grouped = view.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.grouping_id().alias("gid"), F.sum("real").alias("n"), *means)
    names = {(1 << len(by)) - 1: "overall"} | {((1 << len(by)) - 1) ^ (1 << (len(by) - 1 - k)): c for k, c in enumerate(by)}
    kind, value = F.lit(None).cast("string"), F.lit("all")
    for gid, name in names.items():
        kind = F.when(F.col("gid") == gid, F.lit(name)).otherwise(kind)
        if name != "overall":
            value = F.when(F.col("gid") == gid, F.col(name).cast("string")).otherwise(value)
    n = F.when(F.col("n") == 0, F.raise_error(F.lit("no cases to average")).cast("long")).otherwise(F.col("n")).alias("n")
    told = grouped.filter((F.col("n") > 0) | (F.col("gid") == (1 << len(by)) - 1))
    return told.select(kind.alias("grouping"), value.alias("value"), n, *(F.col(f"`{m}`") for m in METRICS))


def prediction_gaps(candidates: DataFrame, ranking: DataFrame) -> DataFrame:
    """What keeps a ranking from being a permutation of its candidates: (case_id, service, gap)."""
    seen = ranking.groupBy("case_id", "service").agg(F.count(F.lit(1)).alias("times"), F.min("rank").alias("rank"))
    both = candidates.select("case_id", F.col("candidate").alias("service")).distinct().withColumn("known", F.lit(True)).join(seen, ["case_id", "service"], "full_outer")
    sizes = both.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("case_id")))
    gap = (
        F.when(F.col("times").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("times") > 1, "repeated")
        .when(F.col("rank").isNull() | (F.col("rank") < 1) | (F.col("rank") > F.col("n")), "rank")
    )
    return sizes.select("case_id", "service", gap.alias("gap")).filter("gap IS NOT NULL")


def prediction_diff(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """One row: rows compared, one-sided rows, greatest score difference, whether the ranks are equal; if ``strict``, one-sided rows raise."""
    sides = [d.select("case_id", "service", F.col("score").alias(f"score_{s}"), F.col("rank").alias(f"rank_{s}")) for d, s in ((left, "l"), (right, "r"))]
    both = sides[0].join(sides[1], ["case_id", "service"], "full_outer")
    alone = F.col("rank_l").isNull() | F.col("rank_r").isNull()
    single = F.coalesce(F.sum(alone.cast("long")), F.lit(0).cast("long"))
    if strict:
        single = F.when(single > 0, F.raise_error(F.lit("the predictions are not of the same cases and candidates")).cast("long")).otherwise(single)
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        single.alias("one_sided"),
        F.max(F.abs(F.col("score_l") - F.col("score_r"))).alias("max_score_diff"),
        F.coalesce(F.bool_and(F.col("rank_l").eqNullSafe(F.col("rank_r"))), F.lit(True)).alias("same_ranks"),
    )


def metric_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(grouping, value, diff): greatest difference of any metric of two ``metric_groups``; infinite for a group on one side."""
    keys = ["grouping", "value"]
    sides = [d.select(*keys, *(F.col(f"`{m}`").alias(f"{s}{k}") for k, m in enumerate(METRICS))) for d, s in ((left, "l"), (right, "r"))]
    both = sides[0].join(sides[1], keys, "full_outer")
    diffs = [F.coalesce(F.abs(F.col(f"l{k}") - F.col(f"r{k}")), F.lit(float("inf"))) for k in range(len(METRICS))]
    return both.select(*keys, F.greatest(*diffs).alias("diff"))


def canonical_order(rows: DataFrame) -> DataFrame:
    """Predictions or splits in their order for output: by case, then by rank where there is one (a range sort)."""
    return rows.orderBy(*(c for c in ("case_id", "fold", "rank", "service") if c in rows.columns))
