"""Folds: assignment by replicate, membership of training and test, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_folds(cases: DataFrame) -> DataFrame:
    """``cases(case_id, replicate, ...)`` with fold = replicate - 1."""
    return cases.withColumn("fold", F.col("replicate") - 1)


def fold_membership(assigned: DataFrame) -> DataFrame:
    """(fold, case_id, role): each case trains for all folds but its own, where it is a test case.

    Each row is spread over the few folds there are; the folds are gathered as one small array.
    """
    folds = assigned.agg(F.array_sort(F.collect_set("fold")).alias("folds"))
    spread = assigned.join(F.broadcast(folds)).select("case_id", F.col("fold").alias("own"), F.explode("folds").alias("fold"))  # one row: the folds
    return spread.select("fold", "case_id", F.when(F.col("own") == F.col("fold"), "test").otherwise("train").alias("role"))


def strata(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("fold", "root", "fault").agg(F.count(F.lit(1)).alias("n"))


def split_violations(assigned: DataFrame, cases: int | None = None, per_fold: int | None = None, replicates: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(rule, detail): what is wrong with a split; sizes are only checked where given."""
    total = assigned.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("d"))
    found = [
        total.filter("n <> d").select(F.lit("repeated case").alias("rule"), F.col("n").cast("string").alias("detail")),
        assigned.filter(~F.col("replicate").isin(*replicates) | F.col("replicate").isNull()).select(F.lit("replicate").alias("rule"), F.col("case_id").alias("detail")),
        strata(assigned).filter("n > 1").select(F.lit("stratum").alias("rule"), F.concat_ws("/", "fold", "root", "fault").alias("detail")),
    ]
    if cases is not None:
        found.append(total.filter(F.col("n") != cases).select(F.lit("cases").alias("rule"), F.col("n").cast("string").alias("detail")))
    if per_fold is not None:
        sizes = assigned.groupBy("fold").count().filter(F.col("count") != per_fold)
        found.append(sizes.select(F.lit("fold size").alias("rule"), F.concat_ws("/", "fold", "count").alias("detail")))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result
