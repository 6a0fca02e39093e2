"""What an extraction has yielded: per case, and over all cases of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import finite
from .features import magnitudes


def case_report(dense: DataFrame) -> DataFrame:
    """Per case of the dense cells: range of the magnitude, shares of bins seen, channels available and active."""
    rows = dense.join(magnitudes(dense), ["case_id", "service"])
    return rows.groupBy("case_id").agg(
        F.min("a").alias("a_min"),
        F.max("a").alias("a_max"),
        F.avg("coverage").alias("coverage"),
        F.avg("channel_available").alias("available"),
        F.avg("morphology_active").alias("active"),
        F.count_distinct("service").alias("candidates"),
        F.bool_and(finite(F.col("a"))).alias("finite"),
    )


def dataset_report(cases: DataFrame) -> DataFrame:
    """One row over a case report: cases, least, greatest and mean values, and how many cases have how many candidates."""
    sizes = cases.groupBy("candidates").agg(F.count(F.lit(1)).alias("cases"), *(f(c).alias(n) for n, f, c in _PARTS))
    return sizes.agg(
        F.sum("cases").alias("cases"),
        F.min("a_min").alias("a_min"),
        F.max("a_max").alias("a_max"),
        *((F.sum(c) / F.sum("cases")).alias(c) for c in ("coverage", "available", "active")),
        F.bool_and("finite").alias("finite"),
        F.array_sort(F.collect_list(F.struct("candidates", "cases"))).alias("histogram"),
    )


_PARTS = (
    ("a_min", F.min, "a_min"), ("a_max", F.max, "a_max"), ("coverage", F.sum, "coverage"), ("available", F.sum, "available"), ("active", F.sum, "active"),
    ("finite", F.bool_and, "finite"),
)
