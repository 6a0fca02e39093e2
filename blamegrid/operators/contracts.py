"""Data contracts: each check returns its violations as (case_id, rule)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import FEATURE_NAMES, finite
from ..functions.names import FORBIDDEN_KEYS, canonical_key
from ..sources.scratch import materialize


#: White space in Unicode's sense, as the inside of a character class.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def not_clean(text: Column) -> Column:
    """True for a string that is missing, empty or not trimmed of white space of any kind."""
    return text.isNull() | (text == "") | text.rlike(f"^[{SPACES}]|[{SPACES}]\\z")


def _told(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    names = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(rule)) for rule, bad in rules.items())))
    return rows.select("case_id", F.explode(names).alias("rule"))


def case_violations(cases: DataFrame) -> DataFrame:
    """Fields, anchor and candidates of ``cases(case_id, dataset, anchor, candidates)``; repeated ids."""
    own = _told(
        cases,
        {
            "case_id": not_clean(F.col("case_id")),
            "dataset": not_clean(F.col("dataset")),
            "anchor": ~finite(F.col("anchor").cast("double")),
            "no candidates": F.size("candidates") < 1,
            "repeated candidate": F.size("candidates") != F.size(F.array_distinct("candidates")),
            "candidate": F.exists("candidates", not_clean),
        },
    )
    return own.unionByName(repeated_ids(cases, "repeated case"))


def repeated_ids(rows: DataFrame, rule: str) -> DataFrame:
    return rows.groupBy("case_id").count().filter("count > 1").select("case_id", F.lit(rule).alias("rule"))


def label_violations(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids of ``labels(case_id, root)`` match the cases' one to one, and the root is a candidate."""
    one = cases.select("case_id", "candidates").withColumn("has_case", F.lit(True))
    two = labels.select("case_id", "root").withColumn("has_label", F.lit(True))
    both = one.join(two, "case_id", "full_outer")
    rule = (
        F.when(F.col("has_label").isNull(), "no label").when(F.col("has_case").isNull(), "no case")
        .when(~F.coalesce(F.array_contains("candidates", F.col("root")), F.lit(False)), "root is no candidate")
    )
    return both.select("case_id", rule.alias("rule")).filter("rule IS NOT NULL").unionByName(repeated_ids(labels, "repeated label"))


MALFORMED = "malformed json"


def firewall_violations(cases: DataFrame, metadata: str = "metadata", forbidden: Sequence[str] = FORBIDDEN_KEYS) -> DataFrame:
    """(case_id, key): keys of ``metadata``, at any depth, that would give a label away; each once.

    ``metadata`` is JSON text, a map, a struct or an array of such. It is walked as a variant, level by level: a level's
    objects and arrays are taken apart, forbidden keys are noted, and what holds more goes on to the next level; so keys are
    compared as they are meant, escapes decoded. Text that is no JSON, or names a key twice in one object, is refused as MALFORMED;
    null has no keys.
    """
    kind = cases.schema[metadata].dataType
    text = isinstance(kind, T.StringType)
    value = F.try_parse_json(F.col(metadata)) if text else F.col(metadata) if isinstance(kind, T.VariantType) else F.to_variant_object(F.col(metadata))
    level = cases.select("case_id", F.col(metadata).isNotNull().alias("there"), value.alias("v"))
    found = level.filter(F.col("there") & F.col("v").isNull()).select("case_id", F.lit(MALFORMED).alias("key"))
    level = level.filter(holds_more(F.col("v"))).select("case_id", "v")
    while not level.isEmpty():
        parts = level.lateralJoin(cases.sparkSession.tvf.variant_explode(F.col("v").outer())).select("case_id", canonical_key(F.col("key")).alias("key"), "value")
        told = F.when(F.col("key").isin(*forbidden), F.col("key"))
        parts = materialize(parts.select("case_id", told.alias("key"), F.when(holds_more(F.col("value")), F.col("value")).alias("v")).filter("key IS NOT NULL OR v IS NOT NULL"), "keys")
        found = found.unionByName(parts.filter("key IS NOT NULL").select("case_id", "key"))
        level = parts.filter("v IS NOT NULL").select("case_id", "v")
    return found.distinct()


def holds_more(value: Column) -> Column:
    """Is a variant an object or an array?"""
    kind = F.schema_of_variant(value)
    return F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))


def schema_firewall(schema: T.DataType, forbidden: Sequence[str] = FORBIDDEN_KEYS, path: str = "") -> list[str]:
    """Paths of forbidden field names in a typed schema, at any depth."""
    if isinstance(schema, T.StructType):
        return [
            found
            for f in schema
            for at in [f"{path}.{f.name}".lstrip(".")]
            for found in [*([at] if "".join(c for c in f.name.lower() if c.isascii() and c.isalnum()) in forbidden else []), *schema_firewall(f.dataType, forbidden, at)]
        ]
    if isinstance(schema, T.ArrayType):
        return schema_firewall(schema.elementType, forbidden, path)
    return schema_firewall(schema.valueType, forbidden, path) if isinstance(schema, T.MapType) else []


def event_violations(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Events of ``vectors(case_id, service, features)``: two candidates or more, each once, numbers finite, one length."""
    good = F.forall("features", lambda x: F.coalesce(finite(x), F.lit(False)))
    events = vectors.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("service").alias("d"),
        F.bool_and(F.coalesce(good, F.lit(False))).alias("finite"),
        F.min(F.size("features")).alias("low"),
        F.max(F.size("features")).alias("high"),
    )
    size = (F.col("low") != F.col("high")) if dim is None else (F.col("low") != dim) | (F.col("high") != dim)
    return _told(events, {"few candidates": F.col("d") < 2, "repeated candidate": F.col("n") != F.col("d"), "not finite": ~F.col("finite"), "dimension": size})


def model_violations(weights: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """(fold, rule): stored weights ``(fold, ix, name, weight, mean, scale)`` against the expected features."""
    expected = F.array(*(F.lit(n) for n in names))
    rows = weights.withColumn("wanted", F.get(expected, F.col("ix")))
    folds = rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("ix").alias("d"),
        F.bool_and(F.coalesce(F.col("name") == F.col("wanted"), F.lit(False))).alias("named"),
        F.bool_and(*[reduce(lambda a, b: a & b, (finite(F.col(c)) for c in ("weight", "mean", "scale")))]).alias("finite"),
    )
    return _told(folds.withColumnRenamed("fold", "case_id"), {"dimension": (F.col("n") != len(names)) | (F.col("d") != len(names)), "names": ~F.col("named"), "not finite": ~F.col("finite")}).withColumnRenamed("case_id", "fold")


def alignment_violations(vectors: DataFrame, labels: DataFrame, folds: DataFrame) -> DataFrame:
    """Cases that are not in all of the three tables."""
    tables = [t.select("case_id").distinct().withColumn(n, F.lit(True)) for t, n in ((vectors, "features"), (labels, "label"), (folds, "fold"))]
    both = reduce(lambda a, b: a.join(b, "case_id", "full_outer"), tables)
    return _told(both, {f"no {n}": F.col(n).isNull() for n in ("features", "label", "fold")})


def empty_folds(folds: DataFrame) -> DataFrame:
    """(fold, rule): folds without test or without training cases."""
    sizes = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    total = folds.agg(F.count(F.lit(1)).alias("all"))
    return sizes.join(F.broadcast(total)).filter("n = 0 OR n = all").select("fold", F.lit("no training or test cases").alias("rule"))  # one row


def integrity_verdict(diff: DataFrame, metric_diff: DataFrame, fits: DataFrame, score_tolerance: float = 1e-12, metric_tolerance: float = 1e-10) -> DataFrame:
    """One row: converged, same_rankings, scores_agree, metrics_agree and their conjunction."""
    converged = fits.agg(F.coalesce(F.bool_and("converged"), F.lit(False)).alias("converged"))
    same = diff.agg(
        F.bool_and(F.col("same_ranks") & (F.col("one_sided") == 0)).alias("same_rankings"),
        F.coalesce(F.max("max_score_diff") <= score_tolerance, F.lit(False)).alias("scores_agree"),
    )
    metrics = metric_diff.agg(F.coalesce(F.max("diff") <= metric_tolerance, F.lit(False)).alias("metrics_agree"))
    row = converged.join(F.broadcast(same)).join(F.broadcast(metrics))  # one row each
    return row.withColumn("passed", F.expr("converged AND same_rankings AND scores_agree AND metrics_agree"))


