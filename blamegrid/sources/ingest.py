"""Case directories, telemetry files, bundles and model state: what is read and written.

A case is a directory ``<root>_<fault>/<replicate>/`` with a fixed set of files. Discovery, completeness
and parsing are DataFrame jobs over Spark's file sources, so any store that Spark reads will do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import AUXILIARIES, head, known_fault, opaque_id, tail
from ..operators.telemetry import wide_to_long
from . import ranged

#: The files of a case, and the channels that four of them hold.
CASE_FILES = ("metrics.csv", "simple_metrics.csv", "logs.csv", "logts.csv", "traces.csv", "tracets_err.csv", "tracets_lat.csv", "inject_time.txt")
CHANNEL_FILES = {"simple_metrics.csv": "metric", "logts.csv": "log", "tracets_err.csv": "trace-error", "tracets_lat.csv": "trace-latency"}

#: Headers of so many bytes in all are sent to every task; beyond that a file's lines are dealt over SALTS keys.
BROADCAST_BYTES, SALTS = 32 << 20, 32


def _folder(k: int, path: str = "path") -> Column:
    """The ``k``-th part of a path from its end; of a Hive-style folder ``name=value`` the value."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -k), "^[^=]*=", "")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, condition, replicate, file, length) of all files two directories below ``root``; nothing is opened."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*/*").select("path", "length")
    return files.select("path", _folder(3).alias("condition"), _folder(2).alias("replicate"), _folder(1).alias("file"), "length")


def discover_cases(files: DataFrame, replicates: Sequence[str] = ("1", "2", "3")) -> DataFrame:
    """(condition, replicate, files): directories of a known fault and replicate, with the set of their files."""
    known = files.filter(known_fault(F.col("condition")) & F.col("replicate").isin(*replicates))
    return known.groupBy("condition", "replicate").agg(F.sort_array(F.collect_set("file")).alias("files"))


def read_anchors(spark: SparkSession, root: str, file: str = "inject_time.txt") -> DataFrame:
    """(condition, replicate, anchor): the integer in each case's anchor file (a glob); null if it is none."""
    texts = spark.read.text(f"{root.rstrip('/')}/*/*/{file}", wholetext=True).select("value", _path().alias("path"))
    return texts.select(_folder(3).alias("condition"), _folder(2).alias("replicate"), F.expr("try_cast(trim(regexp_replace(value, '\\\\s', ' ')) AS bigint)").alias("anchor"))


def _path() -> Column:
    """The file of a row, as ``binaryFile`` names it: not percent-encoded."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def _first_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, names): the cells of each file's first line that isn't blank; a file without one gives no row."""
    if ranged.opens(pattern):
        files = spark.read.format("binaryFile").load(pattern).select("path")  # listed, not read
        return files.mapInArrow(ranged.read_heads, "path string, names array<string>")
    lines = spark.read.text(pattern).select("value", _path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nr"))
    first = lines.filter((F.col("block") == 0) & (F.trim("value") != "")).groupBy("path").agg(F.min_by("value", "nr").alias("line"))
    return first.select("path", F.transform(_cells(F.col("line")), _bare).alias("names"))


def _cells(line: Column) -> Column:
    """The cells of a line; commas inside quotes don't part them."""
    cell = r',(\s*+"[^"]*+(?:""[^"]*+)*+"\s*+(?=,|$)|[^,]*+)'  # never steps back, so quoted lines of any width take linear time
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(cell), F.lit(1))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def _bare(cell: Column) -> Column:
    """A cell without the white space and the quotes around it."""
    return F.trim(F.replace(F.regexp_replace(cell, '^\\s*"|"\\s*$|^\\s+|\\s+$', ""), F.lit('""'), F.lit('"')))


def read_headers(spark: SparkSession, root: str, file: str = "simple_metrics.csv") -> DataFrame:
    """(condition, replicate, indicators): column names of each case's file, from its first line that isn't blank.

    Tasks read some kilobytes of each file, until that line ends; in a store that only Spark opens, its first
    block. A file without such a line gives no row.
    """
    return _first_lines(spark, f"{root.rstrip('/')}/*/*/{file}").select(_folder(3).alias("condition"), _folder(2).alias("replicate"), F.col("names").alias("indicators"))


def derive_candidates(indicators: DataFrame, auxiliaries: Sequence[str] = AUXILIARIES) -> DataFrame:
    """(case_id, candidate) from ``indicators(case_id, indicator)``: entities of all cpu and mem columns."""
    used = indicators.filter(F.col("indicator").endswith("_cpu") | F.col("indicator").endswith("_mem"))
    named = used.select("case_id", head(F.col("indicator")).alias("candidate")).distinct()
    return named.filter((F.col("candidate") != "") & ~F.col("candidate").isin(*auxiliaries))


def candidate_arrays(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("case_id").agg(F.sort_array(F.collect_set("candidate")).alias("candidates"))


def with_reasons(found: DataFrame, required: Sequence[str] = CASE_FILES) -> DataFrame:
    """``found(condition, files, anchor, candidates)`` with root, fault and reason (null for a good case)."""
    missing = F.array_sort(F.array_except(F.array(*(F.lit(f) for f in required)), F.col("files")))
    root, fault = head(F.col("condition")), tail(F.col("condition"))
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
        .when(F.col("anchor").isNull(), "parse_error:anchor")
        .when(F.coalesce(F.size("candidates"), F.lit(0)) < 1, "parse_error:candidates")
        .when(~F.array_contains("candidates", root), "root_not_in_candidates")
    )
    return found.select("*", root.alias("root"), fault.alias("fault"), reason.alias("reason"))


def load_cases(spark: SparkSession, root: str, dataset: str, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(good cases, excluded cases) of a directory tree."""
    keys = ["condition", "replicate"]
    found = discover_cases(list_files(spark, root))
    headers = read_headers(spark, root).withColumn("case_id", F.concat_ws("/", *keys))
    named = candidate_arrays(derive_candidates(headers.select("case_id", F.explode("indicators").alias("indicator"))))
    whole = found.join(read_anchors(spark, root), keys, "left").withColumn("relative", F.concat_ws("/", *keys))
    whole = with_reasons(whole.join(named.withColumnRenamed("case_id", "relative"), "relative", "left"))
    good = whole.filter("reason IS NULL").select(
        opaque_id(dataset, namespace, F.col("relative")).alias("case_id"), F.lit(dataset).alias("dataset"), F.col("anchor").cast("double").alias("anchor"),
        "candidates", F.col("replicate").cast("int").alias("replicate"), "root", "fault", "relative",
    )
    return good, whole.filter("reason IS NOT NULL").select("relative", "reason")


def _number(cell: Column) -> Column:
    """The number that a cell holds, null if it is none (``nan`` is none, ``inf`` is one)."""
    bare = _bare(cell)
    return F.when(bare.rlike("^(?i)[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"), bare.try_cast("double"))


def read_telemetry(spark: SparkSession, root: str, time: str = "time", files: Mapping[str, str] = CHANNEL_FILES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(relative, channel, indicator, ts, value) of all channel files, of any size and each with columns of its own.

    ``files`` maps file names (or globs) in a case's folder to channels. Spark splits the files among tasks by
    lines; what a line's cells mean comes from the file's header, which is read apart. All headers are sent to
    every task where they hold at most ``broadcast_bytes`` of text; beyond that lines meet them in a shuffle,
    dealt over SALTS keys a file, so that a file that holds a third of all lines is no single task.

    Cases: cells that are no numbers, or that a short line lacks, are null; blank lines, and lines that repeat the
    header, count for nothing; an empty file gives no row. A file without the column ``time``, and a line with
    filled cells beyond the header's, raise. The second ``a`` of a header is ``a.1``. Cells hold no line breaks.
    """
    parts = [_unlike_files(spark, f"{root.rstrip('/')}/*/*/{pattern}", channel, time, broadcast_bytes) for pattern, channel in files.items()]
    return reduce(DataFrame.unionByName, parts)


def _unlike_files(spark: SparkSession, pattern: str, channel: str, time: str, broadcast_bytes: int) -> DataFrame:
    earlier = lambda c, k: F.size(F.filter(F.slice("names", F.lit(1), k), lambda other: other == c))
    named = F.transform("names", lambda c, k: F.when(earlier(c, k) > 0, F.concat(c, F.lit("."), earlier(c, k).cast("string"))).otherwise(c))
    heads = _first_lines(spark, pattern).select(F.col("path").alias("of"), named.alias("names"), F.array_position("names", time).alias("at"))
    lines = spark.read.text(pattern).select("value", _path().alias("path")).filter(F.trim("value") != "")
    size = heads.agg(F.sum(F.length(F.array_join("names", ",")) + F.length("of"))).first()[0] or 0
    if size <= broadcast_bytes:
        met = lines.join(F.broadcast(heads), F.col("path") == F.col("of"))
    else:
        dealt = lines.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
        spread = heads.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = dealt.join(spread, (F.col("path") == F.col("of")) & (F.col("salt") == F.col("of_salt")))
    place = F.concat_ws("/", _folder(3), _folder(2), _folder(1))
    row = met.select("path", "names", "at", _cells(F.col("value")).alias("cells"), place.alias("place"))
    beyond = F.exists(F.slice("cells", F.size("names") + 1, F.size("cells")), lambda c: _bare(c) != "")
    stamp = (
        F.when(F.col("at") == 0, F.raise_error(F.concat("place", F.lit(f" has no column {time}"))))
        .when(beyond, F.raise_error(F.concat("place", F.lit(" has a line of more cells than its header"))))
        .otherwise(F.get("cells", (F.col("at") - 1).cast("int")))
    )
    timed = row.withColumn("stamp", stamp).filter(F.col("stamp").isNull() | (_bare(F.col("stamp")) != time))
    cells = timed.select(F.concat_ws("/", _folder(3), _folder(2)).alias("relative"), _number(F.col("stamp")).alias("ts"), "at", F.posexplode(F.arrays_zip("names", "cells")))
    kept = cells.filter((F.col("pos") != F.col("at") - 1) & F.col("col.names").isNotNull())
    return kept.select("relative", F.lit(channel).alias("channel"), F.col("col.names").alias("indicator"), "ts", _number(F.col("col.cells")).alias("value"))


def read_wide_csv(spark: SparkSession, path: str, ids: Sequence[str], time: str = "time") -> DataFrame:
    """(ids, ts, indicator, value) of CSV files that share their columns, of any size: Spark splits them among tasks."""
    return wide_to_long(spark.read.csv(path, header=True), ids, time)


def write_bundle(good: DataFrame, excluded: DataFrame, root: str) -> None:
    """Inputs, labels, sources, registry and exclusions as tables of their own, labels apart from inputs."""
    good.select("case_id", "dataset", "anchor", "candidates").write.partitionBy("dataset").parquet(f"{root}/inputs")
    good.select("case_id", "dataset", "root", "fault").write.partitionBy("dataset").parquet(f"{root}/labels")
    good.select("case_id", "dataset", "relative", "replicate").write.partitionBy("dataset").parquet(f"{root}/sources")
    registry(good).write.partitionBy("dataset").parquet(f"{root}/registry")
    excluded.write.parquet(f"{root}/excluded")


def registry(cases: DataFrame) -> DataFrame:
    """(dataset, service): all candidates of all cases."""
    return cases.select("dataset", F.explode("candidates").alias("service")).distinct().orderBy("dataset", "service")


def manifest(cases: DataFrame, excluded: DataFrame) -> DataFrame:
    """(dataset, cases, services, registry); the exclusions' number stands beside."""
    rows = cases.select("dataset", "case_id", F.explode("candidates").alias("service"))
    per = rows.groupBy("dataset").agg(F.count_distinct("case_id").alias("cases"), F.count_distinct("service").alias("services"), F.sort_array(F.collect_set("service")).alias("registry"))
    return per.join(F.broadcast(excluded.agg(F.count(F.lit(1)).alias("excluded"))))  # one row


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of the files of a directory.

    Tasks read a file of any length in chunks. In a store that only Spark opens, a file's content is one value, of
    2 GB at most: a longer one raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if ranged.opens(root):
        return files.select("path", "length").mapInArrow(ranged.read_digests, "path string, length long, sha256 string").orderBy("path")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines don't count."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.json(path)


def write_features(vectors: DataFrame, dataset: str, path: str) -> None:
    vectors.withColumn("dataset", F.lit(dataset)).write.partitionBy("dataset").parquet(path)


def read_features(spark: SparkSession, path: str, dim: int | None = 68) -> DataFrame:
    """Stored vectors; one of another length raises when it is read."""
    rows = spark.read.parquet(path)
    return rows if dim is None else _of_length(rows, dim)


def _of_length(rows: DataFrame, dim: int) -> DataFrame:
    bad = F.size("features") != dim
    return rows.filter(F.when(bad, F.raise_error(F.concat(F.lit("unexpected number of features in "), F.col("case_id")))).otherwise(F.lit(True)).cast("boolean"))


def load_dataset(spark: SparkSession, features: str, labels: str, splits: str) -> DataFrame:
    """Vectors with root, fault and fold of their case."""
    rows = read_features(spark, features)
    return rows.join(spark.read.parquet(labels).select("case_id", "root", "fault"), "case_id").join(spark.read.parquet(splits).select("case_id", "fold"), "case_id")


#: Tables of a dataset that are kept by case, and what ``load_bucketed`` takes of them.
BUCKETED = {"features": ("case_id", "service", "features"), "labels": ("case_id", "root", "fault"), "splits": ("case_id", "fold")}
BUCKETS = 64


def write_bucketed(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS) -> None:
    """Writes features, labels and splits below ``path``, each in ``buckets`` buckets of cases, sorted; an existing one is an error.

    Rows are shuffled once here, so that no load has to: the three meet bucket by bucket.
    """
    for name, columns in BUCKETED.items():
        rows = tables[name].select(*columns).repartition(buckets, "case_id")  # a task a bucket: one file each
        spark, table = rows.sparkSession, _table_name(path, name)
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # an entry of the catalogue, never files
        rows.write.mode("errorifexists").bucketBy(buckets, "case_id").sortBy("case_id").option("path", f"{path}/{name}").saveAsTable(table)


def _table_name(path: str, name: str) -> str:
    return f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{name}"


def load_bucketed(spark: SparkSession, path: str, buckets: int = BUCKETS, dim: int | None = 68) -> DataFrame:
    """Vectors with root, fault and fold of their case, of tables that ``write_bucketed`` wrote; the join moves no row.

    Another session than the writer's makes the catalogue's entries anew, from the files' schema.
    """
    found = []
    for name, columns in BUCKETED.items():
        table = _table_name(path, name)
        if not spark.catalog.tableExists(table):
            schema = spark.read.parquet(f"{path}/{name}").schema
            listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            spark.sql(f"CREATE TABLE {table} ({listed}) USING parquet CLUSTERED BY (case_id) SORTED BY (case_id) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        found.append(spark.table(table).select(*columns).hint("merge"))
    rows = found[0] if dim is None else _of_length(found[0], dim)
    return rows.join(found[1], "case_id").join(found[2], "case_id")
