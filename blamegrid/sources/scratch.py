"""Tables written on the way: in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own, on a single machine only."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where:
        return where
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="blamegrid-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    context.setCheckpointDir(where)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used yet."""
    return f"{scratch_dir(spark)}/blamegrid-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes what ``materialize`` has written, once nothing that is still to run reads it."""
    for table in tables:
        path, spark = table.__dict__.pop("_scratch_path", None), table.sparkSession
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
