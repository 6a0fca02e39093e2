"""What the corpus operators share: tables, scratch tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize, scratch_dir  # noqa: F401  (shared with the operators)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Regular expressions of words, as the contracts give them.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: For bytes.translate: lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of these names under others, and what to rename to have them back."""
    moved = {f"_own_{n}": n for n in names if n in df.columns}
    return df.withColumnsRenamed({n: m for m, n in moved.items()}), moved


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``most`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        if not len(sizes):
            continue
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 texts of a column; null is empty."""
    return [x or b"" for x in pc.cast(batch.column(column), pa.binary()).to_pylist()]
