"""Comparing the rows of many groups pair by pair inside tasks, without a row for each pair.

Rows come sorted by group; a group larger than ``BLOCK`` rows has been cut into blocks, and each pair of
blocks is a group of its own, in which only rows of different sides meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def in_blocks(rows: DataFrame, keys: list[str], row_id: str, block: int = BLOCK) -> DataFrame:
    """``rows`` of groups of two or more, with a string ``bucket`` and a ``side`` (0 or 1; null where all rows meet).

    A group of n rows is cut into c = ceil(n / block) blocks by a hash of ``row_id``; a row goes to the c
    pairs of blocks that its own block is part of.
    """
    sizes = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        .select(*(F.col(k).alias(f"_{k}") for k in keys), F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    )
    same: Column = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    dealt = rows.join(sizes, same).withColumn("_own", F.pmod(F.xxhash64(row_id), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    name = F.concat_ws("/", *keys, F.least("_own", "_with"), F.greatest("_own", "_with"))
    side = F.when(F.col("_own") != F.col("_with"), (F.col("_own") > F.col("_with")).cast("int"))
    return dealt.withColumn("bucket", name).withColumn("side", side).drop("_own", "_with", "_blocks", *(f"_{k}" for k in keys))


def whole_groups(batches: Iterable[pa.RecordBatch], rows: int = 4096, most: int = 64 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows, or ``most`` bytes if less, that hold whole groups, and where each group starts (and the end).

    Spark sends batches of 64 MB at most. A group alone may have more bytes: its rows must be bounded before.
    """
    held: list[pa.RecordBatch] = []
    count = size = 0

    def cut(last: bool):
        nonlocal held, count, size
        whole = pa.Table.from_batches(held).combine_chunks()
        bucket = whole.column("bucket").chunk(0)
        change = np.flatnonzero(pc.not_equal(bucket.slice(1), bucket.slice(0, len(bucket) - 1)).to_numpy(zero_copy_only=False)) + 1
        end = len(bucket) if last else int(change[-1]) if len(change) else 0
        held = whole.slice(end).to_batches() if end < len(bucket) else []
        count, size = len(bucket) - end, sum(h.nbytes for h in held)
        starts = np.concatenate([[0], change[change < end], [end]]) if end else None
        return (whole.slice(0, end).combine_chunks(), starts) if end else None

    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            held.append(part := batch.slice(at, step))
            count += part.num_rows
            size += part.nbytes
            if (count >= rows or size >= most) and (found := cut(False)):
                yield found
    if count:
        yield cut(True)


def pairs(starts: np.ndarray, side: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (left < right) of all rows that meet, ``most`` of them or one row's at a time.

    ``side`` is -1 where all rows of the group meet. Else the rows of side 0, which come first, don't meet each
    other but all rows of other sides; rows of side 1 don't meet each other either, those of side 2 do.
    """
    n = int(starts[-1])
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    ones = np.concatenate([[0], np.cumsum(side > 0)])
    first_one = np.repeat(starts[1:] - (ones[starts[1:]] - ones[starts[:-1]]), sizes)
    row = np.arange(n)
    low = np.where(side == 0, first_one, row + 1)
    count = np.where(side == 1, 0, end - low)
    total = np.cumsum(count)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        c = count[at:upto]
        if c.sum():
            left = np.repeat(row[at:upto], c)
            right = np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:upto], c)
            yield left, right
        at = upto


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that links of (left, right) lead to."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(label, high[open_], low[open_])
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        left, right = left[open_], right[open_]
    return label
