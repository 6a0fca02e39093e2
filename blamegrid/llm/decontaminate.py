"""Benchmark decontamination with a broadcast hash set of test n-grams.

Every benchmark item is cut into windows of ``n`` consecutive words (an item of fewer words is one
window). The windows' hashes, with the words they stand for, are broadcast; each task slides over the
words of its documents, looks each window's hash up, and compares words before it counts a hit.

What is broadcast is bounded: tasks normalise the items and cut those of more than ``block_bytes`` into pieces
that overlap by n - 1 words, which lose no window and make no new one; pieces are dealt into blocks of that
size, and a block is arrays of numbers, some 30 bytes for each of its words, beside its vocabulary. The corpus is scanned once per
block; what a scan has found is written before the next block is made, so driver and tasks hold one block
at a time. The usual benchmark is one block. Documents are never shuffled, so hot passages and copies cost
nothing extra.

Cases: null and empty texts have no words and are clean; an item without words has no window; equal items
are each reported; repeated documents are judged one by one; an empty benchmark leaves every document
clean; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, aside, discard, materialize, slices, table, texts

WINDOW = 10
BLOCK_BYTES = 16 << 20
RADIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def normalised_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def window_hashes(ids: np.ndarray, starts: np.ndarray, length: int, radix: np.uint64) -> np.ndarray:
    total = np.zeros(len(starts), np.uint64)
    for k in range(length):
        total = total * radix + ids[starts + k].astype(np.uint64)
    return total ^ (total >> np.uint64(31))


class TestWindows:
    """The hash set of some (item, normalised text): vocabulary, and arrays for each window length.

    Per length: the sorted hashes of distinct windows, where each stands in the items' words, and its items
    as slices of one array.
    """

    __test__ = False  # not a test case

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        rows = [(number[name], np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.split()], np.int32)) for name, text in items]
        rows = [r for r in rows if len(r[1])]
        self.words = np.concatenate([np.zeros(0, np.int32), *(own for _, own in rows)])
        self.lengths = {}
        offsets = np.cumsum([0, *(len(own) for _, own in rows)])
        for length in sorted({min(n, len(own)) for _, own in rows}):
            places = [(np.arange(at, at + len(own) - length + 1), k) for at, (k, own) in zip(offsets, rows) if min(n, len(own)) == length]
            starts = np.concatenate([p for p, _ in places])
            owner = np.repeat(np.array([k for _, k in places], np.int32), [len(p) for p, _ in places])
            one, two = (window_hashes(self.words, starts, length, radix) for radix in RADIX)
            order = np.lexsort((owner, two, one))
            one, two, starts, owner = one[order], two[order], starts[order], owner[order]
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])  # a window that no other is equal to
            told = new | np.concatenate([[True], owner[1:] != owner[:-1]])
            first = np.flatnonzero(new[told])
            self.lengths[length] = (one[new], starts[new].astype(np.int32), owner[told], np.append(first, told.sum()).astype(np.int32))

    def scan(self, documents: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Words, mask of the hit words, and items with a window there (as places in ``names``), of each document."""
        sizes = np.array([len(d) for d in documents], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])  # a gap after each: no window spans two
        ids = np.zeros(offsets[-1] + 1, np.int32)
        get = self.vocabulary.get
        for d, at in zip(documents, offsets):
            ids[at : at + len(d)] = [get(w, 0) for w in d]
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        cover = np.zeros(len(ids) + 1, np.int64)
        found = [np.zeros(0, np.int64)]  # document and item in one number
        for length, (hashes, places, owners, slices_) in self.lengths.items():
            starts = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(starts):
                continue
            wanted = window_hashes(ids, starts, length, RADIX[0])
            at = np.searchsorted(hashes, wanted, "left")
            while True:  # windows of one hash stand next to each other: mostly there is one
                maybe = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == wanted)
                maybe = maybe[at[maybe] < len(hashes)]
                if not len(maybe):
                    break
                starts, wanted, at = starts[maybe], wanted[maybe], at[maybe]
                same = np.ones(len(starts), bool)
                for k in range(length):
                    same &= ids[starts + k] == self.words[places[at] + k]
                hit, which = starts[same], at[same]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + length, -1)
                where = np.unique((np.searchsorted(offsets, hit, "right") - 1) * len(hashes) + which)  # each window once per document
                doc, which = where // len(hashes), where % len(hashes)
                for d in np.unique(doc):
                    own = which[doc == d]
                    items = np.unique(np.concatenate([owners[slices_[w] : slices_[w + 1]] for w in own]))
                    found.append(d * len(self.names) + items)
                at = at + 1
        hit = np.cumsum(cover)[:-1] > 0
        pairs = np.unique(np.concatenate(found))
        cuts = np.searchsorted(pairs, np.arange(1, len(documents)) * max(len(self.names), 1))
        return sizes, [hit[at : at + n] for at, n in zip(offsets, sizes)], [p % max(len(self.names), 1) for p in np.split(pairs, cuts)]


def pieces(benchmark: DataFrame, n: int, block_bytes: int) -> DataFrame:
    """(name, words): the items' normalised texts, in pieces of about ``block_bytes`` that overlap by n - 1 words (of 2 n words at least)."""

    def cut(batches):
        for part in slices(batches, "text"):
            names, rows = [], []
            for name, text in zip(part.column("name").to_pylist(), texts(part, "text")):
                words = normalised_words(text)
                low = size = 0
                for k, w in enumerate(words):
                    size += len(w) + 1
                    if size > block_bytes and k + 1 - low >= 2 * n and k + 1 < len(words):
                        names.append(name or "")
                        rows.append(b" ".join(words[low : k + 1]))
                        low, size = k + 2 - n, sum(len(x) + 1 for x in words[k + 2 - n : k + 1])
                if words:
                    names.append(name or "")
                    rows.append(b" ".join(words[low:]))
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "words": pa.array(rows, pa.binary())})

    return benchmark.select(F.col("item_id").cast("string").alias("name"), "text").mapInArrow(cut, "name string, words binary")


def blocks(benchmark: DataFrame, n: int, block_bytes: int) -> Iterator[TestWindows]:
    """The items in blocks of bounded size, one after the other."""
    block, held = [], 0
    for name, words in pieces(benchmark, n, block_bytes).toLocalIterator():
        if block and held + len(words) > block_bytes:
            yield TestWindows(block, n)
            block, held = [], 0
        block.append((name, bytes(words)))
        held += len(words)
    yield TestWindows(block, n)


def spans(mask: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [[int(a), int(b)] for a, b in zip(edges[::2], edges[1::2])]


REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def _scan(docs: DataFrame, shared: Broadcast, more: bool) -> DataFrame:
    """``docs`` with the finds of one block, added (``more``) to those it has."""

    def scan(batches):
        block = shared.value
        for part in slices(batches, "text"):
            sizes, hits, items = block.scan([normalised_words(t) for t in texts(part, "text")])
            found = [spans(h) for h in hits]
            names = [[block.names[i] for i in own] for own in items]
            if more:
                before = part.select(["hit_spans", "item_ids"]).to_pylist()
                for i, row in enumerate(before):
                    mask = hits[i].copy()
                    for a, b in row["hit_spans"]:
                        mask[a:b] = True
                    found[i] = spans(mask)
                    names[i] = sorted({*names[i], *row["item_ids"]})
            columns = {name: part.column(name) for name in part.schema.names}
            columns |= {
                "n_words": pa.array(sizes, pa.int64()),
                "hit_spans": pa.array(found, pa.list_(pa.list_(pa.int32()))),
                "item_ids": pa.array(names, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(scan, docs.schema if more else T.StructType([*docs.schema, *REPORT]))


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds to ``docs`` (with a ``text``): n_words, hit_spans ([start, end) in words) and item_ids found.

    With several blocks, each adds its finds to those before it, which are written in between.
    """
    spark = docs.sparkSession
    found, shared, before = docs.drop("n_words", "hit_spans", "item_ids"), None, None
    for block in blocks(benchmark, n, block_bytes):
        if shared is not None:
            written = materialize(found, "scanned")
            shared.destroy()
            if before is not None:
                discard(before)
            found = before = written
        more, shared = shared is not None, spark.sparkContext.broadcast(block)
        del block  # the broadcast has it
        found = _scan(found, shared, more)
    return found


def remove_spans(text: bytes, found: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    if not found:
        return text.decode()
    table = text.translate(ALNUM_TABLE)
    starts = [i for i in range(len(table)) if table[i] != 32 and (not i or table[i - 1] == 32)]
    ends = [i + 1 for i in range(len(table)) if table[i] != 32 and (i + 1 == len(table) or table[i + 1] == 32)]
    kept, at = [], 0
    for a, b in found:
        kept.append(text[at : starts[a]])
        at = ends[b - 1]
    kept.append(text[at:])
    return b"".join(kept).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (action "documents") or passages (action "spans").

    Words that a cut brings together can make a new window, so cutting goes on until a scan finds none.
    """
    if action not in {"documents", "spans"}:
        raise ValueError("action is 'documents' or 'spans'")
    docs, moved = aside(docs, "n_words", "hit_spans", "item_ids")
    schema, names = docs.schema, docs.columns
    report = scan_benchmark(docs, benchmark, n)
    if action == "documents":
        return report.filter(F.size("hit_spans") == 0).select(names).withColumnsRenamed(moved)

    def cut(batches):
        for part in slices(batches, "text"):
            rows = zip(part.column("text").to_pylist(), part.column("hit_spans").to_pylist())
            new = pa.array([t if t is None or not s else remove_spans(t.encode(), s) for t, s in rows], pa.string())
            yield pa.RecordBatch.from_pydict({c: new if c == "text" else part.column(c) for c in names})

    report = materialize(report, "scanned")
    while not report.filter(F.size("hit_spans") > 0).isEmpty():
        before, report = report, materialize(scan_benchmark(report.mapInArrow(cut, schema), benchmark, n), "scanned")
        discard(before)
    return report.select(names).withColumnsRenamed(moved)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    report = scan_benchmark(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return report.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n,
         array_to_string(list_slice(words, i, i + least(10, len(words)) - 1), ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM items WHERE len(words) > 0)),
places AS (
  SELECT row, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS gram
  FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)),
found AS (SELECT p.row, p.i, p.n, w.item_id FROM places p JOIN windows w ON p.gram = w.gram AND p.n = w.n),
hit AS (SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS spot FROM found) GROUP BY row),
own AS (
  SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY row)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(o.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON d.row = h.row LEFT JOIN own o ON d.row = o.row
"""
