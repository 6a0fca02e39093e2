"""Near-duplicate documents by a MinHash inverted join.

1. Each text becomes its set of word shingles, and the set a signature of ``SIZE`` coordinates (minima
   under as many hash functions). Equal sets are one class from here on.
2. A class is posted under its (coordinate, value) pairs. Two sets at the threshold agree in at least
   ``MATCHES`` coordinates (but for about two pairs in a million), so of the pairs that some other class has too,
   in the order of rising frequency, the first m - MATCHES + 1 of m suffice: the prefix. A class with
   m < MATCHES has no partner and is left out.
3. Skip merging: in each posting list the classes are first held against the smallest one only. Lists
   whose members are connected by then are skipped. In the others all that isn't connected is counted
   inside tasks, block against block. What agrees often enough, directly or by way of others, is a cluster.
4. The full sets confirm links inside clusters. A cluster of up to ``BLOCK`` classes and ``SET_BYTES`` of sets is
   one group; a larger one is cut into blocks, each of which meets itself and the first block, and then whatever isn't linked
   with the cluster's main component yet meets all other blocks. Pairs go from most agreement to least,
   and pairs that are linked already, directly or by way of others, are skipped.
5. Connected components over the links; each row gets the smallest doc_id of its component.

No list or cluster is ever in one task, and what leaves a task is a spanning forest: a class makes a row
or two there, however many near copies it has. Only links between classes that aren't connected otherwise
are left to find at the end; none is left out.

Cases: a text without words (null, empty, blank) has an empty set and links with nothing; one with fewer
words than a shingle is one shingle; repeated rows, of one doc_id or several, share a class; an empty
table gives an empty result; a null doc_id is reported as it is, links like any other and is the smallest
only where a component has no other (kept is null for it then); other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import forest, pairs, whole_groups
from .common import discard, materialize, slices, table, texts
from .components import connected_components

SIZE, MATCHES = 64, 36
PERCENT = 80
BLOCK = 512
SET_BYTES = 32 << 20  # of full sets in a block; a set that is larger by itself is in a block of few
BROADCAST_IDS = 500_000

_MULTIPLIERS = np.random.default_rng(41).integers(0, 1 << 31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDENDS = np.random.default_rng(43).integers(0, 1 << 32, SIZE, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(documents: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    words = [d.lower().split() for d in documents]
    flat = np.empty(sum(map(len, words)), object)
    flat[:] = [w for own in words for w in own]
    codes, distinct = pd.factorize(flat)
    hashes = pd.util.hash_array(np.asarray(distinct, object), categorize=False)[codes] if len(flat) else np.zeros(0, np.uint64)
    found, at = [], 0
    for own in words:
        h, n = hashes[at : at + len(own)], len(own)
        at += n
        if not n:
            found.append(np.zeros(0, np.uint64))
            continue
        length = min(width, n)
        total = np.full(n - length + 1, length, np.uint64)
        for k in range(length):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : n - length + 1 + k])
        found.append(np.unique(total))
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SIZE) minima; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    found = np.empty((len(sets), SIZE), np.uint32)
    for k in range(SIZE):
        found[:, k] = np.minimum.reduceat(x * _MULTIPLIERS[k] + _ADDENDS[k], starts)
    return found


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def place() -> Column:
    """Where a text is found again: a hash of doc_id and text, so that rows without doc_id are not one key."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def with_signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, place, n_shingles, digest (of the set; null if it is empty), signature."""

    def sign(batches):
        for part in slices(batches, "text"):
            sets = shingle_sets(texts(part, "text"), width)
            full = [k for k, s in enumerate(sets) if len(s)]
            nodes, signs = [None] * len(sets), [None] * len(sets)
            if full:
                for k, row in zip(full, signatures([sets[k] for k in full]).view(np.int32)):
                    nodes[k], signs[k] = digest(sets[k]), row
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "row": part.column("row"),
                    "place": part.column("place"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array(nodes, pa.binary()),
                    "signature": pa.array(signs, pa.list_(pa.int32())),
                }
            )

    return docs.select(F.col("doc_id").cast("long"), "row", place().alias("place"), "text").mapInArrow(
        sign, "doc_id long, row binary, place long, n_shingles long, digest binary, signature array<int>"
    )


def postings(classes: DataFrame) -> DataFrame:
    """(node, token): each class under the prefix of its coordinate-value pairs."""
    tokens = classes.select("node", F.posexplode("signature").alias("at", "value")).select(
        "node", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long")).alias("token")
    )
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").withColumnRenamed("token", "of")
    ranked = (
        tokens.join(shared, F.col("token") == F.col("of"))
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))  # SIZE at most
        .filter(F.size("own") >= MATCHES)
    )
    return ranked.select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1))).alias("p")).select("node", "p.token")


def agreeing(candidates: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``candidates(a, b)`` that agree often enough and are near enough in size."""
    sides = [classes.select(F.col("node").alias(f"node_{s}"), F.col("signature").alias(f"sign_{s}"), F.col("n_shingles").alias(f"n_{s}")) for s in "ab"]
    both = candidates.join(sides[0], F.col("a") == F.col("node_a")).join(sides[1], F.col("b") == F.col("node_b"))
    both = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def count(batches):
        for batch in batches:
            left, right = (np.asarray(batch.column(f"sign_{s}").flatten()).reshape(-1, SIZE) for s in "ab")
            keep = pa.array((left == right).sum(axis=1) >= MATCHES)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(keep)

    return both.select("a", "b", "sign_a", "sign_b").mapInArrow(count, "a long, b long")


def load() -> Column:
    """The part of a block that a class takes up, by rows and by the bytes of its set."""
    return F.lit(1.0 / BLOCK) + F.col("n_shingles") * 8.0 / SET_BYTES


def main_and_rest(rows: DataFrame, key: str) -> DataFrame:
    """``rows(key, node, component, load)`` dealt into groups in which the main component of a key meets the rest.

    Of each key, the rows of the component that comes most often meet only the other rows; both parts are
    cut into blocks, by the sum of their loads. Adds bucket and side, as in blocks.py.
    """
    sizes = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("load"))
    lists = sizes.groupBy(key).agg(F.max(F.struct("n", "component", "load")).alias("main"), F.sum("n").alias("all"), F.sum("load").alias("loads")).select(
        F.col(key).alias("of"),
        F.col("main.component").alias("main"),
        F.ceil("main.load").cast("int").alias("main_blocks"),
        F.when(F.col("all") > F.col("main.n"), F.greatest(F.ceil(F.col("loads") - F.col("main.load")), F.lit(1))).otherwise(0).cast("int").alias("rest_blocks"),
    )
    rows = rows.join(lists.filter("rest_blocks > 0"), F.col(key) == F.col("of"))
    is_main = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    rows = rows.withColumn("is_main", is_main).withColumn("own", own).withColumn("key", F.hex(key))
    with_rest = F.transform(
        F.sequence(F.lit(0), F.col("rest_blocks") - 1),
        lambda k: F.struct(
            F.when(F.col("is_main"), F.concat_ws("/", "key", k, F.lit("main"), "own"))
            .otherwise(F.concat_ws("/", "key", F.least("own", k), F.greatest("own", k)))
            .alias("bucket"),
            F.when(F.col("is_main"), F.lit(1)).when(F.col("own") != k, (F.col("own") > k).cast("int")).alias("side"),
        ),
    )
    with_main = F.transform(
        F.sequence(F.lit(0), F.col("main_blocks") - 1),
        lambda k: F.struct(F.concat_ws("/", "key", "own", F.lit("main"), k).alias("bucket"), F.lit(0).alias("side")),
    )
    groups = F.when(F.col("is_main"), with_rest).otherwise(F.concat(with_rest, with_main))
    return rows.select("node", "component", F.explode(groups).alias("g")).select("node", "component", "g.bucket", "g.side")


def in_groups(dealt: DataFrame, *payloads: DataFrame) -> DataFrame:
    for payload in payloads:
        dealt = dealt.join(payload.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "side")


class _Group:
    """The columns of a table of whole groups, and which pairs may be near.

    Components are numbered in the order of ``lead`` rows (of a cluster's first block), then of names.
    """

    def __init__(self, whole: pa.Table, percent: int):
        self.node = np.asarray(whole.column("node"))
        self.side = np.asarray(whole.column("side").fill_null(-1))
        self.sizes = np.asarray(whole.column("n_shingles"))
        self.sign = np.asarray(whole.column("signature").combine_chunks().flatten()).reshape(-1, SIZE)
        self.percent = percent
        component = np.asarray(whole.column("component"))
        self.names, first, self.component = np.unique(component, return_index=True, return_inverse=True)
        if "lead" in whole.column_names:
            order = np.argsort(~np.asarray(whole.column("lead"))[first], kind="stable")
            self.names, place = self.names[order], np.argsort(order)
            self.component = place[self.component]
        if "shingles" in whole.column_names:
            self.sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in whole.column("shingles").chunks for x in chunk]
            self.maps = np.zeros((len(self.sets), 64), np.uint64)
            for row, own in zip(self.maps, self.sets):
                seen = np.zeros(4096, bool)
                seen[own >> np.uint64(52)] = True
                row[:] = np.packbits(seen).view(np.uint64)
            self.hidden = self.sizes - np.bitwise_count(self.maps).sum(axis=1)  # shingles that share a bit with others

    def near(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs that are in different components: those that agree often enough, and how often."""
        a, b = self.sizes[left], self.sizes[right]
        keep = (self.component[left] != self.component[right]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * self.percent)
        left, right = left[keep], right[keep]
        matches = (self.sign[left] == self.sign[right]).sum(axis=1)
        keep = matches >= MATCHES
        return left[keep], right[keep], matches[keep]

    def possible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Mask of the pairs that can pass: a bitmap of the sets bounds what they have in common from above."""
        found = np.empty(len(left), bool)
        for at in range(0, len(left), 8192):
            x, y = left[at : at + 8192], right[at : at + 8192]
            common = np.bitwise_count(self.maps[x] & self.maps[y]).sum(axis=1, dtype=np.int64) + np.minimum(self.hidden[x], self.hidden[y])
            found[at : at + 8192] = (100 + self.percent) * common >= self.percent * (self.sizes[x] + self.sizes[y])
        return found

    def passes(self, x: int, y: int) -> bool:
        common = len(self.sets[x]) + len(self.sets[y]) - len(np.unique(np.concatenate([self.sets[x], self.sets[y]])))
        return (100 + self.percent) * common >= self.percent * (len(self.sets[x]) + len(self.sets[y]))


def open_list_links(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest, group by group, of the pairs that agree often enough."""

    def compare(batches):
        for whole, starts in whole_groups(batches):
            group = _Group(whole, percent)
            found = [group.near(left, right)[:2] for left, right in pairs(starts, group.side)]
            if found:
                label = forest(len(group.node), *(np.concatenate(x) for x in zip(*found)))
                told = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_pydict({"a": pa.array(group.node[told]), "b": pa.array(group.node[label[told]])})

    return dealt.mapInArrow(compare, "a long, b long")


def confirmed_links(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that the groups' pairs link, by full sets: each to the first one it is linked with."""

    def compare(batches):
        for whole, starts in whole_groups(batches, 1024):
            group = _Group(whole, percent)
            up = list(range(len(group.names)))

            def root(c: int) -> int:
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            for left, right in pairs(starts, group.side):
                left, right, matches = group.near(left, right)
                keep = group.possible(left, right)
                left, right, matches = left[keep], right[keep], matches[keep]
                before = len(left)
                for i in np.argsort(-matches, kind="stable").tolist():
                    x, y = int(left[i]), int(right[i])
                    p, q = root(int(group.component[x])), root(int(group.component[y]))
                    if p != q and group.passes(x, y):
                        up[max(p, q)] = min(p, q)
                if before:
                    group.component = np.array([root(c) for c in range(len(up))])[group.component]
            told = [c for c in range(len(up)) if root(c) != c]
            if told:
                tops = [root(c) for c in told]
                yield pa.RecordBatch.from_pydict({"a": pa.array(group.names[told]), "b": pa.array(group.names[tops])})

    return dealt.mapInArrow(compare, "a long, b long")


def first_blocks(clusters: DataFrame) -> DataFrame:
    """``clusters(node, cluster, blocks)`` dealt into blocks; each meets itself and the cluster's first block."""
    rows = clusters.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    places = F.when(
        F.col("own") == 0,
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("at"), F.when(k == 0, F.lit(2)).otherwise(F.lit(0)).alias("side"))),
    ).otherwise(F.array(F.struct(F.col("own").alias("at"), F.lit(2).alias("side"))))
    dealt = rows.select("node", "cluster", (F.col("own") == 0).alias("lead"), F.explode(places).alias("p"))
    return dealt.select("node", F.col("node").alias("component"), "lead", F.concat_ws("/", F.hex("cluster"), "p.at").alias("bucket"), "p.side")


def _labels(links: DataFrame) -> DataFrame:
    """(node, component) in two steps along ``links(a, b)``: not all that is connected, but connected for sure."""
    up = links.groupBy("a").agg(F.min("b").alias("b"))
    jump = up.select(F.col("a").alias("at"), F.col("b").alias("next"))
    return up.join(jump, F.col("b") == F.col("at"), "left").select(F.col("a").alias("node"), F.coalesce("next", "b").alias("component"))


def clusters_of(posted: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, cluster): classes connected by pairs that agree often enough; and the classes with partners in a list."""
    heads = posted.groupBy("token").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("token").alias("of"), "head")
    lists = materialize(posted.join(heads, F.col("token") == F.col("of")).select("node", "token", "head"), "lists")
    signed = materialize(classes.select("node", "n_shingles", "signature").join(lists.select("node").distinct(), "node", "left_semi"), "partners")
    first = lists.filter(F.col("node") != F.col("head")).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    links = materialize(agreeing(first, signed, percent), "agreeing")
    placed = _placed(lists.select("node", "token"), _labels(links))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select(F.col("token").alias("of"))
    open_ = materialize(placed.join(mixed, F.col("token") == F.col("of"), "left_semi"), "open")
    more = materialize(open_list_links(in_groups(main_and_rest(open_.withColumn("load", F.lit(1.0 / BLOCK)), "token"), signed), percent), "more")
    clusters = connected_components(links.unionByName(more)).withColumnRenamed("component", "cluster")
    discard(lists, links, open_, more)
    return clusters, signed


def _placed(rows: DataFrame, members: DataFrame) -> DataFrame:
    return rows.join(members, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _among(docs: DataFrame, places: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``docs`` whose place is in ``places(wanted)``; the places are broadcast up to ``bound`` of them."""
    small = places.limit(bound + 1).count() <= bound
    return docs.join(F.broadcast(places) if small else places, place() == F.col("wanted"), "left_semi")


def components(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs(doc_id, text, row)``: doc_id, row, n_shingles, component (null for an empty set), component_id."""
    docs = docs.select("doc_id", "text", "row")
    signed = materialize(with_signatures(docs, width), "signed")
    classes = signed.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.min("place").alias("place"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    posted = materialize(postings(classes), "posted")
    clusters, partners = clusters_of(posted, classes, percent)
    clusters = clusters.join(partners.select(F.col("node").alias("_node"), load().alias("load")), F.col("node") == F.col("_node")).drop("_node")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.sum("load")).cast("int").alias("blocks")).withColumnRenamed("cluster", "_cluster")
    clusters = materialize(clusters.join(sizes, F.col("cluster") == F.col("_cluster")).drop("_cluster"), "clusters")
    discard(posted)

    own = classes.select("node", "digest", "place").join(clusters.select("node"), "node", "left_semi")
    wanted = materialize(own.select(F.col("place").alias("wanted")).distinct(), "wanted")
    sets = _sets(_among(docs, wanted), width).withColumnRenamed("digest", "of")
    sets = materialize(own.join(sets, F.col("digest") == F.col("of")).select("node", "shingles"), "sets")
    payloads = (partners, sets)
    links = materialize(confirmed_links(in_groups(first_blocks(clusters), *payloads), percent), "links")
    found = [links]
    large = clusters.filter("blocks > 1").select("node", "cluster", "load")
    if not large.isEmpty():
        rest = materialize(main_and_rest(_placed(large, _labels(links)), "cluster"), "rest")
        found.append(materialize(confirmed_links(in_groups(rest, *payloads), percent), "links"))
        links = links.unionByName(found[1])
        discard(rest)
    members = connected_components(links)
    discard(partners, sets, wanted, clusters, *found)

    named = _placed(classes.select("node", "digest", "doc_id"), members)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("component", "c")
    named = named.join(smallest, F.col("component") == F.col("c")).select(F.col("digest").alias("d"), "component", "component_id")
    rows = signed.select("doc_id", "row", "n_shingles", "digest")
    columns = ("doc_id", "row", "n_shingles", "component", "component_id")
    found = rows.filter("digest IS NOT NULL").join(named, F.col("digest") == F.col("d")).select(*columns)
    alone = rows.filter("digest IS NULL").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return found.unionByName(alone.select(*columns))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept."""
    rows = components(docs.select("doc_id", "text", F.lit(None).cast("binary").alias("row")), width, percent)
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_per_component(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` per component, whole: that of the smallest doc_id, null last, then of a hash of the text.

    Rows are told apart by a hash of doc_id and text. A text without words is a component of its own; of
    rows that repeat doc_id and text one stays.
    """
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "text")))
    keyed = docs.withColumn("_row", F.unhex(F.md5(own)))
    rows = components(keyed.select("doc_id", "text", F.col("_row").alias("row")), width, percent)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))["row"]
    first = rows.filter("component IS NOT NULL").groupBy("component").agg(least.alias("_kept")).select("_kept")
    alone = rows.filter("component IS NULL").select(F.col("row").alias("_kept"))
    unique = keyed.dropDuplicates(["_row"])
    return unique.join(first.unionByName(alone), F.col("_row") == F.col("_kept"), "left_semi").select(docs.columns)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(digest, shingles): the full sets of ``docs``, as bytes, one row per class."""

    def shingle(batches):
        for part in slices(batches, "text"):
            sets = [s for s in shingle_sets(texts(part, "text"), width) if len(s)]
            yield pa.RecordBatch.from_pydict(
                {"digest": pa.array([digest(s) for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}
            )

    return docs.select("text").mapInArrow(shingle, "digest binary, shingles binary").dropDuplicates(["digest"])


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
