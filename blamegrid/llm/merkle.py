"""Merkle manifest of a dataset: few stored levels, proofs from what is regenerated below them.

Each row of ``documents`` is a leaf, the leaves of a source make a tree of runs of three, and the roots of the
sources make one more tree. Of a tree only the leaves and every ``every``-th level above them are stored. A
proof needs the siblings on all levels: the 3 ** every stored nodes of an aligned subtree meet in one row, its
missing interior nodes are regenerated from them, each node's siblings are emitted, and the regenerated nodes
are gone with the row. That is done from the top down: what a subtree's nodes emit is put before the siblings
of the stored node above it.

A digest is the SHA-256, in lowercase hex, of its inputs one after the other, digests as hex. A leaf's inputs are
its columns, ``-`` for null, else the count of UTF-8 bytes, a colon and the value. Places inside a source come
from sorted ranges (operators.positions), subtrees are groups of 3 ** every slim rows: no task holds a source.
Everything is built in; texts are hashed where they are read and never shuffled.

Cases: rows without doc_id come first in their source; rows of one doc_id are ordered by their leaf, and rows
equal in all five columns are leaves of their own, each with a proof of its own; a null source is a source,
before all others; null and empty texts are different leaves; the crc32 of a null doc_id is that of the empty text;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import sums_before
from .common import crc_mod, discard, materialize, table

RUN = 3
EVERY = 4
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(values: dict[str, Column]) -> Column:
    """The digest of a row's values, in the order of LEAF_COLUMNS."""
    texts = (values[c].cast("string") for c in LEAF_COLUMNS)
    return sha(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def tree_key(source: Column) -> Column:
    """A name for a source's tree that isn't null and sorts like the source, null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _up(nodes: Column) -> Column:
    """The digests above an array of digests, run by run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda r: sha(F.array_join(F.slice(nodes, r * RUN + 1, F.lit(RUN)), "")))


def _layers(groups: DataFrame, every: int) -> DataFrame:
    """``groups(tree, group, nodes)`` with ``rise``, the levels up to their one node, and the layers n0, n1, ... on the way.

    A first group that isn't full is its whole tree; every other group rises by ``every`` levels.
    """
    powers = F.array(*(F.lit(RUN**k) for k in range(every)))
    whole = (F.col("group") == 0) & (F.size("nodes") < RUN**every)
    found = groups.withColumn("whole", whole).withColumn(
        "rise", F.when(F.col("whole"), F.size(F.filter(powers, lambda p: p < F.size("nodes")))).otherwise(F.lit(every))
    )
    found = found.withColumn("n0", F.transform("nodes", lambda n: n["digest"]))
    for k in range(every):
        found = found.withColumn(f"n{k + 1}", F.when(F.col("rise") > k, _up(F.col(f"n{k}"))).otherwise(F.col(f"n{k}")))
    return found


def _grouped(nodes: DataFrame, every: int) -> DataFrame:
    """Aligned subtrees of ``nodes(tree, place, digest, ...)``: tree, group, nodes in their order."""
    group = F.floor(F.col("place") / RUN**every).cast("long").alias("group")
    rest = [c for c in nodes.columns if c not in ("tree", "place")]
    return nodes.groupBy("tree", group).agg(F.sort_array(F.collect_list(F.struct("place", *rest))).alias("nodes"))  # 3 ** every at most


@dataclass
class Forest:
    """Stored levels of trees: ``levels[k]`` has (tree, place, digest, ...) of level k * every, ``roots[k]`` has (tree, digest) of trees that end below the next."""

    levels: list[DataFrame]
    roots: list[DataFrame]
    every: int

    def all_roots(self) -> DataFrame:
        found = self.roots[0]
        for more in self.roots[1:]:
            found = found.unionByName(more)
        return found

    def tables(self) -> list[DataFrame]:
        return [*self.levels, *self.roots]


def build(leaves: DataFrame, every: int = EVERY) -> Forest:
    """The forest over ``leaves(tree, place, digest, ...)``: one job and one shuffle per stored level."""
    levels, roots = [materialize(leaves, "level")], []
    while True:
        layers = _layers(_grouped(levels[-1].select("tree", "place", "digest"), every), every)
        tops = materialize(layers.select("tree", F.col("group").alias("place"), F.get(f"n{every}", F.lit(0)).alias("digest"), "whole"), "tops")
        roots.append(materialize(tops.filter("whole").select("tree", "digest"), "roots"))
        above = materialize(tops.filter("NOT whole").select("tree", "place", "digest"), "level")
        discard(tops)
        if above.isEmpty():
            discard(above)
            return Forest(levels, roots, every)
        levels.append(above)


#: One level of a proof: the digests of a run's other nodes, those before one's own and those after, strung together.
STEP = "struct<before:string,after:string>"


def _steps(every: int, place: Column) -> Column:
    """The siblings of the base node ``place`` (inside its group) on each level up to the group's one node."""
    steps = []
    for k in range(every):
        at = F.floor(place / RUN**k).cast("int")
        own, layer = at % RUN, F.col(f"n{k}")
        before = F.array_join(F.slice(layer, at - own + 1, own), "")
        after = F.array_join(F.slice(layer, at + 2, F.lit(RUN - 1) - own), "")
        steps.append(F.when(F.col("rise") > k, F.struct(before.alias("before"), after.alias("after"))))
    return F.array_compact(F.array(*steps))


def _paths(nodes: DataFrame, above: DataFrame, every: int) -> DataFrame:
    """``nodes`` with ``path``: their steps inside their subtree, then the path of the stored node above, from ``above(tree, place, path)``."""
    groups = _layers(_grouped(nodes, every), every)
    met = groups.join(above.select(F.col("tree").alias("of"), F.col("place").alias("at"), F.col("path").alias("rest")), (F.col("tree") == F.col("of")) & (F.col("group") == F.col("at")))
    first = F.col("group") * RUN**every
    each = met.select("tree", F.explode(F.transform("nodes", lambda n: F.struct(n.alias("node"), F.concat(_steps(every, n["place"] - first), F.col("rest")).alias("path")))).alias("each"))
    return each.select("tree", "each.node.*", "each.path")


def paths(forest: Forest, tops: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The leaves with the path to their root and on; ``tops(tree, path)`` is what follows a tree's root.

    With ``wanted(tree, place)``, only for those leaves: on the lowest level only their subtrees are regenerated.
    """
    above = None
    for k in reversed(range(len(forest.levels))):
        ends = forest.roots[k].join(tops, "tree").select("tree", F.lit(0).cast("long").alias("place"), "path")
        over = ends if above is None else above.unionByName(ends)
        nodes = forest.levels[k]
        if k == 0 and wanted is not None:
            subtree = ["tree", F.floor(F.col("place") / RUN**forest.every).alias("subtree")]
            keys = wanted.select(*subtree).distinct()
            nodes = nodes.withColumn("subtree", subtree[1]).join(keys, ["tree", "subtree"], "left_semi").drop("subtree")
            return _paths(nodes, over, forest.every).join(wanted.select("tree", "place"), ["tree", "place"], "left_semi")
        above = _paths(nodes, over, forest.every)
        if k:
            above = materialize(above.select("tree", "place", "path"), "paths")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda digest, step: sha(step["before"], digest, step["after"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path, from the leaf to the root, strung together."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


@dataclass
class Manifest:
    """The trees of the sources, the tree of their roots, and (digest) of the dataset in ``root``."""

    sources: Forest
    top: Forest
    root: DataFrame

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """tree, place, the leaves' own columns, digest (the leaf), path, subroot, root: of all leaves, or of those of ``wanted(tree, place)``."""
        ends = self.top.all_roots().select("tree", F.array().cast(f"array<{STEP}>").alias("path"))
        tops = paths(self.top, ends).select(F.col("of").alias("tree"), "path")
        subroots = self.sources.all_roots().select("tree", F.col("digest").alias("subroot"))
        tops = materialize(tops.join(subroots, "tree").join(F.broadcast(self.root.withColumnRenamed("digest", "root"))), "top")  # one row: the root
        marked = tops.select("tree", F.struct(F.col("subroot"), F.col("root")).alias("marks"), "path")
        found = paths(self.sources, marked.select("tree", "path"), wanted)
        return _with_marks(found, marked)

    def save(self, path: str) -> None:
        """Writes the stored levels and roots; an existing manifest is an error."""
        for name, forest in (("sources", self.sources), ("top", self.top)):
            for k, (level, roots) in enumerate(zip(forest.levels, forest.roots)):
                level.write.parquet(f"{path}/{name}/every={forest.every}/level={k}/nodes")
                roots.write.parquet(f"{path}/{name}/every={forest.every}/level={k}/roots")
        self.root.write.parquet(f"{path}/root")


def _with_marks(found: DataFrame, marked: DataFrame) -> DataFrame:
    """Adds subroot and root to leaves; a source's rows are dealt over SALTS keys if there are too many sources to broadcast."""
    marks = marked.select("tree", "marks.*")
    if marked.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return found.join(F.broadcast(marks), "tree")  # its number is checked
    salted = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", (F.col("place") % SALTS).cast("int")).join(salted, ["tree", "salt"]).drop("salt")


BROADCAST_SOURCES, SALTS = 100_000, 32


def leaves_of(docs: DataFrame, *more: Column) -> DataFrame:
    """tree, place, digest, doc_id and ``more`` of each row: leaves ascend by doc_id, then by digest."""
    leaf = leaf_digest({c: F.col(c) for c in LEAF_COLUMNS}).alias("digest")
    rows = docs.select(tree_key(F.col("source").cast("string")).alias("tree"), "doc_id", leaf, *more).withColumn("nr", F.monotonically_increasing_id())
    return sums_before(rows, ["tree"], ["doc_id", "digest", "nr"], F.lit(1), "place").drop("nr")


def build_manifest(docs: DataFrame, *more: Column, every: int = EVERY) -> Manifest:
    """The manifest of ``docs`` with the columns LEAF_COLUMNS; ``more`` columns stay with the leaves."""
    sources = build(leaves_of(docs, *more), every)
    subroots = sources.all_roots().select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    top = build(sums_before(subroots, ["tree"], ["of"], F.lit(1), "place"), every)
    return Manifest(sources, top, top.all_roots().select("digest"))


def load_manifest(spark: SparkSession, path: str, every: int = EVERY) -> Manifest:
    """A manifest as saved; ``every`` is that of its building."""

    def forest(name: str) -> Forest:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/every={every}")
        count = len(at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
        read = [[spark.read.parquet(f"{path}/{name}/every={every}/level={k}/{kind}") for k in range(count)] for kind in ("nodes", "roots")]
        return Forest(*read, every)

    return Manifest(forest("sources"), forest("top"), spark.read.parquet(f"{path}/root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf and proof, and whether a copy of the row, every other one tampered with, still folds to the root."""
    values = {c: F.col(c) for c in LEAF_COLUMNS} | {"text": F.translate("text", "\n", "")}
    tampered = F.when(crc_mod(F.col("doc_id"), 2) == 0, leaf_digest(values)).alias("tampered")
    manifest = build_manifest(table(spark, sf_dir, "documents"), tampered)
    folded = manifest.proofs().withColumn("folded_root", fold(F.coalesce("tampered", "digest"), F.col("path")))
    return folded.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


OP12_SQL = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text, replace(text, chr(10), '') AS cut,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, tree, leaf, CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) ELSE leaf END AS copy,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf FROM told)),
nodes AS (
  SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 3),
subroots AS (SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, place // 3),
whole AS (
  SELECT tree, level, place, digest FROM nodes WHERE n > 1
  UNION ALL SELECT s.tree, s.height + t.level, t.place, t.digest FROM tops t CROSS JOIN subroots s WHERE t.n > 1),
own AS (
  SELECT l.tree, l.place AS leaf_place, k.level, CASE WHEN k.level < s.height THEN l.place // CAST(pow(3, k.level) AS BIGINT) ELSE s.place // CAST(pow(3, k.level - s.height) AS BIGINT) END AS at
  FROM leaves l JOIN subroots s USING (tree) JOIN (SELECT DISTINCT tree, level FROM whole) k USING (tree)),
steps AS (
  SELECT o.tree, o.leaf_place, o.level, coalesce(string_agg(w.digest, '' ORDER BY w.place) FILTER (WHERE w.place < o.at), '') AS before,
         coalesce(string_agg(w.digest, '' ORDER BY w.place) FILTER (WHERE w.place > o.at), '') AS after
  FROM own o JOIN whole w ON w.tree = o.tree AND w.level = o.level AND w.place // 3 = o.at // 3
  GROUP BY o.tree, o.leaf_place, o.level),
proofs AS (SELECT tree, leaf_place AS place, string_agg(before || after, '' ORDER BY level) AS proof FROM steps GROUP BY tree, leaf_place),
folded AS (
  SELECT tree, place, 0 AS level, copy AS digest FROM leaves
  UNION ALL
  SELECT f.tree, f.place, f.level + 1, sha256(s.before || f.digest || s.after) FROM folded f JOIN steps s ON s.tree = f.tree AND s.leaf_place = f.place AND s.level = f.level)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM leaves l JOIN subroots s USING (tree) CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t LEFT JOIN proofs p ON p.tree = l.tree AND p.place = l.place
JOIN (SELECT tree, place, arg_max(digest, level) AS digest FROM folded GROUP BY tree, place) f ON f.tree = l.tree AND f.place = l.place
"""
