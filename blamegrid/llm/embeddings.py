"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A unit vector is turned by random rotations; the signs of the turned coordinates are its code, and with
each rotation goes a correction factor: the inner product of the turned vector with its own code. The
inner product of a code with another turned vector, divided by the factor, is an unbiased estimate of the
cosine, with an error bound that the factor gives. Runs of code bits are the keys of an inverted index;
vectors that share a key are candidates. A candidate pair whose upper confidence bound is below the
threshold is dropped, all others are recomputed exactly in double precision.

The number of key bits grows with the logarithm of the largest label's size, the number of keys follows
from it so that a pair at the threshold shares no key with a probability of ``miss`` at most. Where that
would take more than MOST_KEYS keys (low thresholds, few dimensions) keys get fewer bits; a key of no bits
is shared by all of a label, so in the end all pairs are compared, exactly, in blocks. Pairs are
compared inside tasks (blocks.py) and counted at the first key they share; what leaves a task is a sum
and a spanning forest. Equal vectors of a label are one row, a class, with a count from the start. To a
key's bucket go vector, codes and last correction factor; keys are read off the codes again there.

Cases: a null label, and a vector that is null, empty, zero or has null or non-finite components, links
with nothing; so do vectors of different lengths; repeated rows are links of each other like other equal
vectors; a vec_id that comes with several vectors names each of them; a null vec_id links like any other
and is the smallest only where a component has no other (kept is null for it then); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import forest, in_blocks, pairs, whole_groups
from .common import discard, materialize, table
from .components import connected_components

THRESHOLD = 0.98
MISS = 1e-6
KEY_ROTATIONS = 8
CONFIDENCE = 4.75  # standard deviations of the estimate
MOST_KEYS = 1024


@lru_cache(maxsize=4)
def rotations(dim: int, count: int, seed: int = 7) -> np.ndarray:
    """(count, dim, dim) random orthogonal matrices."""
    rng = np.random.default_rng([seed, dim])
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


class Codes:
    """What the codes look like for vectors of ``dim`` components, ``rows`` of them in the largest label.

    A key is a random choice of ``bits`` of the sign bits of KEY_ROTATIONS rotations; one more rotation serves the
    estimates, so that sharing a key doesn't bias them. The number of keys is the smallest for which a
    pair at the threshold shares none with a probability of ``miss`` at most; the bits are the most for which
    that takes MOST_KEYS keys at most. With no bits there is one key, and every vector has it.
    """

    def __init__(self, dim: int, rows: int, threshold: float = THRESHOLD, miss: float = MISS):
        self.dim, self.threshold = dim, threshold
        self.rotations = KEY_ROTATIONS + 1
        total = dim * KEY_ROTATIONS
        differ = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
        apart = np.arange(total + 1)  # of the bits, how many differ
        logs = np.array([math.lgamma(k + 1) for k in range(total + 1)])
        with np.errstate(divide="ignore", invalid="ignore"):
            chance = np.exp(logs[-1] - logs - logs[::-1] + np.where(apart, apart * np.log(differ), 0.0) + np.where(total - apart, (total - apart) * np.log1p(-differ), 0.0))
        for bits in range(min(total, 30, math.ceil(math.log2(max(rows, 2))) + 4), -1, -1):
            share = np.ones(total + 1)
            for k in range(bits):
                share *= np.maximum(total - apart - k, 0) / (total - k)
            missed = lambda n: (chance * (1 - share) ** n).sum()
            if missed(MOST_KEYS) <= miss:
                break
        low, high = 1, MOST_KEYS
        while low < high:  # the smallest number of keys that will do
            middle = (low + high) // 2
            low, high = (low, middle) if missed(middle) <= miss else (middle + 1, high)
        self.bits, self.keys = bits, low
        rng = np.random.default_rng([11, dim])
        self.chosen = np.stack([rng.choice(total, bits, replace=False) for _ in range(low)]).astype(np.int64)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,rdk->nrk", x, rotations(self.dim, self.rotations), optimize=True)

    def keys_of(self, signs: np.ndarray) -> np.ndarray:
        """(rows, keys) from the signs (rows, rotations, dim) of all rotations."""
        flat = signs[:, :KEY_ROTATIONS].reshape(len(signs), -1)
        found = np.zeros((len(signs), self.keys), np.int32)
        for k in range(self.bits):
            found |= flat[:, self.chosen[:, k]].astype(np.int32) << k
        return found

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs by rotation, correction factors and keys of unit vectors."""
        turned = self.turned(x)
        signs = turned > 0
        factors = np.abs(turned).sum(axis=2) / math.sqrt(self.dim)
        return np.packbits(signs, axis=2), factors.astype(np.float32), self.keys_of(signs)


def usable(embedding: str = "embedding", label: str = "label"):
    """True for vectors that can link: components finite and present, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(
        F.col(label).isNotNull() & F.col(embedding).isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0.0), F.lit(False)
    )


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else very large or small components overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def link_sums(index: DataFrame, codes: Codes) -> DataFrame:
    """(node, links, root) parts: links to sum up, and an edge (node, root) where root isn't null.

    Only vectors that share a key with another are sent to its bucket.
    """
    keyed = index.select("node", "label", F.posexplode("keys").alias("place", "key"))
    last = codes.rotations - 1
    payload = index.select(F.col("node").alias("r"), "n", "vector", "codes", F.get("factors", F.lit(last)).alias("factor"))
    rows = in_blocks(keyed, ["place", "key", "label"], "node").select("node", "place", "bucket", "side").join(payload, F.col("node") == F.col("r")).drop("r")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "side")

    def compare(batches):
        for whole, starts in whole_groups(batches):
            node, n = np.asarray(whole.column("node")), np.asarray(whole.column("n"))
            side = np.asarray(whole.column("side").fill_null(-1))
            place = np.asarray(whole.column("place"))
            vectors = whole.column("vector")
            x = unit(_matrix(vectors, np.float32 if len(vectors[0].as_py()) == 4 * codes.dim else np.float64, codes.dim))
            factor = np.asarray(whole.column("factor")).astype(np.float64)
            packed = _matrix(whole.column("codes"), np.uint8, codes.rotations * ((codes.dim + 7) // 8)).reshape(len(node), codes.rotations, -1)
            signs = np.unpackbits(packed, axis=2)[:, :, : codes.dim]
            code = (signs[:, last].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(codes.dim))
            turned = (x @ rotations(codes.dim, codes.rotations)[last]).astype(np.float32)
            error = CONFIDENCE * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(codes.dim - 1, 1))
            keys = codes.keys_of(signs)
            links, lefts, rights = np.zeros(len(node), np.int64), [], []
            for left, right in pairs(starts, side):
                estimate = np.einsum("nd,nd->n", code[left], turned[right]) / factor[left]
                keep = estimate + error[left] >= codes.threshold
                left, right = left[keep], right[keep]
                before = np.arange(codes.keys) < place[left, None]
                fresh = ~((keys[left] == keys[right]) & before).any(axis=1)
                left, right = left[fresh], right[fresh]
                near = np.einsum("nd,nd->n", x[left], x[right]) >= codes.threshold
                left, right = left[near], right[near]
                links += np.bincount(left, weights=n[right], minlength=len(node)).astype(np.int64)
                links += np.bincount(right, weights=n[left], minlength=len(node)).astype(np.int64)
                lefts.append(left)
                rights.append(right)
            if not lefts:
                continue
            root = node[forest(len(node), np.concatenate(lefts), np.concatenate(rights))]
            told = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array(node[told]), "links": pa.array(links[told]), "root": pa.array(root[told], mask=root[told] == node[told])}
            )

    return rows.mapInArrow(compare, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept."""
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string").alias("label"), usable().alias("ok"))
    kind = (F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit("again"), "embedding", "label").alias("h2"))
    classes = rows.filter("ok").groupBy(*kind).agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    named = rows.select("vec_id", "ok", *kind)
    parts, indexes = [], []
    for dim in [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]:  # one per length of vector
        own = classes.filter(F.size("embedding") == dim)
        largest = own.groupBy("label").count().agg(F.max("count")).first()[0]
        codes = Codes(dim, largest, threshold, miss)
        indexes.append(materialize(_index(own, codes), "codes"))
        parts.append(link_sums(indexes[-1], codes))
    found = parts[0] if parts else classes.select("node", F.col("n").alias("links"), F.col("node").alias("root"))
    for part in parts[1:]:
        found = found.unionByName(part)
    found = materialize(found, "links")
    discard(*indexes)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("root IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = classes.select("h1", "h2", "node", "vec_id", "n").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("vec_id").alias("component_id")).withColumnRenamed("component", "c")
    known = (
        placed.join(sums, "node", "left")
        .join(smallest, F.col("component") == F.col("c"))
        .select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    )
    joined = named.filter("ok").join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    result = joined.select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = named.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _index(classes: DataFrame, codes: Codes) -> DataFrame:
    """The stored index: vector, the codes and correction factors of all rotations, and keys."""

    def encode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                values = part.column("embedding").flatten()
                x = np.asarray(values).reshape(-1, codes.dim)
                packed, factors, keys = codes.encode(unit(x))
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": part.column("node"),
                        "n": part.column("n"),
                        "label": part.column("label"),
                        "vector": pa.array([r.tobytes() for r in x], pa.binary()),
                        "codes": pa.array([r.tobytes() for r in packed], pa.binary()),
                        "factors": pa.array(factors.tolist(), pa.list_(pa.float32())),
                        "keys": pa.array(keys.tolist(), pa.list_(pa.int32())),
                    }
                )

    schema = "node long, n long, label string, vector binary, codes binary, factors array<float>, keys array<int>"
    return classes.select("node", "n", "label", "embedding").mapInArrow(encode, schema)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
