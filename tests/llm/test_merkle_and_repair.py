"""Merkle manifest and conversation repair against plain versions."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from blamegrid.llm import merkle, repair

# --- merkle ---


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """Root, and per leaf the (before, after) texts from the bottom up."""
    layers = [leaves]
    while len(layers[-1]) > 1:
        layers.append([sha(*layers[-1][k : k + 3]) for k in range(0, len(layers[-1]), 3)])
    found = []
    for place in range(len(leaves)):
        path = []
        for layer in layers[:-1]:
            run = layer[place - place % 3 : place - place % 3 + 3]
            path.append(("".join(run[: place % 3]), "".join(run[place % 3 + 1 :])))
            place //= 3
        found.append(path)
    return layers[-1][0], found


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, s or ""))
    trees = {}
    for s in sources:
        leaves = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r)) for r in rows if r[1] == s))
        trees[s] = [(d if known else None, leaf) for known, d, leaf in leaves], *plain_tree([leaf for *_, leaf in leaves])
    root, tops = plain_tree([trees[s][1] for s in sources])
    return [(d, leaf, trees[s][1], root, path + top) for s, top in zip(sources, tops) for (d, leaf), path in zip(trees[s][0], trees[s][2])]


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("every, sizes", [(1, (28, 9, 3, 2)), (2, (27, 4)), (4, (1,)), (4, (82, 100, 9, 81, 1, 7))])
def test_manifest_equals_plain_trees(spark, every, sizes):
    rows = [(100 * k + i, f"s{k}" if k else None, "en", None, f"é{i}\n") for k, n in enumerate(sizes) for i in range(n)]
    found = merkle.build_manifest(spark.createDataFrame(rows, DOCS), every=every).proofs().collect()
    got = sorted((r["doc_id"], r["digest"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["path"]]) for r in found)
    assert got == sorted(plain_manifest(rows))


def test_manifest_of_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, "a", "en", 1, ""), (5, "a", "en", 1, "x"), (5, "a", "en", 1, "y"), (5, "a", "en", 1, "y"), (7, "", "en", 3, "\n"), (7, "é", None, 3, "b" * 100_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit(1)).withColumn("tree", F.lit("t")).withColumn("place", F.lit(0))
    manifest = merkle.build_manifest(docs)
    found = manifest.proofs().withColumn("folded", merkle.fold(F.col("digest"), F.col("path"))).collect()
    got = sorted(((r["doc_id"], r["digest"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["path"]]) for r in found), key=repr)
    assert got == sorted(plain_manifest(rows), key=repr)
    assert all(r["folded"] == r["root"] for r in found)
    assert merkle.build_manifest(spark.createDataFrame([], DOCS)).proofs().count() == 0


def test_proofs_of_wanted_leaves_from_a_saved_manifest(spark, tmp_path):
    rows = [(i, f"s{i % 3 and 1}", "en", i, f"text {i}") for i in range(500)]
    whole = merkle.build_manifest(spark.createDataFrame(rows, DOCS))
    whole.save(str(tmp_path / "manifest"))
    again = merkle.load_manifest(spark, str(tmp_path / "manifest"))
    wanted = spark.createDataFrame([("=s0", 3), ("=s1", 0), ("=s1", 300)], "tree string, place long")
    found = again.proofs(wanted).collect()
    assert sorted((r["tree"], r["place"]) for r in found) == [("=s0", 3), ("=s1", 0), ("=s1", 300)]
    plain = {d: (leaf, path) for d, leaf, *_, path in plain_manifest(rows)}
    assert all(plain[r["doc_id"]] == (r["digest"], [tuple(s) for s in r["path"]]) for r in found)


def test_tampering_is_found(spark, tmp_path):
    rows = [(i, "s", "en", i, "a\nb" if i % 3 else "ab") for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 != 0 or r["doc_id"] % 3 == 0)


# --- repair ---


def plain_repair(rows):
    """(cost, audit, repaired rows) of rows (role, text) by trying all edits, best first."""
    told, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        told.append((role, text, fault))
    best = {(0, ""): (0, "", ())}  # (place, state) to way; the state is the last initial
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def better(table, key, way):
        if key not in table or way[:2] < table[key][:2]:
            table[key] = way
            return True
        return False

    for place in range(len(told) + 1):
        changed = True
        while changed:
            changed = False
            for q in "", "s", "u", "a":
                if (place, q) in best:
                    cost, audit, said = best[place, q]
                    for t in set(after[q]) & {"u", "a"}:
                        changed |= better(best, (place, t), (cost + 5, audit + "I", (*said, (names[t], ""))))
        if place == len(told):
            break
        role, text, fault = told[place]
        for q in "", "s", "u", "a":
            if (place, q) in best:
                cost, audit, said = best[place, q]
                better(best, (place + 1, q), (cost + 2, audit + "D", said))
                if fault in (None, "truncated"):
                    extra = 5 * (fault == "truncated")
                    if role[:1] and role[:1] in after[q]:
                        better(best, (place + 1, role[:1]), (cost + extra, audit + "K", (*said, (role, text))))
                    for t in set(after[q]) & {"u", "a"}:
                        better(best, (place + 1, t), (cost + extra + 1, audit + "R", (*said, (names[t], text))))
    return min(best[len(told), q] for q in ("", "a") if (len(told), q) in best)


def test_all_short_signatures_cost_what_trying_costs():
    row = {"s": ("system", "S."), "u": ("user", "U."), "a": ("assistant", "A."), "o": ("tool", "O."), "U": ("user", "open"), "A": ("assistant", "open"), "S": ("system", "open"), "O": ("", "open"), "x": ("user", " ")}
    for n in range(5):
        automaton = repair.SuffixAutomaton()
        made = 0
        for letters in sorted(itertools.product("suaoUx" if n > 3 else row, repeat=n), key=lambda s: s[::-1]):
            rows = [(role, f"{k}{text}" if text.strip() else text) for k, (role, text) in enumerate(row[x] for x in letters)]
            node = automaton.solve("", "".join(letters))
            made += n
            want = plain_repair(rows)
            assert (node.cost[0], node.plan[0].translate(str.maketrans(*repair.AUDIT))) == want[:2], letters
            assert node.own[0] == node.cost[0]
        assert n < 3 or automaton.made < made / 2  # suffixes are shared


def _conversations(seed, count, longest):
    draw = random.Random(seed)
    for conv in range(count):
        for _ in range(draw.randrange(longest)):
            turn = draw.choice([None, *range(12)])
            yield conv if conv else None, turn, draw.choice(["user", "assistant", "system", "tool", "", None]), draw.choice(["Yes.", "No!", "well", "", "  \n", None, "So?\n ", "ok. and"])


@pytest.mark.parametrize("piece", [1, 3, 2048])
def test_conversations_of_any_length_and_pieces(spark, piece):
    rows = list(_conversations(3, 12, 60))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit("own")).withColumn("place", F.lit(9))
    found = repair.repair(turns, piece=piece)
    report = {r["conv_id"]: r for r in found.report().collect()}
    said = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(found.turns()).collect()}
    for conv in {r[0] for r in rows}:
        key = None if conv is None else str(conv)
        own = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda w: (*w[:3], w[3].encode(), hashlib.sha256(w[3].encode()).hexdigest()))
        cost, audit, repaired = plain_repair([w[2:] for w in own])
        initials = [w[2][:1] for w in own]
        assert (report[key]["cost"], report[key]["audit"]) == (cost, audit)
        assert report[key]["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert said.get(key, hashlib.sha256(b"").hexdigest()) == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()


def test_repair_of_nothing_and_of_what_is_lost(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/conversations.parquet"))
    assert repair.op13_conversation_repair(spark, str(tmp_path / "none")).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 1, "user", "Hello.")], schema).write.parquet(str(tmp_path / "lost/conversations.parquet"))
    (row,) = repair.op13_conversation_repair(spark, str(tmp_path / "lost")).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
