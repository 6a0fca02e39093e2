"""The pipeline's stages against what their operators promise, on small documents."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from blamegrid.llm import mixing

from .test_minhash import brute as near
from .test_text_models import brute_hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(8)
    vocabulary = {"en": "the of and with that this from house river stone".split(), "fr": "le les des avec dans une maison rivière pierre où".split()}
    sentence = lambda lang: (" ".join(rng.choice(vocabulary[lang]) + rng.choice(("", "", "s", "n")) for _ in range(12)) + ".").capitalize()
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs, labels = [], []
    for k in range(160):
        lang = "en" if k % 3 else "fr"
        text = "\n".join(sentence(lang) for _ in range(rng.randrange(3, 8)))
        if k % 8 == 1:
            text = " ".join(f"{w.upper()}!!! ###" for w in text.split())
            labels.append((k, 0, 0))
        else:
            labels.append((k, 1, 0))
        if k in (20, 21):
            text = docs[18][1]
        if k == 30:
            text += f" {item}"
        docs.append((k, text, lang, rng.choice(["s1", "s2", None]), len(text)))
    docs += [(500, "12345", None, "s1", 5), (501, None, None, "s1", 0), (502, docs[18][1] + " Again.", "en", "s2", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, folder), f"test-{name}")
        if name != "mix":
            assert docs.columns == COLUMNS
        kept.append(docs.collect())
    ids = [{r["doc_id"] for r in rows} for rows in kept]
    assert ids[0] - ids[1] == {500, 501}
    junk = {k for k in range(160) if k % 8 == 1}
    assert ids[1] - ids[2] == junk
    groups = near([(r["doc_id"], r["text"]) for r in kept[2]], 5)
    assert ids[3] == {d for d, _, _, keep in groups if keep} and not {20, 21} & ids[3]
    hits = brute_hits([(r["doc_id"], r["text"]) for r in kept[3]], [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")])
    assert ids[3] - ids[4] == {d for d, _, n, _ in hits if n} == {30}
    assert ids[5] == ids[4] and len(kept[5]) == len(kept[4])
    run = pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in run.collect()) == sorted(ids[5])
    assert run.columns == mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string, size long")).columns
    assert pipeline.ORACLE_SQL is None


def test_nulls_and_columns_that_clash(spark, folder):
    """A null in each column, a very long text, and columns named like what the stages add: all stay as they are."""
    known = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 160 AND doc_id % 8 <> 1 AND doc_id <> 30")
    base = known.filter("doc_id = 2").first()["text"]
    long = " ".join(known.orderBy("doc_id").limit(40).toPandas()["text"]) * 20
    other = known.filter("doc_id = 4").first()["text"]
    more = [(None, base + " Once more it was told so by others.", "en", "s1", 1), (900, other + " A word of the river and a stone of the house.", None, None, None), (901, long, "en", "s2", 3), (None, None, None, None, None)]
    rows = known.unionByName(spark.createDataFrame(more, known.schema))
    own = F.xxhash64("text")
    names = ("lang_score", "lang_pred", "score", "stats", "n_words", "hit_spans", "item_ids", "component", "component_id", "row", "node", "size")
    docs = rows.select("*", *(own.alias(n) for n in names))
    for name, stage in pipeline.STAGES[:4]:
        docs = pipeline.materialize(stage(spark, docs, folder), f"clash-{name}")
        assert docs.columns == [*COLUMNS, *names]
        assert docs.filter(~(F.expr(" AND ".join(f"{n} = xxhash64(text)" for n in names)))).count() == 0
    got = docs.collect()
    assert {901} <= {r["doc_id"] for r in got} and all(r["text"] for r in got)
    assert pipeline.mix(spark, docs, folder).count() == len(got)


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_leave_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 10")
    assert pipeline.drop_near_duplicates(spark, docs.unionAll(docs), folder).count() == docs.count()


def test_rows_without_doc_id_and_repeated_doc_ids(spark, folder):
    text = lambda name, *more: " ".join([*(f"{name}{k}" for k in range(40)), *more])
    rows = [
        (None, text("a")), (None, text("b")), (None, text("b", "end")), (None, text("b", "stop")), (None, text("c")), (7, text("c", "end")),
        (3, text("d")), (5, text("d", "end")), (5, text("e")), (6, text("f")), (6, text("f", "end")), (None, text("g")), (None, text("g")), (None, None), (8, ""),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.drop_near_duplicates(spark, docs, folder)
    assert got.columns == COLUMNS
    kept = [(r["doc_id"], (r["text"] or "")[:1]) for r in got.collect()]
    assert sorted(kept, key=repr) == sorted([(None, "a"), (None, "b"), (7, "c"), (3, "d"), (5, "e"), (6, "f"), (None, "g"), (None, ""), (8, "")], key=repr)
