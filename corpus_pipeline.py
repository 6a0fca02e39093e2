"""From raw documents to a training mix: STAGES, run() and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has kept, and returns the
columns of ``documents`` for what it keeps itself; the last returns the mix. run() writes each stage's
result as Parquet to the cluster's shared folder and reads it again.

1. language: documents without letters, and those whose language is hardly better than a guess, go.
2. quality: documents that the quality classifier predicts to be of label 0 go.
3. near_duplicates: of each group of near copies (shingles of five words, similarity 0.8) one row stays, that
   with the smallest doc_id. A null doc_id comes after all others: a document without doc_id stays if no
   near copy has one, and of several near copies without doc_id one does. Of rows of one doc_id with other
   texts each group keeps its own; of rows that repeat doc_id and text one stays.
4. decontamination: documents that hold a benchmark window go.
5. mix: every document's place and share in the training mix.

Models are fitted on the stage's own input, texts are read whole, however long they are.

Cases: a null or empty text has no letters and goes in the first stage; rows with a null lang, or without a label,
are judged but not learnt from; a null source is a source of its own in the mix; rows with a null doc_id are judged
like all others and go through all stages; an empty table gives an empty result; further columns stay as they are
up to the mix, also those named like what a stage adds (lang_score, score, n_words, component).

ORACLE_SQL is None: SQL has no support vector machines; the
tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blamegrid.llm import decontaminate, language, minhash, mixing, quality
from blamegrid.llm.common import aside, materialize, table

#: Documents whose language scores less are rejected; a guess between two families of two scores 0.25.
MIN_LANGUAGE_SCORE = 0.3
MIN_QUALITY_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, moved = aside(docs, "lang_pred", "lang_score")
    model = language.fit(language.training_rows(docs))
    named = language.identify(docs, model)
    kept = named.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE))
    return kept.select(docs.columns).withColumnsRenamed(moved)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, moved = aside(docs, "score", "stats")
    measured = materialize(quality.measured(docs), "measured")  # texts are measured once and don't move; statistics alone meet the labels
    model = quality.fit(quality.training_rows(measured.select("doc_id", "stats"), table(spark, sf_dir, "labels")))
    scored = quality.score_measured(measured, model)
    return scored.filter(F.col("score") >= MIN_QUALITY_SCORE).select(docs.columns).withColumnsRenamed(moved)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))


STAGES = [
    ("language", keep_known_language),
    ("quality", keep_good_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
