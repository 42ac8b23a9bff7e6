"""The corpus pipeline: quality, language, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Defined cases: null, empty and wordless texts score like the average text and go in the language stage, which finds no
letter in them. Rows that repeat a doc_id are judged each by its own text, but near duplicates and leaks are told by doc_id:
of rows that repeat a kept doc_id all stay, of a leaked one all go. A null doc_id is never a near duplicate or a leak. Of
equal documents the smallest doc_id stays. Columns besides doc_id, text and lang pass through as they are, whatever they are
called. An empty table passes every stage; a table without enough labels or without any lang is an error, as the
classifiers then have nothing to learn from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridan.llm import bpe, decontaminate, langid, ngram_join, quality
from veridan.llm.common import stored

#: Least score of a document that stays. Far below the 0.7 that calls a text good: only texts that are
#: likely bad go, so clean documents stay.
KEEP_QUALITY = 0.3
#: Least confidence for a language; below it, and without a letter, a document goes.
KEEP_LANGUAGE = 0.3


def _guarded(docs: DataFrame) -> DataFrame:
    """doc_id and text under their names, every other column under one that no operator uses."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)])


def _restored(guarded: DataFrame, docs: DataFrame, **instead: str) -> DataFrame:
    """The columns of ``docs`` again; some of them from columns that an operator made."""
    own = _guarded(docs).columns
    return guarded.select(*[F.col(instead.get(c, x)).alias(c) for c, x in zip(docs.columns, own, strict=True)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is at least KEEP_QUALITY."""
    if docs.isEmpty():
        return docs
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(_guarded(docs), model)
    return _restored(scored.where(F.col("score") >= KEEP_QUALITY), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; ``lang`` becomes the predicted language."""
    if docs.isEmpty():
        return docs
    found = langid.identify(_guarded(docs), langid.fit_languages(docs))
    return _restored(found.where((F.col("lang_pred") != "und") & (F.col("score") >= KEEP_LANGUAGE)), docs, lang="lang_pred")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component (five-word shingles, Jaccard 0.8) the document with the smallest doc_id."""
    found = ngram_join.jaccard_components(docs, k=5, num=4, den=5)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that share no passage with the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes; one row a document with its token count and digests."""
    return bpe.token_digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The classifiers and the tokenizer can't be written in SQL; tests hold each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
