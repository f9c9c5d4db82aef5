"""Corpus pipeline: toxicity, language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return
the columns of documents. ``run`` writes each stage's rows as parquet in the shared folder and
rereads them for the next. Rows with a null doc_id can't be named by a decision about copies and
stay; of a repeated doc_id all rows stay if one of them is kept. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.llm import exact, langid, packing, toxicity
from seatwise.llm.jaccard import jaccard_groups
from seatwise.llm.memory import small_batches
from seatwise.session import drop_scratch, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_IDS = 2_000_000


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, of a few numbers each, broadcast if they are few; beyond that a shuffle join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` without the ids none of whose rows in (doc_id, kept) is kept."""
    gone, _ = materialise(decided.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id"), "dropped")
    return docs.select(*COLUMNS).join(_small(gone), "doc_id", "left_anti").select(*COLUMNS)


KEY = ("key_id", "key_text")


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and a row key of two numbers, never null: a verdict on a text holds for its id and its text."""
    return docs.select(*COLUMNS, F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("key_id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("key_text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't call toxic."""
    rows = _keyed(docs)
    net = toxicity.share(spark, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    with small_batches(spark):
        gone, _ = materialise(toxicity.score(rows, net, KEY).where("predicted = 1").select(*KEY).distinct(), "toxic")
    net.destroy()
    return rows.join(_small(gone), list(KEY), "left_anti").select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a null ``lang`` is filled in."""
    rows = _keyed(docs)
    model = langid.share(spark, langid.train(docs))
    told = langid.identify(rows, model, (*KEY, "lang")).where("lang_pred = 'und' or lang is null")
    with small_batches(spark):
        told, _ = materialise(told.select(*KEY, "lang_pred").distinct(), "languages")
    model.destroy()
    named = rows.join(_small(told), list(KEY), "left").where("lang_pred is null or lang_pred <> 'und'")
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return _keep(docs, exact.dedup_append(docs, exact.fresh_index(spark)).select("doc_id", "kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles: five words, similarity of 0.8."""
    groups = jaccard_groups(docs, width=5, percent=80)
    return _keep(docs, groups.select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("language", drop_unknown_language), ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if last:
            drop_scratch(spark, last)
        last = path
    return docs


#: Training, tokenising and packing have no SQL form.
ORACLE_SQL = None
