"""A corpus from raw documents to token files, in five stages over the columns of ``documents``.

Each stage takes what its predecessor kept, read back from Parquet. Rows without a doc_id can't be named in
a decision, so filtering stages let them pass; null texts and repeated rows are judged as the stage's operator
defines. Columns beyond those of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm import decontam, langid, minhash, mixing, token_files
from docquill.llm.common import checked_broadcast, remove, saved, shared_dir

ORACLE_SQL = None  # tokenizers and trained models are beyond SQL; tests compare with brute force


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the ids (distinct, one column doc_id); few ids go to every task, more are shuffled."""
    ids = checked_broadcast(saved(ids, f"{shared_dir(docs.sparkSession)}-ids"))
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language stays unclear."""
    found = langid.identify(docs)
    return _without(docs, found.groupBy("doc_id").agg(F.max("accepted").alias("any")).where("doc_id is not null and not any").select("doc_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Rows that share an id and a text are one document, of which one row stays (the first by its JSON text);
    different texts under one id stay, or go, together.
    """
    found = minhash.near_duplicates(docs)
    kept = _without(docs, found.where("not kept").select("doc_id").distinct())
    again = saved(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), f"{shared_dir(spark)}-again")
    if again.isEmpty():
        return kept
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; a null text has none and stays.

    An item of fewer words than a window is a window itself, so one word makes all documents with it go.
    """
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("n_hit > 0 and doc_id is not null").select("doc_id").distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares by source, language and topic meet the targets; null values form a group each."""
    found = mixing.mix(docs)
    return _without(docs, found.groupBy("doc_id").agg(F.max("kept").alias("any")).where("doc_id is not null and not any").select("doc_id"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files; one row per document, read back from them. A null text is empty."""
    folder = shared_dir(spark)
    token_files.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote goes when the next one has written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        folder = shared_dir(spark)
        docs = saved(stage(spark, docs, sf_dir), folder)
        if last:
            remove(spark, last)
        last = folder
    return docs
