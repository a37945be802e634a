"""A training-data pipeline over `documents`: each stage's rows are written as Parquet and read again as the next one's docs.

Language ID drops documents whose language can't be told; MinHash near-dedup keeps one document of each group; substring
dedup removes passages of 50 words or more that a document of smaller id has; the secret scan replaces secrets by a mark;
packing cuts what is left into sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.language import sample, predict, train
from tensorloom.llm.near_dup import IDS_BROADCAST, near_duplicates
from tensorloom.llm.packing import pack
from tensorloom.llm.queries import tokenizer_path
from tensorloom.llm.repeats import find_repeats, numbered, without_repeats
from tensorloom.llm.secret_scan import redacted
from tensorloom.llm.store import written
from tensorloom.llm.substring_dedup import cover_candidates
from tensorloom.tables import drop_between, made

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or without a letter go. lang is filled in where it is null.

    With no labelled text nothing can be told: documents with a letter stay, their lang as it is.
    """
    model = train(sample(docs))
    if not model:
        return docs.select(COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    told = predict(docs.select(COLUMNS), model, carry=("text", "lang", "source", "n_chars"))
    return told.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group; equal rows of it are one."""
    kept = written(near_duplicates(docs).where("kept").select("doc_id"), "kept")
    once = kept.distinct()
    ids = F.broadcast(once) if kept.count() <= IDS_BROADCAST else once  # few ids go to the texts, not the texts to them
    out = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select(COLUMNS)
    return out.dropDuplicates(["doc_id", "text"]) if kept.groupBy("doc_id").count().where("doc_id is not null and count > 1").count() else out


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that documents of smaller id have; a document with nothing left goes."""
    candidates, reach = cover_candidates()
    rows = numbered(docs, carry=("lang", "source", "n_chars"))
    left = without_repeats(rows, find_repeats(rows, candidates, reach), respaced=False).where("n_words = 0 or n_removed < n_words")
    n_chars = F.expr("if(n_removed > 0, length(kept), n_chars)").cast(docs.schema["n_chars"].dataType)
    return left.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    return redacted(docs.select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of at most 1024 tokens."""
    return pack(docs, tokenizer_path(), with_ids=False)


#: The last stage may return other columns than those of documents.
STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", secret_scan), ("packing", packing)]
#: BPE, MinHash and language models have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        first = made()
        out = written(stage(spark, docs, sf_dir), name)
        drop_between(spark, max(0, first - (name != STAGES[0][0])), made() - 1)  # what the stage made on the way, and its input where that was the last stage's
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
