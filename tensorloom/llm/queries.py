"""Queries of the llm operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import SQL


def tokenizer_path() -> str:
    """The public byte-level BPE file, wherever its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import held_out_scores

    return held_out_scores(_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_duplicates

    return embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op4_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_search import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digests, repeated_passages

    return digests(repeated_passages(_table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(_table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digests, scan

    return digests(scan(_table(spark, sf_dir, "documents")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import digests, substring_dedup

    return digests(substring_dedup(_table(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import digests, encode_decode

    return digests(encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path()))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's columns that SQL can express: all but the model's score."""
    r = op1_lm_score(spark, sf_dir)
    return r.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's columns that SQL can express: all but the spans that guess costs add."""
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


_OWN = (op1_lm_score, op2_embedding_dedup, op3_packing, op4_ball_search, op5_suffix_dedup, op6_language_id, op7_near_dup, op8_secrets, op9_substring_dedup, op10_bpe, lm_base_scores, secret_base_spans)
QUERIES = {f.__name__: f for f in _OWN}
__all__ = ["QUERIES", "SQL", "tokenizer_path"]
