"""The corpus pipeline: quality, near copies, benchmark passages, personal data, tokens.

Each stage works on all rows its predecessor kept; all but the last give back the columns of documents. Null texts
count as empty, but stay null: they are scored by the classifier, are linked with nothing, hit nothing, hold no
personal data and have no tokens. Rows with a null doc_id pass through all stages; rows that repeat whole are one
document to near_duplicates. An empty table stays empty at every stage. Columns beyond those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm import bpe, decontam, neardup, pii, quality
from tamarisk.llm._common import stage, table
from tamarisk.llm.queries import PSEUDONYM_KEY, crc32_mod

#: Documents with a lower probability of good quality go.
LEAST_QUALITY = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects. It learns from the labelled documents outside the held-out quarter."""
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"), crc32_mod("doc_id", 4) != 2)
    return quality.score_texts(docs, model).where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; of rows repeated whole, one."""
    found = stage(neardup.near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "kept")
    repeated = bool(found.groupBy("_id", "_h").count().where("count > 1").take(1))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    kept = docs.join(found, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies inside windows of benchmark items."""
    found = decontam.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where(decontam.contaminated())
    found = stage(found.select(F.col("doc_id").alias("_id"), "_h").distinct(), "contaminated")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_anti")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by pseudonyms of the same format, and so of the same length."""
    return pii.pseudonymise(docs, PSEUDONYM_KEY, spans=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to the text again."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = bpe.encode(docs.select("doc_id", "lang", "source", "text", F.sha2("text", 256).alias("_sha")), path, pattern, data="decoded_bytes")
    n = (F.octet_length("token_ids") / 4).cast("long")
    return back.select("doc_id", "lang", "source", n.alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded_bytes", 256).alias("decoded_sha256"), F.sha2("decoded_bytes", 256).eqNullSafe(F.coalesce("_sha", F.sha2(F.lit(""), 256))).alias("round_trip"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("pseudonyms", pseudonyms), ("tokens", tokens)]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
