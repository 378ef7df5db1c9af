"""A corpus pipeline of five of the training-data operators.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import jaccard_join, line_dedup, mixing, sentencepiece_scan, toxicity
from lumenfold.llm.queries import read, tokenizer_path
from lumenfold.llm.work import release, scoped, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity model rejects (predicted 1)."""
    scored = toxicity.score_documents(docs, read(spark, sf_dir, "labels"))
    # written while Python workers get small batches
    return table(scored.where("predicted = 0").select(*COLUMNS))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that repeat an earlier line; n_chars follows the text where lines went."""
    deduped = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return deduped.withColumn("n_chars", n_chars).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the least doc_id."""
    return jaccard_join.one_of_each_group(docs, words=5, percent=80).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass that takes them."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids: doc_id, n_tokens, ids_crc32 and whether decoding gives the text again."""
    return sentencepiece_scan.encode_digest(docs, model_path=tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL cannot express learnt scores, the random deal or the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is a table in the shared folder, which goes with all others of its making when the next stage has ended."""
    docs, made = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = scoped(stage)(spark, docs, sf_dir)
        for earlier in made:
            release(earlier)
        made = [docs]
    return docs
