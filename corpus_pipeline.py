"""The corpus pipeline: five stages from the documents table to packed sequences, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquill.llm import langid, linededup, mixing, packing, simhash
from cellquill.llm.common import WORD, table, written

#: A document is rejected if no language makes up this share of it.
LEAST_SHARE = 0.4
#: A document is rejected if random trigrams explain it better than the learned languages do, by this log likelihood ratio and by
#: so much of it for each byte: names and keys stay below that rate, an unlearned script or random letters don't.
RANDOM_LLR, RANDOM_RATE = 30.0, 1.0
#: From this share on, in texts of at least so many bytes, the predicted language replaces the given one.
SURE_SHARE, SURE_BYTES = 0.9, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled rows; drops what has no letters, is like no language or has no main one; corrects languages and fills in missing ones."""
    model = langid.train(docs, F.lit(False))
    found = langid.identify(docs, model)
    pred, score, fit = found.columns[-3:]
    size = F.octet_length("text")
    found = found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SHARE) & (F.col(fit) >= -F.greatest(F.lit(RANDOM_LLR), RANDOM_RATE * size)))
    lang = F.when((F.col(score) >= SURE_SHARE) & (size >= SURE_BYTES), F.col(pred)).otherwise(F.coalesce("lang", pred))
    return found.withColumn("lang", lang).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; a document goes if that leaves it without a word."""
    cleaned = linededup.dedup_lines(docs)
    removed = F.col(cleaned.columns[-1])
    cleaned = cleaned.where((removed == 0) | (F.regexp_count("text", F.lit(WORD)) > 0))
    return cleaned.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it."""
    return mixing.emitted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL can't express the stages: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
