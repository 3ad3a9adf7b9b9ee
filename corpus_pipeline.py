"""A training-data pipeline over `documents`: reject, take out repeated lines, keep one of each group, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of `documents`, with `n_chars` brought up to date where a stage changes texts.

Defined cases: null, empty and wordless texts fail the quality rules; very long texts pass through whole; of rows that
are equal in id and text one stays after the join; a null language or source is one of its own; further columns, whatever
their names, pass through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm import byte_bpe, line_dedup, mixing, quality_rules, shingle_join
from fieldtrace.llm.common import Saved, new_dir, remove_dir, table
from fieldtrace.llm.queries import MAX_REPEATS, MIN_WORDS

#: The rules and their result in SQL: binomial bounds, prefix doubling and BPE merges have no SQL form.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoffs accept."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang")
    # Written once, with the counts: they are read for the cutoffs, and again with the texts for the verdicts.
    scored = Saved(quality_rules.features(whole).drop("text"), "quality-scored").df
    cutoffs = Saved(quality_rules.calibrate(scored.drop("row"), table(spark, sf_dir, "labels")), "quality-cutoffs").df
    return quality_rules.judge(scored, cutoffs).filter("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs."""
    done = line_dedup.dedup(docs, MIN_WORDS)
    changed = F.col(done.columns[-2]) > 0  # lines removed
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return shingle_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more often, as its source's weight asks for."""
    return mixing.mix(docs, max_repeats=MAX_REPEATS).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of the ids and of the bytes that they decode to."""
    coded = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.drop("text")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written as Parquet in the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = new_dir(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_dir(spark, before)
        before = path
    return docs
