"""From raw documents to token ids: quality rules, near-dedup, substring dedup, mixing, BPE.

Each stage works on all that the one before kept, and all but the last return the columns of documents. An empty table
stays empty. A null text is an empty one: the quality rules reject it, as they do all texts of less than 20 words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.llm import bpe, minhash_dedup, mixing, quality_rules, substring_dedup
from chunklake.llm.common import forget, keep, read, scratch
from chunklake.llm.registry import tokenizer_path

#: Five-word shingles, similarity of 0.8 or more; 42 bands of 6 slots miss 3 in a million pairs at the threshold.
NEAR = minhash_dedup.Setting(shingle=5, percent=80, bands=42)
#: Target shares by domain. Documents labelled good, and unlabelled ones that aren't clearly of another domain, have a rate of 1 at least, so that each of them stays.
WEIGHTS, GROWTH = {"good": 0.985, "poor": 0.005, "toxic": 0.01}, 1.15


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; a null or empty text is rejected. Each row is judged by itself, so repeated rows all stay or all go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id. Of rows equal in id and text the first by the other columns stays; rows with a null id and texts without words stay."""
    return minhash_dedup.representatives(docs, NEAR)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go; n_chars follows the text. Texts that lose nothing stay byte by byte; rows stay, even if nothing of their text does; rows with a null id are left alone and remove nothing."""
    return substring_dedup.remove(docs, length="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or dropped by their rate, so that tokens of good, poor and toxic text come near WEIGHTS. Rows equal in id and text are repeated alike. Without labels all rows have the rate GROWTH."""
    return mixing.resample(docs, read(spark, sf_dir, "labels"), WEIGHTS, GROWTH, spared="good")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every row; a null text has no ids."""
    return bpe.encode(docs, tokenizer_path("byte_bpe_50k.json")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("substring dedup", substring), ("mixing", mix), ("bpe", tokens)]

#: The mixing stage fits rates step by step, which SQL doesn't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as spared:  # what a stage keeps on its way goes with its end
            before, docs = docs, keep(stage(spark, docs, sf_dir), f"pipeline-{i}")
            spared.append(docs)
        if i:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
