"""The corpus pipeline: each stage is one of the training-data operators and works on what the stage before kept.

Edge cases, for every stage: a null text is scored, deduplicated and packed as an empty one; a null id is a value like
another, last in order; repeated rows are one document from near dedup on; an empty table stays empty; further columns are
kept, whatever their names, by all stages but the last. The classifier needs labels of both classes: with those of one all
documents score as that class (all stay, or none does), and without labels every score is 0.5, below the threshold, so none stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubeloom.llm.common import materialize
from cubeloom.llm.line_dedup import without_repeats
from cubeloom.llm.mixing import sample_mix
from cubeloom.llm.packing import pack, pieces
from cubeloom.llm.quality import keep_good
from cubeloom.llm.queries import WORD_TOKENIZER
from cubeloom.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents of which nothing is left."""
    return without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; links are SimHash candidates whose sets of five-word shingles are 0.8 alike or more."""
    return keep_one(docs, shingle=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return sample_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequence and place in it."""
    return pack(pieces(docs, WORD_TOKENIZER))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier and the tokenizer have no SQL form; a test holds each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
