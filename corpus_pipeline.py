"""The corpus pipeline: STAGES in order, each over the rows and columns its predecessor kept; `run` applies them to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyframe.llm.copies import keep_one_copy
from skyframe.llm.mixing import in_mixed_order, mix
from skyframe.llm.pieces import encode
from skyframe.llm.pii import mask_pii
from skyframe.llm.toxicity import drop_toxic, fit_chain
from skyframe.session import settle


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, takes for toxic go."""
    return drop_toxic(docs, fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard similarity of 0.8 or more) the document with the smallest id stays.

    They meet by their SimHash fingerprints in BK-trees, and those whose fingerprints differ by more bits also in bands of minima of their shingles'
    hashes; links are confirmed on whole shingle sets (`copies`).
    """
    return keep_one_copy(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the mix of their sources; `pieces` adds the positions."""
    return in_mixed_order(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their place in the mix (mix_position) and their sampled pieces."""
    placed = settle(mix(docs).drop("mix_block", "mix_slot"))  # so that the tasks that encode hold no sorted rows beside their pieces
    return encode(placed, keep=True)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("personal data", personal_data), ("mixing", mixing), ("pieces", pieces)]

# Fitted models, fingerprints' components and sampled pieces are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
