"""The corpus pipeline: quality rules, MinHash near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each one's rows as Parquet in
the shared folder and reads them again. All but the last return the columns of ``documents``; substring dedup
shortens texts and brings ``n_chars`` up to date. The last returns a row for each packed piece.

Defined cases: a null or empty text is rejected by the quality rules; a null lang is a stratum of its own, and a null in any other column is passed on; rows that
share a doc_id are documents of their own, and rows equal in doc_id and text stay or go together; of near copies the smallest doc_id stays, and a null one
is never smaller than another; a very long text is one row's memory in one task; an empty table gives an empty one; columns beyond those of ``documents``
are passed on by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import neardup, quality, substring, tokens
from quillspark.llm.common import read, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs reject go."""
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id. The stage links at 0.8 (op5's query at 0.85),
    where 16 x 16 tables miss a pair with a chance of 2.1e-5."""
    return neardup.dedup(docs, percent=80, tables=16)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that a document with a smaller doc_id has too are taken out."""
    return substring.dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what is left in sequences of at most 2048."""
    return tokens.pack(docs, capacity=2048, end_id=0)


STAGES = [("quality_rules", quality_rules), ("minhash_neardup", minhash_neardup), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]

#: SQL can express none of the stages whole (certified cutoffs, hash sketches, a tokenizer); tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
