"""A corpus pipeline: toxicity filter, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents`` with the rows that the stage keeps, whole and unchanged.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagplace.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from tagplace.llm.common import Scratch, read, removed, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the stage that ran last.
_SCRATCH = Scratch()


def staged(f: Stage) -> Stage:
    """``f``, which first deletes the intermediate tables of the stage before: its result is written by then.

    Tables that ``docs`` still reads (a stage's result that was not written) are kept.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _SCRATCH.clear(docs)
        with _SCRATCH:
            return f(spark, docs, sf_dir)

    return run


@staged
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not call toxic (score below 0.3)."""
    labelled = toxicity.sampled(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, toxicity.fit(labelled), 0.3)
    return scored.where("predicted = 0").select(*docs.columns)


@staged
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts (the largest doc_id)."""
    return exact_dedup.mark_duplicates(docs).where("kept").select(*docs.columns)


@staged
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8; the smallest doc_id)."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


@staged
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*docs.columns)


@staged
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: SQL can't express the classifier, MinHash or the tokenizer: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        docs, last = written(made, name), before
        before = docs
        if last is not None:
            removed(last)
