"""A training corpus from raw documents: quality rules, toxicity, near-duplicates, repeated lines, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is
written as Parquet and read again. All but the last return the columns of ``documents``; the last one row per
piece of a sequence. Documents of which nothing is left after the fourth stage go. Null and empty texts fail the quality
rules; rows of one id are told apart by their texts (of equal ones a single row stays); ties go to the smaller id, then
the earlier row; very long texts are taken whole; an empty table gives an empty result; extra columns go along, whatever
their names. No SQL expresses the trained
and the tokenizing stages, so ORACLE_SQL is None and the tests compare with brute force.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import jaccard, linededup, packing, quality, toxicity
from newsloom.llm._common import drop, materialize, scratch_scope

_LAST = threading.local()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000  # texts that go to a Python worker at a time: a batch stands in the executor and the worker at once


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the row goes along whole, so that its columns stay as they are but for text and n_chars
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input_row"))
    out = linededup.line_dedup(rows, runs=True, min_words=linededup.PASSAGE_WORDS, passages=True).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    old = F.col("input_row")
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(old["n_chars"]).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": length}
    return out.select(*[new.get(c, old[c]).alias(c) for c in docs.columns])


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a worker has the memory of four stages behind it: a smaller cache than that of the operator alone
    return packing.pack_documents(docs, cached=60_000)


def _stage(name: str, function: Callable) -> tuple[str, Callable]:
    """A stage that deletes what the stages before it left in the scratch folder: their results are written when it begins."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, *getattr(_LAST, "paths", ()))
        with scratch_scope() as _LAST.paths:
            return function(spark, docs, sf_dir)

    return name, run


STAGES = [
    _stage("quality_rules", quality_rules),
    _stage("toxicity", toxicity_filter),
    _stage("ngram_jaccard", near_duplicates),
    _stage("line_dedup", repeated_lines),
    _stage("best_fit_packing", best_fit),
]

ORACLE_SQL = None


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH_ROWS`` rows inside the block, fewer where the session says so."""
    before = spark.conf.get(_BATCH)
    if int(before) <= 0 or int(before) > BATCH_ROWS:  # 0 and less: no bound
        spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with _small_batches(spark):
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
            drop(spark, before)
            before = docs
    return docs
