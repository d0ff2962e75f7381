"""Token counts through a digest cache.

The cache is a Parquet table (digest, tokenizer, n_tokens). A run digests the normalised content of
every text (null counts as the empty text; the content is otherwise taken as it is, for any other
normalisation would change the library's counts), joins digests and tokenizer version to the stored
counts, encodes each distinct miss once, appends it to the cache and joins the counts back. Two texts
with one SHA-256 digest are one content. Empty tables give an empty result; repeated rows each get
their row, and rows of one id with different texts their own counts; very long texts are encoded whole, by one
call each; there are no ties; ids may be of any type; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from ._common import scratch_path, texts

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"
MODEL = "piece_bpe_32k.model"


def tokenizer_version(model: str = MODEL) -> str:
    with open(public_tokenizers.path(model), "rb") as f:
        return f"{model}:{hashlib.sha256(f.read()).hexdigest()[:16]}"


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        for b in texts(batches, 64):
            counts = [len(ids) for ids in sp.encode(b.column("content").to_pylist(), num_threads=1)] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, cache: str, text_col: str = "text", id_col: str = "doc_id", model: str = MODEL) -> DataFrame:
    """Per row of ``docs``: id, n_bytes (UTF-8), n_tokens. ``cache`` is the path of the cache table;
    it is created where it is missing and misses are appended to it."""
    spark, version = docs.sparkSession, tokenizer_version(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    # one content per digest: copies meet in the map-side aggregate before the exchange
    misses = rows.groupBy("digest").agg(F.first("content").alias("content")).join(stored.select("digest"), "digest", "left_anti")
    new = misses.mapInArrow(_encode(model), "digest binary, n_tokens bigint")
    new.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    # an interrupted append may have stored a digest twice, with the same count
    known = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    measured = rows.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    return measured.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")


def op2(spark, sf_dir: str, cache: str | None = None) -> DataFrame:
    """``cache``: a table that outlives the run, whose counts are then reused; without it the run has one of its own and counts every text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = token_counts(docs, cache or scratch_path(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
