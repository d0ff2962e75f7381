"""Language identification by nearest clustered centroid.

A text is a hashed bag of the byte trigrams of its lower-cased form; counts are damped by log and
weighted by inverse document frequency over all learning rows. Each language's sample of at most
``per_lang`` rows (the least hashes of id and text; the documented bound of this classifier) is clustered by spherical
k-means into several centroids, each with the similarity that its members reach. A text takes the language of
its nearest centroid by cosine; where the cosine is below what that centroid's members reach, it is
rejected.

Text that is null or has no letter is ``und`` with score 0. Rows without lang do not teach. With no teaching rows, as in an
empty table, everything is ``und``. Ties go to the first language by name. Very long texts are counted in chunks, whole. Repeated rows
count as often as they occur in the frequencies, but stand in the sample once; rows of one id with different texts are
rows of their own, and rows without id teach the frequencies only. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import crc_mod, materialize
from .pretokens import slices

BITS = 12
DIMS = 1 << BITS
PER_LANG = 600
CLUSTERS = 4
REJECT_AT = 0.005  # share of a centroid's own members below its rejection bound
MARGIN = 0.8
CHUNK = 1 << 20
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_LETTERS = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTERS.finditer(text))


def counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased text; whatever is no letter in ASCII is one space."""
    raw = b" ".join([b"", *text.lower().encode().translate(_SPACED).split(), b""])
    out = np.zeros(DIMS, np.int64)
    for a in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw[a : a + CHUNK + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
            out += np.bincount(code >> np.uint32(32 - BITS), minlength=DIMS)
    return out


def _unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for _, held in slices(batch, "text"):
            for text in held:
                df += counts(text) > 0
                rows += 1
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[rows], df]))], ["term", "df"])


def _cluster(idf: np.ndarray, clusters: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        x = np.stack([_unit(counts(t), idf) for t in rows["text"]])
        # spread the first centroids out: each next one is the row least similar to those before
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(clusters, len(x)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        c = x[chosen]
        for _ in range(10):
            to = (x @ c.T).argmax(1)
            c = np.stack([x[to == k].sum(0) if (to == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        sims = x @ c.T
        to = sims.argmax(1)
        low = [float(np.quantile(sims[to == k, k], REJECT_AT)) * MARGIN if (to == k).any() else 0.0 for k in range(len(c))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "cluster": range(len(c)), "bound": low, "centroid": [v.astype("<f4").tobytes() for v in c]})

    return run


class Model:
    def __init__(self, idf: np.ndarray, rows: list):
        rows = sorted(rows, key=lambda r: (r["lang"], r["cluster"]))
        self.idf, self.langs = idf, [r["lang"] for r in rows]
        self.bounds = np.array([r["bound"] for r in rows])
        self.centroids = np.stack([np.frombuffer(r["centroid"], "<f4") for r in rows]) if rows else np.zeros((0, DIMS), np.float32)


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", per_lang: int = PER_LANG, clusters: int = CLUSTERS) -> Model:
    """Learn from all rows of ``docs`` with text and lang: frequencies from every row, centroids from the sample."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.where("text is not null and lang is not null")
    df = dict(d.select("text").mapInArrow(_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect())
    n = df.get(-1, 0)
    idf = (np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIMS)]))) + 1).astype(np.float32)
    if not n:
        return Model(idf, [])
    d = d.withColumn("th", F.xxhash64("text"))
    known = materialize(d.where("doc_id is not null").select("doc_id", "th", "lang").distinct(), "lang-rows")
    # of these rows, each met once, only hashes below about twice the share wanted reach the window, so its tasks do not grow with the table
    near = known.withColumn("h", F.xxhash64("doc_id", "th")).join(known.groupBy("lang").agg(F.count("*").alias("rows")), "lang").where(F.col("h") / 2.0**64 + 0.5 <= 2.0 * per_lang / F.col("rows"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "th"))
    ids = near.withColumn("turn", turn).where(F.col("turn") <= per_lang)
    ids = materialize(ids.select("doc_id", "th", "lang"), "lang-sample")
    # the sample is at most per_lang rows a language
    sample = d.join(ids, ["doc_id", "th", "lang"], "left_semi").dropDuplicates(["doc_id", "th", "lang"]).drop("th")
    made = sample.groupBy("lang").applyInPandas(_cluster(idf, clusters), "lang string, cluster int, bound double, centroid binary")
    return Model(idf, made.collect())


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, held in slices(batch, "text", most_rows=256):
                langs, score, rejected = ["und"] * len(held), np.zeros(len(held)), np.ones(len(held), bool)
                real = [i for i, t in enumerate(held) if has_letter(t)]
                if real and model.langs:
                    sims = _unit(np.stack([counts(held[i]) for i in real]), model.idf) @ model.centroids.T
                    best = sims.argmax(1)
                    for i, k, s in zip(real, best.tolist(), sims[np.arange(len(real)), best].tolist(), strict=True):
                        langs[i], score[i], rejected[i] = model.langs[k], min(max(s, 0.0), 1.0), s < model.bounds[k]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, lang_pred (nearest language, or und), score (cosine), rejected."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out: Column = crc_mod("doc_id", 4) == 2
    found = predict(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
