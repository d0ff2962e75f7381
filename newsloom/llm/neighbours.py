"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A text has three views, each a TF-IDF vector of length one: its lower-cased words, hashed; the trigrams of its characters' classes
(letters small and large, digits, every sign for itself), hashed; and the tenth of its words that repeat the word before them.
Document frequencies cover all learning rows. A truncated singular value decomposition of a sample of labelled rows, at most ``SAMPLE``
a label (the least hashes of id and text; the documented bound of this classifier), gives the latent space; the sample's vectors are
broadcast, at most 2 * SAMPLE of DIMS numbers. Every document is compared with all of them in blocks of exact cosine products; those
at least as similar as the K-th (ties included) vote with their similarity, weighted to the true proportion of the labels.

A text without terms, as a null or empty one, gets the share of label 1 among the learning rows, and so does a text with no similar neighbour.
Very long texts are counted in pieces, whole. Rows without a label do not teach labels, only frequencies; without any labelled row, as in an empty
table, every score is 0. Repeated rows stand in the sample and in the proportion of labels once, each gets its score; rows of one id with
different texts are rows of their own that share the id's label, and an id with both labels teaches both. Columns named score or predicted are
replaced, others pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ._common import crc_mod, materialize
from .pretokens import slices

WORD_BITS, SHAPE_BITS, TENTHS = 13, 12, 11
WORDS, SHAPES = 1 << WORD_BITS, 1 << SHAPE_BITS
VIEWS = [(0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, WORDS + SHAPES + TENTHS)]
TERMS = VIEWS[-1][1]
SAMPLE = 4_000
DIMS = 32
NEIGHBOURS = 15
THRESHOLD = 0.3
ROWS = 256  # documents of a block
PIECE = 1 << 20


def _class(c: int) -> int:
    if c >= 128 or chr(c).islower():
        return ord("a")
    return ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else ord(" ") if chr(c) in "\t\v\f\r" else c


_CLASSES = bytes(_class(c) for c in range(256))
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


class WordHashes(dict):
    """Word -> its hashed term, of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word) >> (32 - WORD_BITS)
        return value


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE`` characters, cut before a space."""
    start = 0
    while start < len(text):
        end = text.find(" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def counts(text: str, hashes: WordHashes) -> np.ndarray:
    """Counts of all terms of a text; zeros if it has none."""
    out = np.zeros(TERMS, np.int32)
    tail, last, again, n = b"\n", None, 0, 0
    for piece in _pieces(text):
        raw = piece.encode()
        shown = tail + raw.translate(_CLASSES)
        b = np.frombuffer(shown, np.uint8).astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
            out[WORDS : WORDS + SHAPES] += np.bincount(code >> np.uint32(32 - SHAPE_BITS), minlength=SHAPES)
        tail = shown[-2:]
        words = piece.lower().encode().translate(_LETTERS).split()
        at = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
        if len(at):
            out[:WORDS] += np.bincount(at, minlength=WORDS)
            again += int((at[1:] == at[:-1]).sum()) + (last == at[0])
            last, n = at[-1], n + len(at)
    if n:
        out[WORDS + SHAPES + 10 * again // n] = 1
    return out


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows with every view of length one; a view without terms stays zero."""
    x = np.log(tf.astype(np.float32) + 1) * idf
    for a, b in VIEWS:
        x[:, a:b] /= np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-12)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows, hashes = np.zeros(TERMS, np.int64), 0, WordHashes()
    for batch in batches:
        for _, held in slices(batch, "text"):
            for text in held:
                df += counts(text, hashes) > 0
                rows += 1
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate([[rows], df]))], ["term", "df"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for b, held in slices(batch, "text"):
            tf = [counts(t, hashes) for t in held]
            at = [np.flatnonzero(x) for x in tf]
            arrays = [pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([x[a].astype(np.int32) for x, a in zip(tf, at, strict=True)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), b.column("y"), *arrays], ["doc_id", "th", "y", "terms", "tf"])


def _decompose(idf: np.ndarray, dims: int):
    """One task, over the sample: the latent space by a randomised decomposition, and the rows' vectors in it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "th", "y"], kind="stable").reset_index(drop=True)

        def blocks():
            for a in range(0, len(rows), ROWS):
                part = rows.iloc[a : a + ROWS]
                tf = np.zeros((len(part), TERMS), np.int32)
                for k, (terms, n) in enumerate(zip(part["terms"], part["tf"], strict=True)):
                    tf[k, terms] = n
                yield weighted(tf, idf)

        basis = np.random.default_rng(7).normal(size=(TERMS, dims + 8)).astype(np.float32)
        for _ in range(3):
            basis = np.linalg.qr(sum(x.T @ (x @ basis) for x in blocks()))[0].astype(np.float32)
        small = np.concatenate([x @ basis for x in blocks()])
        turned = np.linalg.svd(small, full_matrices=False)[2].T[:, :dims]
        space, vectors = basis @ turned, _unit(small @ turned)
        return pd.DataFrame({"space": [space.astype("<f4").tobytes()], "vectors": [vectors.astype("<f4").tobytes()], "y": [rows["y"].to_numpy("<i4").tobytes()]})

    return run


class Model:
    """Weights of terms, the latent space, and the labelled vectors with the weight of each vote."""

    def __init__(self, share: float, idf: np.ndarray | None = None, space: np.ndarray | None = None, vectors: np.ndarray | None = None, y: np.ndarray | None = None, weight: np.ndarray | None = None, neighbours: int = NEIGHBOURS):
        self.share, self.idf, self.space, self.vectors, self.neighbours = share, idf, space, vectors, neighbours
        if vectors is not None:
            self.votes = np.stack([y * weight, weight], 1).astype(np.float64)

    def scores(self, texts: list[str], hashes: WordHashes) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if self.vectors is None:
            return out
        for a in range(0, len(texts), ROWS):
            x = _unit(weighted(np.stack([counts(t, hashes) for t in texts[a : a + ROWS]]), self.idf) @ self.space)
            near = np.maximum(np.round(x @ self.vectors.T, 5), 0)
            n, k = near.shape[1], min(self.neighbours, near.shape[1])
            least = np.partition(near, n - k, axis=1)[:, n - k]
            near[near < least[:, None]] = 0
            yes, all_ = (near @ self.votes).T
            out[a : a + ROWS] = np.where(all_ > 0, yes / np.where(all_ > 0, all_, 1), self.share)
        return np.clip(out, 0.0, 1.0)


def _sample_ids(rows: DataFrame, n: dict[int, int], most: int) -> DataFrame:
    """(doc_id, th, y) of the ``most`` rows of each label with the least hashes; ``n``: the rows of each label. Only hashes below
    about twice the share wanted reach the window, so the rows of its tasks do not grow with the table."""
    below = lambda k: F.lit(min(-(2**63) + 2**64 * 2 * most // n[k], 2**63 - 1)).cast("long")
    cut = F.when(F.col("y") == 1, below(1) if n.get(1) else F.lit(None)).otherwise(below(0) if n.get(0) else F.lit(None))
    turn = F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id", "th"))
    return rows.withColumn("h", F.xxhash64("doc_id", "th")).where(F.col("h") <= cut).withColumn("turn", turn).where(F.col("turn") <= most).select("doc_id", "th", "y")


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, dims: int = DIMS) -> Model:
    """Learn frequencies from all rows of ``docs``, votes from those that ``labels`` (id, 0/1 label) covers."""
    told = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").distinct()
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    known = materialize(d.select("doc_id", "th").distinct().join(told, "doc_id"), "quality-labelled")
    n = dict(known.groupBy("y").count().collect())
    if not n:
        return Model(0.0)
    share = n.get(1, 0) / sum(n.values())
    df = dict(d.select("text").mapInArrow(_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect())  # TERMS + 1 rows
    idf = np.log((1 + df[-1]) / (1 + np.array([df.get(k, 0) for k in range(TERMS)]))).astype(np.float32)
    idf[VIEWS[-1][0] :] = 1
    ids = materialize(_sample_ids(known, n, sample), "quality-sample")
    # at most 2 * sample rows; the text itself is met once per id and text
    texts = d.join(F.broadcast(ids.select("doc_id", "th").distinct()), ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    rows = texts.join(F.broadcast(ids), ["doc_id", "th"]).mapInArrow(_sparse, "doc_id bigint, th bigint, y int, terms array<int>, tf array<int>")
    got = rows.withColumn("fit", F.lit(0)).groupBy("fit").applyInPandas(_decompose(idf, dims), "space binary, vectors binary, y binary").first()
    y = np.frombuffer(got["y"], "<i4")
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([n[int(k)] / taken[int(k)] for k in y])
    wide = lambda name, rows: np.frombuffer(got[name], "<f4").reshape(rows, -1)
    return Model(share, idf, wide("space", TERMS), wide("vectors", len(y)), y, weight)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score in 0..1 and predicted (1 if score >= THRESHOLD) in place of columns of these names."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * SAMPLE vectors and TERMS * DIMS numbers

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series(told.value.scores([t or "" for t in texts], hashes))

    out = docs.withColumn("score", F.pandas_udf(scored, T.DoubleType())(F.col(text_col).cast("string")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``least`` by a model learned from those of its rows that ``labels`` covers."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input_row"), F.col(text_col).alias("t"))
    return score(whole, fit(docs, labels, text_col, id_col), "t").where(F.col("score") >= least).select("input_row.*")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod("doc_id", 5) == 0
    model = fit(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
