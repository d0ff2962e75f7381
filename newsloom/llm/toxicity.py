"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text (letters only), hashed; a document is its set of terms. The machine has a
weight and a vector for every hashed term; the products of vectors score pairs of terms, so that a pair can count for
more or less than its members, as an insult with the mention of a group does. Counts over all labelled learning rows
say how telling a term is (chi-square against the label); a term's value in a document is chi / (chi + ``TRUST``), so that terms
of chance move slowly and none is left out. The machine is fitted on a sample of at most ``SAMPLE`` labelled rows per
label (the least hashes of id and text, the documented bound of this classifier), weighted to the true proportion of labels;
errors on label 1, the rarer one, count ``POSITIVE`` times.

Null and empty texts have no terms and get the machine's bias. Very long texts are taken whole. Rows without a label do not
teach; without any positive or negative row, as in an empty table, every score is 0. Repeated rows count as often as they occur, but stand in the
sample once; rows of one id with different texts are rows of their own that share the id's label, and an id with
both labels teaches both. Ties go to the smaller hash, then the smaller id. The id column holds whole numbers, or texts of such;
other ids are an error. Columns named score or predicted are replaced, others pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ._common import crc_mod, materialize
from .pretokens import slices

BITS = 18
TRUST = 45.0
SAMPLE = 10_000
RANK = 4
VISITS = 160_000  # rows that training looks at, repeats counted; each row 6 to 30 times
POSITIVE = 8.0
BATCH = 256
THRESHOLD = 0.7
KEEP_BELOW = 0.4  # of the filter: the least cut in steps of 0.05 with a precision of 0.99 on three folds of the learning rows of sf0.1, as TRUST and POSITIVE were chosen
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


class TermHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word) >> (32 - BITS)
        return value


def terms(text: str, hashes: TermHashes) -> np.ndarray:
    words = text.lower().encode().translate(_LETTERS).split()
    return np.unique(np.fromiter(map(hashes.__getitem__, words), np.int32, len(words)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = TermHashes()
    for batch in batches:
        for b, held in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([terms(t, hashes) for t in held], pa.list_(pa.int32()))], ["doc_id", "th", "terms"])


def extract(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.withColumn("th", F.xxhash64("text")).mapInArrow(_extract, "doc_id bigint, th bigint, terms array<int>")


class Model:
    """Bias, and weight and vector of every hashed term; terms that no sampled row has weigh nothing."""

    def __init__(self, bias: float, terms: np.ndarray | None = None, weights: np.ndarray | None = None, vectors: np.ndarray | None = None):
        self.bias = bias
        self.weights = np.zeros(1 << BITS, np.float32)
        self.vectors = np.zeros((1 << BITS, RANK if vectors is None else vectors.shape[1]), np.float32)
        if terms is not None:
            self.weights[terms], self.vectors[terms] = weights, vectors

    def margin(self, t: np.ndarray) -> float:
        v = self.vectors[t]
        s = v.sum(0)
        return self.bias + float(self.weights[t].sum()) + 0.5 * float((s * s).sum() - (v * v).sum())


def _train(value: np.ndarray, share: dict[int, float], rank: int):
    """value: of each hashed term in a document; share: weight of a sampled row of each label."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "th", "toxic"], kind="stable")
        rng = np.random.default_rng(7)
        y = rows["toxic"].to_numpy(np.float64)
        weight = np.array([share[int(v)] for v in y])
        sizes = np.fromiter(map(len, rows["terms"]), np.int64, len(y))
        used, flat = np.unique(np.concatenate(list(rows["terms"])), return_inverse=True)
        starts, worth = np.concatenate([[0], np.cumsum(sizes)]), value[used].astype(np.float64)
        rate = float((y * weight).sum() / weight.sum())
        bias = float(np.log(rate / (1 - rate)))
        cost = weight * np.where(y == 1, POSITIVE, 1.0)
        w, v = np.zeros(len(used)), rng.normal(0, 0.01, (len(used), rank))
        gw, gv, gb = np.full(w.shape, 1e-3), np.full(v.shape, 1e-3), 1e-3
        step, shrink = 0.2, 2e-5
        for _ in range(min(30, max(6, VISITS // len(y)))):
            order = rng.permutation(len(y))
            for a in range(0, len(y), BATCH):
                picked = order[a : a + BATCH]
                at = np.concatenate([flat[starts[r] : starts[r + 1]] for r in picked])
                row = np.repeat(np.arange(len(picked)), sizes[picked])
                here, place = np.unique(at, return_inverse=True)
                x = worth[at]
                vx = v[at] * x[:, None]
                s = np.zeros((len(picked), rank))
                for f in range(rank):
                    s[:, f] = np.bincount(row, vx[:, f], len(picked))
                margin = bias + np.bincount(row, w[at] * x, len(picked)) + 0.5 * ((s * s).sum(1) - np.bincount(row, (vx * vx).sum(1), len(picked)))
                off = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[picked]) * cost[picked] / len(picked)
                pull = off[row] * x
                dw = np.bincount(place, pull, len(here)) + shrink * w[here]
                dv = shrink * v[here]
                for f in range(rank):
                    dv[:, f] += np.bincount(place, pull * (s[row, f] - vx[:, f]), len(here))
                db = float(off.sum())
                gw[here] += dw * dw
                gv[here] += dv * dv
                gb += db * db
                w[here] -= step * dw / np.sqrt(gw[here])
                v[here] -= step * dv / np.sqrt(gv[here])
                bias -= step * db / np.sqrt(gb)
        made = {"terms": used.astype("<i4"), "weights": (w * worth).astype("<f4"), "vectors": (v * worth[:, None]).astype("<f4")}
        return pd.DataFrame({"bias": [float(bias)], **{k: [x.tobytes()] for k, x in made.items()}})

    return run


def _sample_ids(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """(doc_id, th, toxic) of the ``SAMPLE`` distinct rows of each label with the least hashes; ``n``: distinct rows of each label. Only hashes
    below about twice the share wanted reach the window, so the rows of its tasks do not grow with the table."""
    below = lambda k: F.lit(min(-(2**63) + 2**64 * 2 * SAMPLE // n[k], 2**63 - 1)).cast("long")
    near = rows.select("doc_id", "th", "toxic", F.xxhash64("doc_id", "th").alias("h")).where(F.col("h") <= F.when(F.col("toxic") == 1, below(1)).otherwise(below(0)))
    turn = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id", "th"))
    return near.distinct().withColumn("turn", turn).where(F.col("turn") <= SAMPLE).select("doc_id", "th", "toxic")


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", rank: int = RANK) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` (id, 0/1 label) covers; ``rank`` 0 is the additive linear model."""
    told = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    rows = materialize(extract(docs, text_col, id_col).join(told, "doc_id"), "toxic-terms")
    n = dict(rows.groupBy("toxic").count().collect())
    if not n.get(0) or not n.get(1):
        return Model(-30.0)
    total, share = n[0] + n[1], n[1] / (n[0] + n[1])
    # at most 2^BITS rows
    seen = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("pos")).toPandas()
    df, off = seen["df"].to_numpy(np.float64), seen["pos"].to_numpy(np.float64) - seen["df"].to_numpy(np.float64) * share
    chi = off * off / (df * share * (1 - share) * (1 - df / (total + 1)))
    value = np.zeros(1 << BITS, np.float32)
    value[seen["term"].to_numpy(np.int64)] = chi / (chi + TRUST)
    distinct = dict(rows.select("doc_id", "th", "toxic").distinct().groupBy("toxic").count().collect())
    # at most 2 * SAMPLE rows
    ids = materialize(_sample_ids(rows, distinct), "toxic-sample")
    sample = rows.join(F.broadcast(ids), ["doc_id", "th", "toxic"], "left_semi").dropDuplicates(["doc_id", "th", "toxic"])
    weight = {k: n[k] / min(distinct[k], SAMPLE) for k in (0, 1)}
    mean = total / sum(min(distinct[k], SAMPLE) for k in (0, 1))
    train = _train(value, {k: w / mean for k, w in weight.items()}, rank)
    got = sample.withColumn("fit", F.lit(0)).groupBy("fit").applyInPandas(train, "bias double, terms binary, weights binary, vectors binary").first()
    used = np.frombuffer(got["terms"], "<i4")
    return Model(got["bias"], used, np.frombuffer(got["weights"], "<f4"), np.frombuffer(got["vectors"], "<f4").reshape(len(used), rank))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score in 0..1 and predicted (1 if score >= THRESHOLD) in place of columns of these names."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        hashes = TermHashes()
        margin = np.array([model.margin(terms(t or "", hashes)) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    out = docs.withColumn("score", scored(F.col(text_col).cast("string")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", below: float = KEEP_BELOW) -> DataFrame:
    """The rows of ``docs`` that score below ``below`` by a model learned from those of its rows that ``labels`` covers."""
    scored = score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input_row"), F.col(text_col).alias("t")), fit(docs, labels, text_col, id_col), "t")
    return scored.where(F.col("score") < below).select("input_row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod("doc_id", 3) == 1
    model = fit(docs.where(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
