"""Exact top-k inner-product search by MaxScore over shards.

A vector is a document of signed impacts: term t is dimension t, its posting list in a shard is the row of the
term-major matrix. What a set of terms can add to a score is bounded twice: by the sum of their largest contributions
in the shard, and by the norm of the query's part times the norm of the candidate's part. Terms in ascending
order of weight are non-essential while their bound stays below the query's k-th score so far. Only the essential
postings are traversed; the best partial scores are completed to raise the k-th score; then the candidates whose partial score plus
bound still competes are probed, a few non-essential terms at a time with the largest weight first, and
dropped as soon as they cannot compete. One shard is searched first and hands its k-th scores to all others; a
window merges the shards' own top k.

Scores are integer inner products. A vector that is null or holds a null or non-finite component takes no part,
neither as query nor as candidate; missing dimensions of a shorter vector count as 0, so a vector without components scores 0.
Ties go to the smaller id; a query never returns its own id; fewer candidates than k give fewer rows, an empty table none.
Rows with a repeated id are candidates of their own; repeated query rows of one id are one query where their vectors agree
and else queries of their own, each with its ranks. Extra columns are ignored. Integer components must be below 2^31.
Every pair of query and candidate is decided, so the work grows as queries times candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import materialize

SHARD_ROWS = 8192
QUERY_ROWS = 4096
SEED_ROWS = 512
PROBED = 8  # non-essential terms that are probed together
HITS = "query_id bigint, query_key bigint, vec_id bigint, score bigint"
_NONE = np.iinfo(np.int64).min // 4


def quantized(vec: Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component as long; null if the vector takes no part."""
    good = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return F.when(good, F.transform(vec, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long")))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Shard:
    """Candidates (rows of ``c``, in ascending id order) as posting lists, with what bounds their scores."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, most: float):
        """``most``: the largest absolute component of the queries."""
        n, dims = c.shape
        # sums of integers are exact in floating point below 2^24 and 2^53; beyond, the same sums run on integers
        size = max(most, 1.0) * float(np.abs(c).max(initial=0)) * max(dims, 1)
        kind = np.float32 if size < 2.0**23 else np.float64 if size < 2.0**52 else np.int64
        self.ids, self.rows, self.n = ids, c, n
        self.postings = np.ascontiguousarray(c.T).astype(kind)
        self.squares = np.ascontiguousarray(c.T).astype(np.float64 if kind is np.int64 else kind) ** 2
        self.energy = self.squares.sum(0, dtype=np.float64)
        self.top, self.low = c.max(0).astype(np.float64), c.min(0).astype(np.float64)
        self.seen = self.competing = 0

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.rows[at] @ q

    def top_k(self, q: np.ndarray, own: int, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, score) of the candidates that can be among the query's top k, best first, at most k; ``floor``: a k-th score known before."""
        a, z = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")
        if floor == _NONE and self.n > k:
            first = np.concatenate([np.arange(0, min(a, SEED_ROWS)), np.arange(z, min(self.n, z + max(0, SEED_ROWS - a)))])
            floor = self._kth(self.exact(q, first), k, floor)
        weight = q.astype(np.float64)
        best = np.maximum(weight * self.top, weight * self.low)
        order = np.argsort(np.maximum(best, -np.minimum(weight * self.top, weight * self.low)), kind="stable")
        # the bound of the first i terms of the order, for every i
        norm = np.sqrt(np.cumsum(weight[order] ** 2)) * np.sqrt(self.energy.max(initial=0.0))
        rest = int((np.minimum(np.cumsum(best[order]), norm) * (1 + 1e-6) + 1 < floor).sum()) if floor > 0 else 0
        essential, others = order[rest:], order[:rest][::-1]
        part = q[essential].astype(self.postings.dtype) @ self.postings[essential]
        at = np.concatenate([np.arange(a), np.arange(z, self.n)])
        part = part[at]
        self.seen += len(at)
        if rest:
            if len(at) > 4 * k:
                likely = at[np.argpartition(part, len(part) - 4 * k)[-4 * k :]]
                floor = max(floor, self._kth(self.exact(q, likely), k, floor))
            left = self.energy[at] - self.squares[essential].sum(0, dtype=np.float64)[at]
            for i in range(0, rest + 1, PROBED):
                open_ = others[i:]
                bound = np.minimum(best[open_].sum(), np.sqrt((weight[open_] ** 2).sum()) * np.sqrt(np.maximum(left, 0))) * (1 + 1e-6) + 1
                live = np.flatnonzero(part + bound >= floor)
                at, part, left = at[live], part[live], left[live]
                if not i:
                    self.competing += len(at)
                terms = others[i : i + PROBED]
                if len(terms):
                    near = np.ix_(terms, at)
                    part = part + q[terms].astype(part.dtype) @ self.postings[near]
                    left = left - self.squares[near].sum(0, dtype=np.float64)
        else:
            self.competing += len(at)
        score = part.astype(np.int64)
        if len(at) > k:
            live = np.flatnonzero(score >= max(floor, self._kth(score, k, floor)))
            at, score = at[live], score[live]
        by = np.lexsort((at, -score))[:k]
        return at[by], score[by]

    @staticmethod
    def _kth(scores: np.ndarray, k: int, floor: int) -> int:
        return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else floor


def top_k(queries: DataFrame, candidates: DataFrame, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``queries``: (query_id bigint, vec array<bigint>); ``candidates``: (vec_id bigint, vec array<bigint>).
    Returns query_id, rank, vec_id, score. Shards and query blocks hold about the given numbers of rows,
    so a task's memory does not grow with the tables."""
    candidates = candidates.where("vec is not null").select("vec_id", "vec")
    queries = queries.where("vec is not null").select("query_id", F.col("vec").alias("terms")).distinct().withColumn("query_key", F.xxhash64("query_id", "terms"))
    n_shards = -(-candidates.count() // shard_rows) or 1
    n_blocks = -(-queries.count() // query_rows) or 1
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = candidates.withColumn("shard", slot("vec_id", n_shards))
    asked = queries.withColumn("block", slot("query_key", n_blocks))

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}, dtype="int64")
        c = c.sort_values("vec_id", kind="stable")
        dims = max(max(map(len, c["vec"])), max(map(len, q["terms"])))
        asked, ids = _matrix(q["terms"], dims), c["vec_id"].to_numpy()
        shard = Shard(ids, _matrix(c["vec"], dims), float(np.abs(asked).max(initial=0)))
        found = [shard.top_k(v, own, floor, k) for v, own, floor in zip(asked, q["query_id"].tolist(), q["floor"].tolist(), strict=True)]
        times = [len(at) for at, _ in found]
        at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), times), "query_key": np.repeat(q["query_key"].to_numpy(), times), "vec_id": ids[at], "score": score})

    def searched(shards: DataFrame, with_floor: DataFrame, numbers: Column) -> DataFrame:
        left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        right = with_floor.withColumn("shard", F.explode(numbers))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, HITS)

    hits = searched(dealt.where("shard = 0"), asked.withColumn("floor", F.lit(_NONE)), F.array(F.lit(0)))
    if n_shards > 1:
        hits = materialize(hits, "first-shard")
        floors = hits.groupBy("query_key").agg(F.min("score").alias("least"), F.count("*").alias("c")).where(F.col("c") >= k).select("query_key", F.col("least").alias("floor"))
        known = asked.join(floors, "query_key", "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE)))
        hits = hits.unionByName(searched(dealt.where("shard > 0"), known, F.sequence(F.lit(1), F.lit(n_shards - 1))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantized(F.col("embedding")).alias("vec"))
    queries = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "vec")
    return top_k(queries, rows, 20)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id,
    cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id
  where a.vec_id % 20 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""
