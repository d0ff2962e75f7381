"""Removal of repeated substrings by a common-prefix-aware distributed merge sort of suffixes.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else goes. Texts that are equal as a
whole meet by digest first, and one of each goes on. Of the others, not all suffixes are sorted but those at
anchors: the least hashed 32-byte gram of each window of ``length`` bytes, so equal strings hold
equal anchors at equal places. Anchors whose gram occurs once cannot lie in a repeat and are dropped.

Each task sorts the suffixes (of ``length`` bytes) at its anchors into runs and sends them front-coded: for each
suffix the length it shares with the one before, and the rest. A receiving task merges its runs with a
loser tree that knows of every competitor how far it agrees with the last winner: of two competitors the one that
agrees longer is the smaller, and only where both agree equally far are bytes compared, from there
on. The merge yields neighbours with their common prefixes, so suffixes that share a gram form consecutive groups;
with what stands left of the anchors the group's repeated strings are settled, pair by pair in small
groups, by digests of the strings in large ones. Grams more frequent than ``group_bound`` are not
gathered: the digests of their strings are grouped by Spark.

Null is the empty text; texts under ``length`` bytes lose nothing; an empty table gives an empty result. Very long texts are
taken whole, by one task each. Rows are told apart by id and text: repeated rows of one id and one text count as copies,
rows of one id with different texts are documents of their own, and null ids are allowed. Ties do not matter, for every
occurrence is removed. The id column holds whole numbers, or texts of such;
other ids are an error. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import drop, materialize
from .jaccard import mix
from .pretokens import slices

GRAM = 32
PAIRWISE = 48  # groups up to this size compare their pairs
GROUP_BOUND = 100_000
BUCKET_ROWS = 50_000  # about so many suffixes meet in a merge, at every size of input
RUN_ROWS = 100_000  # suffixes that a task holds before it sends its runs
CHUNK = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15


def rolling(b: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all ``width``-byte strings along the last axis, by doubling."""
    h, have, power = b.astype(np.uint64) + np.uint64(1), 1, _BASE
    done, done_width = None, 0
    while True:
        if width & have:  # append this power of two to what is done
            if done is None:
                done = h
            else:
                n = done.shape[-1] - have
                done = done[..., :n] * np.uint64(power) + h[..., done_width : done_width + n]
            done_width += have
        if done_width == width:
            return mix(done)
        n = h.shape[-1] - have
        h = h[..., :n] * np.uint64(power) + h[..., have : have + n]
        have, power = 2 * have, power * power % (1 << 64)


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash, position) of the rightmost least gram in each window of ``length`` bytes."""
    window = length - GRAM + 1
    grams, places = [], []
    for a in range(0, max(1, len(raw) - length + 1), CHUNK):
        b = np.frombuffer(raw[a : a + CHUNK + length - 1], np.uint8)
        if len(b) < length:
            break
        h = rolling(b, GRAM)
        low = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        have = 1
        while 2 * have <= window:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < window:
            low = np.minimum(low[: len(low) - (window - have)], low[window - have :])
        at = (_PLACE - (low & _PLACE)).astype(np.int64)
        at = at[np.flatnonzero(np.diff(at, prepend=-1))]
        at = np.unique(at)
        grams.append(h[at].view(np.int64))
        places.append(at + a)
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(grams)[first], place


def _describe(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for b, held in slices(batch, "text"):
                sizes, grams, places = [], [], []
                for text, d in zip(held, b.column("digest").to_pylist(), strict=True):
                    raw = text.encode()
                    # of equal texts in a task the first one's anchors are enough
                    g, p = (None, None) if d in seen else anchors(raw, length)
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(d)
                    sizes.append(len(raw))
                    grams.append(g)
                    places.append(p)
                made = [pa.array(sizes, pa.int64()), pa.array(grams, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), b.column("digest"), *made], ["row", "key", "digest", "n_bytes", "grams", "places"])

    return run


RUN = "bucket int, lcp binary, tail binary, size binary, left binary, left_size binary, doc binary, place binary, own_doc binary, own_start binary, own_end binary"


def shared(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, known to agree up to ``start``."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[bytes, bytes]:
    """(common prefix of each sorted suffix with the one before, the rests one after the other)."""
    lcp, tails, before = [], [], b""
    for s in suffixes:
        k = 0 if not before else len(s) if s == before else shared(before, s, 0)
        lcp.append(k)
        tails.append(s[k:])
        before = s
    return np.array(lcp, "<u2").tobytes(), b"".join(tails)


def _runs(length: int, buckets: int):
    """Sorted front-coded runs of the suffixes at a task's anchors, one for each bucket."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        rows_held, last = 0, None

        def flush(k: int) -> pa.RecordBatch:
            rows, own, before = [], [], None
            for r in sorted(held[k]):
                if before is not None and r[:2] == before[:2]:
                    # all around both anchors is equal: their repeats are known here, and one goes on
                    low, high = max(0, length - len(r[0])), len(r[1])
                    if low <= high:
                        own += [(x[2], x[3] - high, x[3] - low + length) for x in ((r,) if before is not rows[-1] else (before, r))]
                else:
                    rows.append(r)
                before = r
            lcp, tail = front_coded([r[0] for r in rows])
            left = [r[1] for r in rows]
            cols = [lcp, tail, np.array([len(r[0]) for r in rows], "<u2").tobytes(), b"".join(left), np.array([len(x) for x in left], "<u2").tobytes()]
            cols += [np.array([r[i] for r in rows], "<i8").tobytes() for i in (2, 3)] + [np.array([o[i] for o in own], "<i8").tobytes() for i in (0, 1, 2)]
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], [c.split()[0] for c in RUN.split(", ")])

        for batch in batches:
            for b, texts in slices(batch, "text", most_rows=64):
                for doc, text, grams, places in zip(b.column("row").to_pylist(), texts, b.column("grams").to_pylist(), b.column("places").to_pylist(), strict=True):
                    if doc == last:  # a repeated row
                        continue
                    raw, last = text.encode(), doc
                    for g, p in zip(grams, places, strict=True):
                        held.setdefault((g >> 20) % buckets, []).append((raw[p : p + length], raw[max(0, p - reach) : p], doc, p))
                    rows_held += len(grams)
                    if rows_held >= RUN_ROWS:
                        yield from map(flush, sorted(held))
                        held, rows_held = {}, 0
        yield from map(flush, sorted(held))

    return run


class _Run:
    """Reads a front-coded run from its start; ``head`` is the current suffix, ``agrees`` its common prefix with the one before."""

    def __init__(self, row: dict):
        self.lcp = np.frombuffer(row["lcp"], "<u2").tolist()
        self.size = np.frombuffer(row["size"], "<u2").tolist()
        self.tail, self.at, self.i, self.head, self.agrees = row["tail"], 0, -1, b"", 0
        self.step()

    def step(self) -> bool:
        self.i += 1
        if self.i >= len(self.lcp):
            self.head = None
            return False
        k = self.lcp[self.i]
        end = self.at + self.size[self.i] - k
        self.head = self.head[:k] + self.tail[self.at : end]
        self.agrees, self.at = k, end
        return True


def merge(runs: list[_Run]) -> Iterator[tuple[int, int, int]]:
    """Loser-tree merge of runs: (run, index in it, common prefix with the suffix before) in sorted order."""
    n = 1 << max(0, (len(runs) - 1).bit_length())
    lcp = [r.agrees for r in runs] + [0] * (n - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known agreement becomes that with the winner."""
        x = runs[a].head if a < len(runs) else None
        y = runs[b].head if b < len(runs) else None
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        k = shared(x, y, lcp[a])
        if x[k : k + 1] <= y[k : k + 1]:
            lcp[b] = k
            return a, b
        lcp[a] = k
        return b, a

    losers, winners = [0] * n, [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while best < len(runs) and runs[best].head is not None:
        run = runs[best]
        yield best, run.i, lcp[best]
        run.step()
        lcp[best] = run.agrees
        node = (best + n) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def _settle(context: np.ndarray, left: np.ndarray, right: np.ndarray, lcps: list[int], length: int) -> np.ndarray:
    """(row, x) mask: the string of ``length`` bytes that starts x bytes before the row's anchor occurs
    at another row too. ``context`` has the bytes around the anchors, ``left``/``right`` how many are real."""
    reach = length - GRAM
    c = len(context)
    x = np.arange(reach + 1)
    real = (x[None, :] <= left[:, None]) & (length - x[None, :] <= right[:, None])
    out = np.zeros((c, reach + 1), bool)
    if c <= PAIRWISE:
        before = context[:, :reach][:, ::-1]
        for i in range(c - 1):
            r = np.minimum.accumulate(lcps[i + 1 :])  # of sorted suffixes the least prefix between
            same = before[i + 1 :] == before[i]
            l = np.where(same.all(1), reach, same.argmin(1))
            l = np.minimum(l, np.minimum(left[i], left[i + 1 :]))
            hit = (x[None, :] <= l[:, None]) & (length - x[None, :] <= r[:, None])
            out[i] |= hit.any(0)
            out[i + 1 :] |= hit
        return out & real
    for a in range(0, reach + 1, 16):  # sixteen starts at a time bound the memory
        part = context[:, max(0, reach - a - 15) : reach - a + length]
        h = rolling(part, length)[:, ::-1]
        for k in range(h.shape[1]):
            rows = np.flatnonzero(real[:, a + k])
            _, inverse, times = np.unique(h[rows, k], return_inverse=True, return_counts=True)
            out[rows, a + k] = times[inverse] > 1
    return out


def _merged(length: int):
    reach = length - GRAM

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.to_dict("records")
        runs = [_Run(r) for r in rows]
        lefts = []
        for r in rows:
            ends = np.cumsum(np.frombuffer(r["left_size"], "<u2").astype(np.int64))
            lefts.append((np.concatenate([[0], ends]).tolist(), r["left"], np.frombuffer(r["doc"], "<i8"), np.frombuffer(r["place"], "<i8")))
        found = [tuple(np.frombuffer(r[c], "<i8") for c in ("own_doc", "own_start", "own_end")) for r in rows]
        group: list[tuple[bytes, bytes, int, int]] = []
        lcps: list[int] = []

        def close() -> None:
            if len(group) < 2:
                return
            buf = bytearray(len(group) * (reach + length))
            for i, (suffix, left, _, _) in enumerate(group):
                at = i * (reach + length) + reach
                buf[at - len(left) : at] = left
                buf[at : at + len(suffix)] = suffix
            context = np.frombuffer(buf, np.uint8).reshape(len(group), -1)
            left, right = (np.fromiter((len(g[k]) for g in group), np.int64, len(group)) for k in (1, 0))
            mask = _settle(context, left, right, lcps, length)
            edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            i, first = np.nonzero(edge == 1)
            _, last = np.nonzero(edge == -1)
            place = np.fromiter((g[3] for g in group), np.int64, len(group))[i]
            found.append((np.fromiter((g[2] for g in group), np.int64, len(group))[i], place - last + 1, place - first + length))

        heads = [r.head for r in runs]
        for k, i, lcp in merge_heads(runs, heads):
            if lcp < GRAM:
                close()
                group.clear()
                lcps.clear()
            ends, blob, doc, place = lefts[k]
            group.append((heads[k], blob[ends[i] : ends[i + 1]], int(doc[i]), int(place[i])))
            lcps.append(lcp)
        close()
        doc, start, end = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"row": doc, "start": start, "end": end})

    return run


def merge_heads(runs: list[_Run], heads: list) -> Iterator[tuple[int, int, int]]:
    """``merge`` that keeps each run's current suffix in ``heads`` while it is read."""
    for k, i, lcp in merge(runs):
        heads[k] = runs[k].head
        yield k, i, lcp


def _windows(length: int):
    """Digests of all strings around the anchors of very frequent grams."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for b, texts in slices(batch, "text", most_rows=16, most_chars=200_000):
                out: list[tuple] = []
                for doc, text, places in zip(b.column("row").to_pylist(), texts, b.column("places").to_pylist(), strict=True):
                    if doc == last:  # a repeated row
                        continue
                    raw, last = text.encode(), doc
                    spans: dict[bytes, list] = {}
                    for s in sorted({s for p in places for s in range(max(0, p - reach), min(p, len(raw) - length) + 1)}):
                        # equal strings of one text meet here; their spans run together where they overlap
                        seen = spans.setdefault(hashlib.blake2b(raw[s : s + length], digest_size=16).digest(), [0])
                        seen[0] += 1
                        if len(seen) > 1 and s <= seen[-1]["end"]:
                            seen[-1]["end"] = s + length
                        else:
                            seen.append({"start": s, "end": s + length})
                    out += [(doc, d, seen[0], seen[1:]) for d, seen in spans.items()]
                kinds = [("row", pa.int64()), ("digest", pa.binary()), ("times", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b, texts in slices(batch, "text"):
            kept, spans, sizes = [], [], []
            for text, gone in zip(texts, b.column("gone").to_pylist(), strict=True):
                raw, out, at, merged = text.encode(), [], 0, []
                for g in sorted((g["start"], g["end"]) for g in gone or ()):
                    if merged and g[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], g[1])
                    else:
                        merged.append([g[0], g[1]])
                for s, e in merged:
                    out.append(raw[at:s])
                    at = e
                out.append(raw[at:])
                kept.append(b"".join(out))
                sizes.append(len(raw))
                spans.append([{"start": s, "end": e} for s, e in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "n_bytes", "kept", "removed"])


def suffix_dedup(docs: DataFrame, length: int = 200, text_col: str = "text", id_col: str = "doc_id", group_bound: int = GROUP_BOUND) -> DataFrame:
    """Per row: doc_id, n_bytes, kept (the bytes that stay), removed (start and end of the byte runs that go)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a row is known by its key, the digest of id and text
    digest = F.md5("text")
    source = source.withColumn("key", F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest))))
    told = source.withColumn("digest", F.unhex(digest)).withColumn("row", F.monotonically_increasing_id())
    described = materialize(told.mapInArrow(_describe(length), "row bigint, key binary, digest binary, n_bytes bigint, grams array<bigint>, places array<bigint>"), "anchors")
    # a text goes by the least row that has it
    classes = described.groupBy("digest").agg(
        F.min(F.struct("row", "key")).alias("first"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("grams", ignorenulls=True).alias("grams"), F.first("places", ignorenulls=True).alias("places")
    )
    classes = materialize(classes.select("digest", "first.row", "first.key", "copies", "n_bytes", "grams", "places"), "texts")
    copied = described.select("key", "digest", "n_bytes").join(classes.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("digest"), "digest")
    copied = materialize(copied.select("key", "n_bytes").distinct(), "copied")
    drop(spark, described)
    at = classes.select("row", F.explode(F.arrays_zip("grams", "places")).alias("a")).select("row", F.col("a.grams").alias("gram"), F.col("a.places").alias("place"))
    # stored, so that the join has two plain inputs and a very frequent gram's rows are dealt to several tasks
    often = materialize(at.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "frequent")
    kept = at.join(often, "gram").groupBy("row").agg(
        F.collect_list(F.when(F.col("n") <= group_bound, F.struct("gram", "place"))).alias("near"), F.collect_list(F.when(F.col("n") > group_bound, F.col("place"))).alias("hot")
    )
    wanted = materialize(kept.join(classes.select("row", "key"), "row"), "repeated-anchors")
    with_text = source.select("key", "text").join(wanted, "key")
    anchors_left, hot = wanted.agg(F.coalesce(F.sum(F.size("near")), F.lit(0)), F.coalesce(F.sum(F.size("hot")), F.lit(0))).first()
    buckets = max(1, -(-anchors_left // BUCKET_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), anchors_left // 2000))
    runs = with_text.where(F.size("near") > 0).select("row", "text", F.col("near.gram").alias("grams"), F.col("near.place").alias("places")).mapInArrow(_runs(length, buckets), RUN)
    found = runs.groupBy("bucket").applyInPandas(_merged(length), "row bigint, start bigint, end bigint")
    if hot:
        strings = materialize(with_text.where(F.size("hot") > 0).select("row", "text", F.col("hot").alias("places")).mapInArrow(_windows(length), "row bigint, digest binary, times bigint, spans array<struct<start:bigint,end:bigint>>"), "hot-strings")
        twice = materialize(strings.groupBy("digest").agg(F.sum("times").alias("n")).where("n > 1").select("digest"), "hot-repeats")
        found = found.unionByName(strings.join(twice, "digest").select("row", F.inline("spans")))
    # copies of a whole text lose all of it, if it is long enough; of the others each stands on one row
    spans = found.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("gone")).join(classes.where("copies = 1").select("row", "key"), "row").select("key", "gone")
    whole = copied.select("key", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end"))).alias("gone"))
    gone = materialize(spans.unionByName(whole), "repeats")
    drop(spark, classes, often, wanted, copied)
    return source.join(gone, "key", "left").select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id bigint, n_bytes bigint, kept binary, removed array<struct<start:bigint,end:bigint>>")


def op6(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = F.octet_length("kept").cast("long")
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - size).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
