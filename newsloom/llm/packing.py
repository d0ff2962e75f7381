"""Hierarchical residual best-fit packing of tokenized documents into fixed-length sequences.

Every document is its token ids and an end id. A document longer than a sequence is cut into full
pieces with the shorter piece first; full pieces are sequences of their own, so only one residual
item per document is packed. Each partition packs its items by best fit (longest first) and emits the
nearly full bins; the underfull bins, with their contents, go up a merge tree as items of their own and
are packed again in groups of ``fan_in`` tasks, round after round, until one group is left, a round saves
next to nothing or a group would outgrow its bound. Bins travel as (id, length); where an item ends up is found by joining
the rounds' (child, parent, offset) tables, so no task holds more than its own items.

Null text is the empty text (one piece with the end id alone). A very long text is encoded whole, by one task, and cut into
pieces. Every input row is packed, repeated ids too; ties go by the row's number, so a plan is the same when a task runs
again. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import materialize
from .pretokens import slices, splitter

TOKENIZER = "byte_bpe_50k.json"
SEQ_LEN = 2048
END_ID = 0
# A round emits bins with at most this many free places; fuller bins cannot gain from the merge tree.
SLACK = 16
CACHED = 150_000  # pieces of a generation in a worker's cache
FAN_IN = 8
SUB_BITS = 8  # groups of one partition
ID_BITS = 29  # bins of a group (24), then the round (5)


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable ones themselves, the others from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class _Ids(dict):
    """Piece -> its ids as little-endian unsigned 32-bit bytes. Holds at most ``most`` pieces and as many of the generation before:
    a full generation becomes the one before, and pieces that come up again move on. That never changes results."""

    def __init__(self, lib, special: set[str], most: int):
        super().__init__()
        self.lib, self.model, self.special, self.most, self.letters = lib, lib.model, special, most, _byte_letters()
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[piece] = found = self.before.pop(piece, None) or self._encode(piece)
        return found

    def _encode(self, piece: str) -> bytes:
        if piece in self.special:
            return _little(self.lib.encode(piece, add_special_tokens=False).ids)
        # the library's merges alone: a piece needs no more splitting
        return _little([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])


class _Tokenizer:
    """Ids of whole texts by the tokenizers library, asked for each distinct piece between special strings."""

    def __init__(self, name: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = {t.content for t in lib.get_added_tokens_decoder().values()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.split = splitter()
        self.cache = _Ids(lib, self.special, cached)

    def _pieces(self, text: str) -> list[str]:
        # the library cuts special strings out of a text before all else
        return [x for p in self.cut(text) for x in ([p] if p in self.special else self.split(p))]

    def ids(self, held: list[str]) -> list[bytes]:
        """Ids of each text; equal texts are encoded once."""
        found = {t: b"".join(map(self.cache.__getitem__, self._pieces(t))) for t in dict.fromkeys(held)}
        return [found[t] for t in held]


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=1)
def _tokenizer(name: str, cached: int) -> _Tokenizer:
    """One for a Python worker: what a task has encoded, the worker's later tasks find in the bounded cache."""
    return _Tokenizer(name, cached)


def _tokenize(name: str, seq_len: int, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(name, cached)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for b, held in slices(batch, "text"):
                at, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(tok.ids(held)):
                    total = len(ids) // 4 + 1
                    cuts = [0, *range(total % seq_len or min(seq_len, total), total, seq_len), total]
                    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        at.append(row)
                        piece.append(k)
                        start.append(a)
                        length.append(z - a)
                        own = zlib.crc32(ids[4 * a : 4 * z])
                        crc.append(zlib.crc32(end, own) if z == total else own)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item, filled length of each bin); longest first, ties in
    the given order. Free places are at most ``size``, so the tightest open bin is the lowest set bit of a mask."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    into, offset, free = [0] * len(sizes), [0] * len(sizes), []
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for i in order:
        need = sizes[i]
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, b = size, len(free)
            free.append(size)
        into[i], offset[i] = b, size - room
        free[b] = room - need
        if free[b]:
            open_bins[free[b]].append(b)
            mask |= 1 << free[b]
    return np.array(into, np.int64), np.array(offset, np.int64), size - np.array(free, np.int64)


def _pack(frame: pd.DataFrame, task: int, turn: int, size: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "item"], ascending=[False, True], kind="stable")
    into, offset, filled = best_fit(frame["length"].to_numpy(), size)
    return pd.DataFrame({"item": frame["item"].to_numpy(), "bin": (into << 5) + (task << ID_BITS) + turn, "offset": offset, "filled": filled[into]})


PACKED = "item bigint, bin bigint, offset bigint, filled bigint"


def pack(items: DataFrame, size: int = SEQ_LEN, slack: int = SLACK, fan_in: int = FAN_IN, group_items: int = 250_000) -> DataFrame:
    """``items``: (item bigint, unique; length bigint, 1..size). Returns (item, bin, offset)."""

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = []
        task, sub = TaskContext.get().partitionId(), 0
        rows = 0
        for f in frames:
            held.append(f)
            rows += len(f)
            if rows >= group_items:  # a longer partition is several local groups
                yield _pack(pd.concat(held), task << SUB_BITS | sub, 0, size)
                held, rows, sub = [], 0, sub + 1
        if rows:
            yield _pack(pd.concat(held), task << SUB_BITS | sub, 0, size)

    def merge(turn: int):
        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return _pack(frame, int(key[0]), turn, size)

        return run

    rounds = [materialize(items.select("item", "length").mapInPandas(local, PACKED), "pack-0")]
    group = F.shiftright("bin", ID_BITS + SUB_BITS)  # of the last round's bins
    while True:
        bins = rounds[-1].where(F.col("filled") < size - slack).select("bin", "filled").distinct()
        left, groups = bins.agg(F.count("*"), F.max(group) + 1).first()
        # merge as many neighbours as keep a group within its bound
        fan = min(fan_in, group_items * (groups or 0) // max(left, 1))
        if left == 0 or fan < 2 or len(rounds) > 1 and (groups == 1 or left > 0.98 * before):
            break
        nxt = bins.select(F.col("bin").alias("item"), F.col("filled").alias("length"), F.floor(group / fan).alias("g"))
        rounds.append(materialize(nxt.groupBy("g").applyInPandas(merge(len(rounds)), PACKED), f"pack-{len(rounds)}"))
        before, group = left, F.shiftright("bin", ID_BITS)
    # compose the rounds from the top: where each bin of a round lies in the end
    top = None
    for made in reversed(rounds[1:]):
        step = made.select(F.col("item").alias("child"), "bin", "offset")
        if top is not None:
            step = _compose(step.withColumnRenamed("child", "item"), top).withColumnRenamed("item", "child")
        top = step
    first = rounds[0].select("item", "bin", "offset")
    return first if top is None else _compose(first, top)


def _compose(low: DataFrame, top: DataFrame) -> DataFrame:
    up = top.select(F.col("child").alias("bin"), F.col("bin").alias("up_bin"), F.col("offset").alias("up_offset"))
    return low.join(up, "bin", "left").select("item", F.coalesce("up_bin", "bin").alias("bin"), (F.col("offset") + F.coalesce("up_offset", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, cached: int = CACHED) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``cached`` trades a worker's memory for its time."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(_tokenize(tokenizer, seq_len, cached), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    pieces = materialize(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == seq_len
    placed = pack(pieces.where(~full), seq_len)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # bins of the packing are even numbers, full pieces odd ones
    packed = pieces.where(~full).join(placed, "item").select(*cols, (F.col("bin") * 2).alias("sequence_id"), "offset")
    alone = pieces.where(full).select(*cols, (F.col("item") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(alone)


def op5(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
