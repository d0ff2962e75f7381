"""Byte-level BPE by a segment tree over byte positions.

Every leaf of the tree is a byte position and holds the rank of the pair that starts there (none if
the position was merged away or has no rankable neighbour), packed with the position so that the
root is the leftmost minimum. A merge changes three leaves: the merged pair, its dead right half and
the left neighbour; each is a point update up the tree. Many short pieces are merged side by side, one row of
a matrix per piece; a very long piece has a tree of its own. Decoding joins the byte strings of ids.

Texts: null is the empty text; ids of a text are those of its pattern matches in order; very long texts are taken whole; pairs
of one rank merge from the left; repeated rows each get their row, and rows of one id with different texts their own ids; empty tables
give an empty result; extra columns are ignored. The id column holds whole numbers, or texts of such; other ids are an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pretokens import IdCache, slices, splitter

NONE = np.int64(1) << 60
POS_BITS = 32
RANKS = "byte_bpe_50k.tiktoken"


def load_ranks(name: str = RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTreeBpe:
    """``encode(pieces)``: for each str the ids as little-endian uint32 bytes; ``decode(ids)``: bytes."""

    def __init__(self, ranks: dict[bytes, int], cells: int = 1 << 19, wide: int = 4096):
        self.ranks, self.cells, self.wide = ranks, cells, wide
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        # all pairs of tokens that join to a token: (left id, right id) -> rank of the whole
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.vals = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.vals[at] << POS_BITS | pos, NONE)

    def _batch(self, raw: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` (a power of two) bytes, merged side by side."""
        n = len(raw)
        rows = np.arange(n)
        ids = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
        sizes = np.fromiter(map(len, raw), np.int64, n)
        flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        here = np.arange(width)[None, :] < sizes[:, None]
        ids[:, :width][here] = flat
        nxt = np.minimum(np.arange(width + 1)[None, :] + 1, width).repeat(n, 0)
        nxt[rows, sizes - 1] = width
        prv = np.arange(-1, width)[None, :].repeat(n, 0)
        prv[:, 0] = width
        tree = np.full((n, 2 * width), NONE, np.int64)
        pos = np.arange(width)[None, :].repeat(n, 0)
        tree[:, width:] = self._rank(ids[:, :width], np.take_along_axis(ids, nxt[:, :width], 1), pos)
        tree[:, width:][~here] = NONE
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        act = rows[tree[:, 1] < NONE]
        while len(act):
            root = tree[act, 1]
            at = root & ((1 << POS_BITS) - 1)
            dead = nxt[act, at]
            ids[act, at] = root >> POS_BITS
            ids[act, dead] = -1
            after = nxt[act, dead]
            nxt[act, at] = after
            prv[act, after] = at
            before = prv[act, at]
            has = before < width
            self._update(tree, act, at, self._rank(ids[act, at], ids[act, after], at), width)
            self._update(tree, act, dead, NONE, width)
            left, to = act[has], before[has]
            self._update(tree, left, to, self._rank(ids[left, to], ids[left, at[has]], to), width)
            act = act[tree[act, 1] < NONE]
        ids = ids[:, :width]
        keep = ids >= 0
        joined = ids[keep].astype("<u4").tobytes()
        ends = np.cumsum(keep.sum(1)) * 4
        return [joined[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _update(tree, rows, leaf, value, width) -> None:
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def _long(self, raw: bytes) -> bytes:
        """One long piece: the same tree as plain lists, O(n log n)."""
        n = len(raw)
        width = 1 << (n - 1).bit_length()
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        none, pairs = int(NONE), self.pairs

        def value(p: int) -> int:
            q = nxt[p]
            rank = pairs.get(ids[p] << 32 | ids[q]) if q < n else None
            return none if rank is None else rank << POS_BITS | p

        tree = [none] * (2 * width)
        tree[width : width + n] = [value(p) for p in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(p: int, v: int) -> None:
            k = p + width
            tree[k] = v
            while k > 1:
                k >>= 1
                best = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == best:
                    return
                tree[k] = best

        while (root := tree[1]) < none:
            p = root & ((1 << POS_BITS) - 1)
            q = nxt[p]
            ids[p], ids[q], nxt[p] = root >> POS_BITS, -1, nxt[q]
            if nxt[p] < n:
                prv[nxt[p]] = p
            put(q, none)
            put(p, value(p))
            if prv[p] >= 0:
                put(prv[p], value(prv[p]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        by_width: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            if not r:
                continue
            if (whole := self.ranks.get(r)) is not None:  # the library takes a piece that is a token as it is
                out[i] = whole.to_bytes(4, "little")
            elif len(r) > self.wide:
                out[i] = self._long(r)
            else:
                by_width.setdefault(max(2, 1 << (len(r) - 1).bit_length()), []).append(i)
        for width, of in by_width.items():
            step = max(1, self.cells // width)
            for k in range(0, len(of), step):
                part = of[k : k + step]
                for i, ids in zip(part, self._batch([raw[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _run(name: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, split = SegmentTreeBpe(load_ranks(name)), splitter()
        cache = IdCache(bpe.encode)
        for b, held in (x for batch in batches for x in slices(batch, "text")):
            n, sha, back, kept = [], [], [], []
            for ids in cache.ids([split(text) for text in held]):
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def bpe_encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ranks: str = RANKS, with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of the ids and of the bytes decoded from them, and the ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_run(ranks, with_ids), schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
