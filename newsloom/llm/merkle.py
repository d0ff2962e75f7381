"""Merkle manifest of a dataset: a tree of digests per source, a tree over the sources, and a proof for every row.

``leaves`` digests each row with built-in functions. Rows get their place within their source from a range partitioning (places are
counted per partition, then shifted), so that no task sees a whole source. ``manifest`` then works in rounds: every aligned block
of fanout^depth nodes of a tree is one contiguous matrix of 64 hex characters a row; the rows of a level are reshaped by the fanout
and hashed, level by level, and the block's last digest is a node of the next round, until every tree has one node.
The way back carries the siblings above a block down to its nodes, found by index arithmetic alone. A block is cut
off a stream sorted by tree and place, so a task holds one block at a time, whatever the size of its source.

Null values are ``-`` in a leaf, and null is a source of its own, before the others. Empty texts have the digest of length 0; very long texts
are digested inside the scan, whole. Rows of one source and id are ordered by their leaves; equal rows are nodes of their own. Rows with
a null id come first in their source and are never tampered with. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import crc_mod, drop, materialize

FANOUT = 3
DEPTH = 6  # levels of a block: 3^6 = 729 nodes, 47 kB of hex
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: of each field ``-`` if null, else its length in bytes, ``:`` and its value."""
    shown = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]).cast("binary"), 256))


def levels(n: int, fanout: int) -> int:
    """Levels until ``n`` nodes are one."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def hexed(digests: list[bytes]) -> np.ndarray:
    """Digests as a matrix of hex characters, a row each."""
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), 32)
    out = np.empty((len(digests), 64), np.uint8)
    out[:, 0::2], out[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return out


def _hash_rows(rows: np.ndarray) -> list[bytes]:
    flat, width = rows.tobytes(), rows.shape[1]
    return [hashlib.sha256(flat[k : k + width]).digest() for k in range(0, len(flat), width)]


def climb(nodes: np.ndarray, rounds: int, fanout: int) -> list[np.ndarray]:
    """The matrices of ``rounds`` levels, the nodes first; the last run of a level may be shorter."""
    found = [nodes]
    for _ in range(rounds):
        full = len(nodes) // fanout
        up = _hash_rows(nodes[: full * fanout].reshape(full, fanout * 64)) if full else []
        if len(nodes) % fanout:
            up.append(hashlib.sha256(nodes[full * fanout :].tobytes()).digest())
        nodes = hexed(up)
        found.append(nodes)
    return found


def siblings(found: list[np.ndarray], at: int, fanout: int) -> bytes:
    """The siblings of node ``at``, level by level, left to right."""
    out = []
    for nodes in found[:-1]:
        a = at - at % fanout
        out += [nodes[a:at].tobytes(), nodes[at + 1 : a + fanout].tobytes()]
        at //= fanout
    return b"".join(out)


def fold(digest: bytes, at: int, n: int, path: bytes, fanout: int) -> bytes:
    """The digest (hex) that node ``at`` of ``n`` leads to with the siblings ``path``."""
    place = 0
    while n > 1:
        left, width = at % fanout, min(fanout, n - (at - at % fanout)) - 1
        mid, end = place + 64 * left, place + 64 * width
        digest = hashlib.sha256(path[place:mid] + digest + path[mid:end]).hexdigest().encode()
        place, at, n = end, at // fanout, -(-n // fanout)
    if place != len(path):
        raise ValueError("path of another tree")
    return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, list], list[tuple[int, int]]]]:
    """From batches sorted by (tree, block): the columns of whole blocks, and where each block begins and ends."""
    held: dict[str, list] = {}
    for batch in batches:
        for name in batch.schema.names:
            held.setdefault(name, []).extend(batch.column(name).to_pylist())
        ends = [0]
        tree, block = held["tree"], held["block"]
        for k in range(1, len(block)):
            if block[k] != block[k - 1] or tree[k] != tree[k - 1]:
                ends.append(k)
        if len(ends) > 1:
            yield held, list(zip(ends[:-1], ends[1:], strict=True))
            held = {name: v[ends[-1] :] for name, v in held.items()}
    if held and held["block"]:
        yield held, [(0, len(held["block"]))]


def _sorted_blocks(d: DataFrame) -> DataFrame:
    return d.repartition("tree", "block").sortWithinPartitions(F.col("tree").asc_nulls_first(), "block", "pos")


def _roots(fanout: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, spans in _blocks(batches):
            tops = [climb(hexed(held["digest"][a:b]), min(depth, levels(held["n"][a], fanout)), fanout)[-1].tobytes().decode() for a, b in spans]
            first = [a for a, _ in spans]
            n = [-(-held["n"][a] // fanout**depth) for a in first]
            yield pa.RecordBatch.from_arrays([pa.array([held["tree"][a] for a in first], pa.string()), pa.array([held["block"][a] for a in first], pa.int64()), pa.array(n, pa.int64()), pa.array([bytes.fromhex(t) for t in tops], pa.binary())], ["tree", "pos", "n", "digest"])

    return run


class Round:
    """Nodes (tree, pos, n, digest) as they stood before a round of blocks, and the blocks' digests after it."""

    def __init__(self, nodes: DataFrame, fanout: int, depth: int, label: str):
        self.nodes, self.fanout, self.depth, self.label = nodes, fanout, depth, label
        size = fanout**depth
        up = _sorted_blocks(nodes.select("tree", F.floor(F.col("pos") / size).cast("bigint").alias("block"), "pos", "n", "digest")).mapInArrow(_roots(fanout, depth), "tree string, pos bigint, n bigint, digest binary")
        self.above = materialize(up, f"{label}-nodes")

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, pos, path) of the nodes, from the paths of the blocks: ``above`` (tree, pos, path)."""
        d = stream(self.nodes, above, self.fanout**self.depth)
        return d.mapInArrow(_paths(self.fanout, self.depth), "tree string, pos bigint, path binary")


def stream(nodes: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """Every block's row of ``above`` (tree, pos, path) and then its nodes, in the order of their places."""
    head = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), F.col("path"))
    body = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("bigint"))
    return _sorted_blocks(body.unionByName(head, allowMissingColumns=True))


def _paths(fanout: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, spans in _blocks(batches):
            for a, b in spans:
                rounds = min(depth, levels(held["n"][a + 1], fanout))
                found = climb(hexed(held["digest"][a + 1 : b]), rounds, fanout)
                path = [siblings(found, k, fanout) + held["path"][a] for k in range(b - a - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(held["tree"][a + 1 : b], pa.string()), pa.array(held["pos"][a + 1 : b], pa.int64()), pa.array(path, pa.binary())], ["tree", "pos", "path"])

    return run


def placed(rows: DataFrame, tree: Column, order: list[str], label: str) -> DataFrame:
    """``rows`` with tree, pos (place within the tree by ``order``, from 0) and n (rows of the tree). Rows are dealt by range of
    tree and order and stored; each partition counts its own rows, and the counts of the partitions before shift them."""
    spark = rows.sparkSession
    keys = [F.col("tree").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    # equal rows could not be cut apart by range: a number of their own splits them
    d = rows.withColumn("tree", tree).withColumn("own", F.monotonically_increasing_id())
    d = d.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, F.xxhash64("own")).sortWithinPartitions(*keys, F.xxhash64("own"))
    d = materialize(d.drop("own").withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), label)
    counts = d.groupBy("part", "tree").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    w = Window.partitionBy("tree")  # a tree has a row for every partition that holds some of it
    counts = counts.withColumn("before", F.sum("rows").over(w.orderBy("part")) - F.col("rows") - F.col("first")).withColumn("n", F.sum("rows").over(w))
    moved = counts.select(F.col("part").alias("p"), F.col("tree").alias("t"), "before", "n")
    d = d.join(moved, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")))
    return d.withColumn("pos", F.col("row") + F.col("before")).drop("row", "part", "p", "t", "before")


def _build(nodes: DataFrame, fanout: int, depth: int, label: str) -> tuple[list[Round], DataFrame]:
    """Rounds of blocks until every tree has one node, and those nodes (tree, digest)."""
    rounds = []
    while True:
        rounds.append(Round(nodes, fanout, depth, f"{label}{len(rounds)}"))
        nodes = rounds[-1].above
        if (nodes.agg(F.max("n")).first()[0] or 1) <= 1:
            return rounds, nodes.select("tree", "digest")


def _proofs(fanout: int, depth: int, root: bytes):
    cells = ("tree_n", "source_pos", "sources", "subroot", "tops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended: dict = {}
        for held, spans in _blocks(batches):
            for a, b in spans:
                tree_n, source_pos, sources, subroot, tops = (held[c][a] for c in cells)
                nodes = hexed(held["digest"][a + 1 : b])
                found, inside = climb(nodes, min(depth, levels(tree_n, fanout)), fanout), []
                for k in range(b - a - 1):
                    other, pos = held["other"][a + 1 + k], held["pos"][a + 1 + k]
                    path = siblings(found, k, fanout) + held["path"][a]
                    start = (other.hex() if other is not None else held["digest"][a + 1 + k].hex()).encode()
                    mine = fold(start, pos, tree_n, path, fanout)
                    # what a subroot leads to is the same for all that lead to it
                    top = ended.get((mine, source_pos))
                    if top is None:
                        if len(ended) > 100_000:
                            ended.clear()
                        top = ended[mine, source_pos] = fold(mine, source_pos, sources, tops, fanout)
                    inside.append((hashlib.sha256(path + tops).hexdigest(), top.decode()))
                proof, folded = zip(*inside, strict=True)
                m = len(inside)
                arrays = [pa.array(held["doc_id"][a + 1 : b]), pa.array([d.hex() for d in held["digest"][a + 1 : b]]), pa.array([subroot.hex()] * m), pa.array([root.decode()] * m), pa.array(proof), pa.array(folded), pa.array([f.encode() == root for f in folded])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, source_col: str = "source", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the row as ``tampered`` has it: expressions that stand for
    some of its fields), verified."""
    spark, size = docs.sparkSession, fanout**depth
    values, instead = [F.col(f"`{c}`") for c in fields], tampered or {}
    digest = leaf(values)
    other = leaf([instead.get(c, v) for c, v in zip(fields, values, strict=True)]) if instead else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), digest.alias("digest"), other.alias("other"))
    rows = materialize(rows.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other"))), "merkle-leaves")
    nodes = materialize(placed(rows, F.col("source"), ["doc_id", "digest"], "merkle-sorted").drop("source"), "merkle-placed")
    drop(spark, rows)
    result = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not nodes.limit(1).count():
        return spark.createDataFrame([], result)
    own, subroots = _build(nodes.select("tree", "pos", "n", "digest"), fanout, depth, "merkle-source")
    tops = materialize(placed(subroots.withColumnRenamed("tree", "source"), F.lit("sources"), ["source"], "merkle-subroots"), "merkle-tops")
    over, last = _build(tops.select("tree", "pos", "n", "digest"), fanout, depth, "merkle-top")
    root = last.first()["digest"].hex().encode()  # one row
    # down again: siblings over the sources, then over the blocks of each source
    path = last.select("tree", F.lit(0).cast("bigint").alias("pos"), F.lit(b"").alias("path"))
    for r in reversed(over):
        path = r.paths(path)
    t, p = tops.alias("t"), path.alias("p")
    sources = t.join(p, (F.col("t.pos") == F.col("p.pos"))).select(F.col("t.source").alias("tree"), F.col("t.pos").alias("source_pos"), F.col("t.n").alias("sources"), F.col("t.digest").alias("subroot"), F.col("p.path").alias("tops"))
    sources = materialize(sources, "merkle-sources")
    path = sources.select("tree", F.lit(0).cast("bigint").alias("pos"), F.lit(b"").alias("path"))
    for r in reversed(own[1:]):
        path = r.paths(path)
    # a row for every block of leaves: what is above it
    sizes = own[0].above.select(F.col("tree").alias("bt"), F.col("pos").alias("bp"))
    b, s = sizes.join(path, F.col("bt").eqNullSafe(F.col("tree")) & (F.col("bp") == F.col("pos"))).select(F.col("bt").alias("tree"), F.col("bp").alias("block"), "path").alias("b"), sources.alias("s")
    head = b.join(s, F.col("b.tree").eqNullSafe(F.col("s.tree"))).select("b.tree", "b.block", F.lit(-1).cast("bigint").alias("pos"), "b.path", "s.source_pos", "s.sources", "s.subroot", "s.tops")
    counts = nodes.groupBy("tree").agg(F.first("n").alias("tree_n")).withColumnRenamed("tree", "ct")
    head = head.join(counts, F.col("tree").eqNullSafe(F.col("ct"))).drop("ct")
    body = nodes.drop("n").withColumn("block", F.floor(F.col("pos") / size).cast("bigint"))
    return _sorted_blocks(body.unionByName(head, allowMissingColumns=True)).mapInArrow(_proofs(fanout, depth, root), result)


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    return manifest(docs, {"text": F.when(crc_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})


def manifest_sql(levels: int = 12, source_levels: int = 6) -> str:
    """DuckDB SQL of ``op12`` for at most 3^levels rows a source and 3^source_levels sources, a table for every level."""
    shown = " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in FIELDS)
    other = shown.replace("cast(text as varchar)", "tampered")
    bits = "flatten(list_transform(range(1, length(s) + 1), lambda p: list_transform(range(0, 8), lambda b: (ascii(s[p]) >> b) & 1)))"
    parts = [
        "d as (select *, cast(doc_id as varchar) as s from documents)",
        f"crc as (select *, xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))), 4294967295) as crc from d)",
        "e as (select *, case when crc % 2 = 0 then replace(text, chr(10), '') else text end as tampered from crc)",
        f"rows_ as (select doc_id, source as t, sha256({shown}) as leaf, sha256({other}) as other from e)",
        "f0 as (select doc_id, leaf, t, row_number() over (partition by t order by doc_id nulls first, leaf) - 1 as i, row_number() over (order by t, doc_id, leaf) as key, count(*) over (partition by t) as n, other as f, '' as sib from rows_)",
        "a0 as (select t, i, leaf as h, n from f0)",
    ]

    def tree(a: str, f: str, rounds: int, kept: str) -> None:
        for k in range(rounds):
            parts.append(f"{a}{k + 1} as (select t, i // 3 as i, case when max(n) > 1 then sha256(string_agg(h, '' order by i)) else max(h) end as h, (max(n) + 2) // 3 as n from {a}{k} group by t, i // 3)")
            parts.append(
                f"{f}{k + 1} as (select key, {kept}, x.t, x.i // 3 as i, (x.n + 2) // 3 as n, x.sib || coalesce(string_agg(a.h, '' order by a.i) filter (a.i <> x.i), '') as sib, "
                f"case when x.n > 1 then sha256(string_agg(case when a.i = x.i then x.f else a.h end, '' order by a.i)) else x.f end as f "
                f"from {f}{k} x join {a}{k} a on a.t is not distinct from x.t and a.i // 3 = x.i // 3 group by key, {kept}, x.t, x.i, x.n, x.sib, x.f)"
            )

    tree("a", "f", levels, "doc_id, leaf")
    parts.append(f"s as (select t as source, h, row_number() over (order by t nulls first) - 1 as i, count(*) over () as n from a{levels})")
    parts += ["b0 as (select 0 as t, i, h, n from s)", f"g0 as (select key, doc_id, leaf, s.h as subroot, 0 as t, s.i, s.n, f, sib from f{levels} x join s on s.source is not distinct from x.t)"]
    tree("b", "g", source_levels, "doc_id, leaf, subroot")
    found = f"select doc_id, leaf, subroot, r.h as root, sha256(sib) as proof_sha256, f as folded_root, f = r.h as verified from g{source_levels}, b{source_levels} r"
    return "with " + ",\n".join(parts) + "\n" + found


OP12_SQL = manifest_sql()
