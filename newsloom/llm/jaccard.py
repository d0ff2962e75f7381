"""Exact n-gram Jaccard join by parity sketches.

A document is the set of its distinct word n-grams, each a 64-bit hash. Documents with the same set meet by a digest
first; only the one with the smallest id goes on. Every n-gram flips one bit of a sketch, so the Hamming
distance of two sketches is at most the symmetric difference of the sets, which in turn is at most D for
a size band (pairs whose smaller set lies in the band). The sketch of a band has K > D + 1 pieces: two
similar sets agree in at least K - D of them. A document emits its D + 1 pieces with the most set bits:
of the pieces in which a pair agrees, the one with the most bits is then emitted by both, so the
pigeonhole join over (size band, piece, content) finds every similar pair, while sparse pieces, that
unrelated documents share by chance, stay out.

Members of a bucket first meet its pivot, not each other: pairs whose sizes and narrow sketches (eight bits a
piece) allow the similarity are verified on the texts, first each document's closest one, then those that are not yet
in one component. Where that does not put a bucket into one component, its members' sketches are compared block by
block inside tasks, the largest component against the rest and the rest among themselves. A block returns all pairs
that its sketches allow where these are few, which settles it; else a forest of its components by each member's closest one, and
the bucket comes up again with the components that result, in the third round with all pairs, in small frames. Copies share many
buckets: a pair is returned by the first one of a round that holds both, not by all of them. No link
that joins components is lost, and no task holds all pairs of a bucket.

Null, empty or wordless text has an empty set and links with nothing: its component is its own id. A text with fewer
words than n has its whole sequence as its only n-gram. Very long texts are taken whole; a text's set is held in
one task. Rows with one id and one text are one document; rows with one id and different texts are
documents of their own that share the id, and each row gets the result of its text. A component's id is its smallest id; null
ids count only where no other is there. Ties do not occur. An empty table gives an empty result. The id column holds whole numbers, or texts of such;
other ids are an error. Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ._common import drop, materialize
from .components import components
from .pretokens import slices

BIT = 20  # bits of position inside a piece
SPREAD = 1.4  # pieces of a sketch for each emitted one
BLOCK = 2000  # members of a bucket that one task compares
BAND_STEPS = 3  # a size band spans this many factors of 1 / threshold
BAND_BITS = 10  # of a key, for its band's number
KNOWN = 64  # buckets of a member by which it is told whether an earlier one returns a pair; a pair that shares later ones alone is returned more than once
MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: bijective, every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * MULT[1]
    x = x ^ (x >> np.uint64(27))
    x = x * MULT[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text (A-Z lower-cased, words between ASCII white space)."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    size = min(n, len(w))
    count = len(w) - size + 1
    h = np.full(count, size, np.uint64)
    for i in range(size):
        h = mix(h * MULT[0] + w[i : i + count])
    return np.unique(h)


@lru_cache(maxsize=4096)
def band_plan(band: int, percent: int) -> tuple[int, int, int]:
    """(largest size of a smaller set in the band, pieces emitted, pieces of the sketch)."""
    top = math.ceil(_edge(band + 1, percent)) - 1
    larger = top * 100 // percent
    apart = (top + larger) * (100 - percent) // (100 + percent)
    return top, apart + 1, 1 if apart == 0 else math.ceil((apart + 1) * SPREAD)


def _edge(band: int, percent: int) -> float:
    return (100 / percent) ** (BAND_STEPS * band)


def bands_of(size: int, percent: int) -> list[int]:
    """Size bands of a set: where it is the smaller one, and the band below where it can be the larger one."""
    band = int(math.log(size) / (BAND_STEPS * math.log(100 / percent)))
    while _edge(band + 1, percent) <= size:
        band += 1
    while _edge(band, percent) > size:
        band -= 1
    below = band > 0 and 100 * band_plan(band - 1, percent)[0] >= percent * size
    return [band, band - 1] if below else [band]


def narrow_sketch(h: np.ndarray, pieces: int) -> bytes:
    """Parity sketch of eight bits a piece, as whole 64-bit words. As every n-gram flips one bit, the
    Hamming distance of two of them is at most the symmetric difference of the sets."""
    at = ((h >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32) << np.uint64(3)) | (h >> np.uint64(BIT) & np.uint64(7))
    times = np.bincount(at.astype(np.int64), minlength=-(-pieces // 8) * 64)
    return np.packbits((times & 1).astype(np.uint8)).tobytes()


def piece_keys(h: np.ndarray, percent: int) -> list[dict]:
    """For each size band of a set: the join keys (digests of its heaviest sketch pieces) and a narrow
    parity sketch of eight bits a piece, by which pairs are compared before their texts are."""
    out = []
    for band in bands_of(len(h), percent):
        _, emit, pieces = band_plan(band, percent)
        bit = ((h >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32) << np.uint64(BIT)) | (h & np.uint64((1 << BIT) - 1))
        bit.sort()
        if (bit[1:] == bit[:-1]).any():  # parity: a bit flipped twice is not set
            bit, times = np.unique(bit, return_counts=True)
            bit = bit[times % 2 == 1]
        piece = (bit >> np.uint64(BIT)).astype(np.int64)
        count = np.bincount(piece, minlength=pieces)
        content = np.zeros(pieces, np.uint64)
        if len(bit):
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            content[piece[starts]] = np.bitwise_xor.reduceat(mix(bit), starts)
        chosen = np.argsort(-count, kind="stable")[:emit].astype(np.uint64)
        keys = mix(content[chosen.astype(np.int64)] + mix(chosen + (np.uint64(band + 1) << np.uint64(40))))
        keys = (keys >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)) | np.uint64(band)
        out.append({"band": band, "keys": keys.view(np.int64), "sketch": narrow_sketch(h, pieces)})
    return out


BANDS = "array<struct<band:int,keys:array<bigint>,sketch:binary>>"
_BANDS_ARROW = pa.list_(pa.struct([("band", pa.int32()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())]))


def most_apart(both_sizes, percent: int):
    """Largest symmetric difference of a similar pair, given the sum of the sets' sizes."""
    return both_sizes * (100 - percent) // (100 + percent)


SETS = f"row bigint, doc_id bigint, th bigint, n bigint, digest binary, h bigint, bands {BANDS}"


def _describe(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordHashes(), set()
        for batch in batches:
            for b, held in slices(batch, "text"):
                sizes, digests, names, bands = [], [], [], []
                for text in held:
                    h = shingles(text, n, words)
                    sizes.append(len(h))
                    digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None
                    digests.append(digest)
                    names.append(None if digest is None else int.from_bytes(digest[:8], "big", signed=True))
                    # of equal sets in a task the first one's keys are enough
                    new = digest is not None and digest not in seen and percent < 100
                    bands.append(piece_keys(h, percent) if new else None)
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(digest)
                made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(names, pa.int64()), pa.array(bands, _BANDS_ARROW)]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("th"), *made], [c.split()[0] for c in SETS.split(", ")[:7]])

    return run


def _promising(percent: int):
    """Pairs whose sketches are near enough, with their distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = [int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)]
            good = np.array(apart, np.int64) <= most_apart(b.column("size").to_numpy(zero_copy_only=False), percent)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(apart, pa.int64())], ["a", "b", "apart"]).filter(pa.array(good, pa.bool_()))

    return run


def bucket_pairs(comp: np.ndarray, size: np.ndarray, sketch: np.ndarray, side: np.ndarray, percent: int, most: int | None, earlier: list[frozenset] | None = None) -> tuple[bool, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(whether these are all, (index, index, distance) arrays) of the pairs of a bucket's members in different components whose
    sizes and sketches allow the similarity. ``side``: 0 and 1 for the two blocks of a split bucket (only pairs across
    count), else all 0. ``earlier``: each member's buckets before this one; pairs that share one are left to it. Where there are more than ``most``: of each member's nearest one after it those that make a forest of the components."""
    found, n = [], 0
    for pairs in _allowed(comp, size, sketch, side, percent, False, earlier):
        found.append(pairs)
        n += len(pairs[0])
        if most is not None and n > most:
            return False, list(_forest(comp, list(_allowed(comp, size, sketch, side, percent, True, earlier))))
    return True, found


def _forest(comp: np.ndarray, found: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pairs those that join components, the closest ones first, as if all were similar."""
    if not found:
        return
    x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    kept = []
    for k in np.lexsort((y, x, apart)).tolist():
        u, v = find(int(comp[x[k]])), find(int(comp[y[k]]))
        if u != v:
            root[u] = v
            kept.append(k)
    yield x[kept], y[kept], apart[kept]


def _allowed(comp: np.ndarray, size: np.ndarray, sketch: np.ndarray, side: np.ndarray, percent: int, closest: bool, earlier: list[frozenset] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    split = side.any()
    first = np.array([min(e, default=None) for e in earlier], object) if earlier else None
    for i in range(len(comp) - 1):
        rest = slice(i + 1, None)
        good = (comp[rest] != comp[i]) & ((side[rest] != side[i]) | (not split))
        good &= 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
        at = np.flatnonzero(good) + i + 1
        if not len(at):
            continue
        apart = np.bitwise_count(sketch[at] ^ sketch[i]).sum(1, dtype=np.int64)
        near = apart <= most_apart(size[at] + size[i], percent)
        at, apart = at[near], apart[near]
        if earlier and earlier[i] and len(at):
            own = first[at] != first[i]
            own[own] = [earlier[i].isdisjoint(earlier[j]) for j in at[own]]
            at, apart = at[own], apart[own]
        if closest and len(at):
            at, apart = at[[apart.argmin()]], apart[[apart.argmin()]]
        if len(at):
            yield np.full(len(at), i), at, apart


OPEN = "key bigint, a bigint, b bigint, apart bigint, whole boolean"


def _open_pairs(percent: int, forests: bool, most: int = 200_000):
    """Rows sorted by (key, bi, bj): the promising pairs of each bucket or block of one; ``whole``: all of them are there, as is
    always so without ``forests``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            starts = _starts(f)
            yield from settled(f, starts)
            held = f.iloc[starts[-1] :] if len(starts) else None
        if held is not None and len(held):
            yield from settled(held, [0, len(held)])

    def settled(f: pd.DataFrame, starts) -> Iterator[pd.DataFrame]:
        """Pairs of all groups but the one after the last start, which may go on in the next frame."""
        key, rep, comp, size, sketch, keys = (f[c].to_numpy() for c in ("key", "rep", "comp", "n", "sketch", "keys"))
        side = (f["own"] != f["bi"]).to_numpy().astype(np.int8)
        found, rows = [], 0
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            if z - a < 2 or not (comp[a:z] != comp[a]).any():
                continue
            bits = np.frombuffer(b"".join(sketch[a:z]), np.uint64).reshape(z - a, -1)
            earlier = [frozenset(k[k < key[a]].tolist()) for k in keys[a:z]]
            whole, pairs = bucket_pairs(comp[a:z], size[a:z], bits, side[a:z], percent, 2 * int(z - a) if forests else None, earlier)
            for i, j, apart in pairs:
                found.append(pd.DataFrame({"key": key[a], "a": np.minimum(rep[a + i], rep[a + j]), "b": np.maximum(rep[a + i], rep[a + j]), "apart": apart, "whole": whole}))
                rows += len(i)
                if rows >= most:
                    yield pd.concat(found)
                    found, rows = [], 0
        if found:
            yield pd.concat(found)

    return run


def _starts(f: pd.DataFrame) -> np.ndarray:
    keys = f[["key", "bi", "bj"]].to_numpy()
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.zeros(0, np.int64)


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last_id, last = WordHashes(), None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch.slice(i, 64)
                good = []
                for a, ta, tb in zip(b.column("a").to_pylist(), b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                    if a != last_id:
                        last_id, last = a, shingles(ta or "", n, words)
                    other = shingles(tb or "", n, words)
                    both = len(np.intersect1d(last, other, assume_unique=True))
                    good.append(100 * both >= percent * (len(last) + len(other) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    return run


def _classes(docs: DataFrame, n: int, percent: int, text_col: str, id_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(per row: row, doc_id, th (hash of the text), n, digest of its set; per distinct set: digest, first (its member with the
    smallest id) and comp, the number of its component)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    sets = materialize(source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_describe(n, percent), SETS), "sets")

    # buckets: the keys go through one exchange; a band's number is part of its keys
    w = Window.partitionBy("key")
    keyed = sets.where("bands is not null").select("h", F.explode(F.flatten(F.transform("bands", lambda b: b["keys"]))).alias("key"))
    star = keyed.select("key", "h", F.min("h").over(w).alias("pivot"), F.max("h").over(w).alias("top"), F.count("*").over(w).alias("members")).where("pivot < top")
    star = materialize(star.drop("top"), "star")

    described = materialize(sets.select("row", "doc_id", "th", "n", "digest"), "rows")
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "th")
    sketched = F.transform("bands", lambda b: F.struct(b["band"].alias("band"), b["sketch"].alias("sketch")))
    classes = sets.where("digest is not null").groupBy("digest").agg(F.min(member).alias("first"), F.first("h").alias("h"), F.first("n").alias("n"), F.first(sketched, ignorenulls=True).alias("bands"))
    classes = materialize(classes.withColumn("rep", F.col("first.row")), "classes")
    drop(spark, sets)
    # a set's own band is the first one; the band of a pair is the lower one of their own
    sized = classes.select("h", "rep", "n", F.col("bands")[0]["band"].alias("own"))
    sketches = classes.select("rep", F.inline("bands"))

    def promising(pairs: DataFrame) -> DataFrame:
        """a, b, apart: distinct pairs of sets whose sizes and sketches allow the similarity."""
        both = pairs.distinct().join(sized.toDF("ha", "a", "na", "oa"), "ha").join(sized.toDF("hb", "b", "nb", "ob"), "hb")
        both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", F.least("oa", "ob").alias("band"), (F.col("na") + F.col("nb")).alias("size"))
        both = both.join(sketches.toDF("a", "band", "sa"), ["a", "band"]).join(sketches.toDF("b", "band", "sb"), ["b", "band"])
        near = both.select("a", "b", "size", "sa", "sb").mapInArrow(_promising(percent), "a bigint, b bigint, apart bigint")
        return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart").distinct()

    near = materialize(promising(star.where("h <> pivot").select(F.col("pivot").alias("ha"), F.col("h").alias("hb"))), "near")

    def texts_of(pairs: DataFrame) -> DataFrame:
        """rep, text of the sets in pairs; a set's text is that of its first member."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(classes.select("rep", F.col("first.doc_id").alias("id"), F.col("first.th").alias("hash")), "rep")
        found = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash")))
        return found.groupBy("rep").agg(F.first("text").alias("text"))  # repeated rows meet before the exchange

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b, linked."""
        texts = materialize(texts_of(pairs), "texts")
        right = pairs.join(texts.toDF("b", "tb"), "b")
        full = right.join(texts.toDF("a", "ta"), "a")
        done = materialize(full.select("a", "b", "ta", "tb").mapInArrow(_verify(n, percent), "a bigint, b bigint, linked boolean"), "verified")
        drop(spark, texts)
        return done

    def grouped(new: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        """rep, comp: the components of linked pairs and of earlier ``groups``, whose stars stand for the links that made them."""
        links = new.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        return components(links if groups is None else links.unionByName(groups.toDF("u", "v"))).toDF("rep", "comp")

    def apart_in(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        end = lambda c: groups.toDF(c, f"c{c}")
        both = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
        return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def closest(pairs: DataFrame) -> DataFrame:
        """Each set's closest pair: most components come about by few comparisons of texts."""
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("end"), "apart")
        return ends.groupBy("end").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b").distinct()

    checked = verified(materialize(closest(near), "pairs"))
    groups = grouped(checked)
    rest = materialize(apart_in(near.join(checked.select("a", "b"), ["a", "b"], "left_anti"), groups), "pairs")
    if rest.limit(1).count():
        new = verified(rest)
        groups = grouped(new, groups)
        checked = materialize(checked.unionByName(new), "verified")
    drop(spark, near, rest)

    # buckets of two are settled; larger ones are followed up where they are not in one component
    members = star.where("members > 2").join(sized.select("h", "rep"), "h").select("key", "rep")
    for forests in (True, True, False):
        here = members.join(groups, "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
        shares = here.groupBy("key", "comp").agg(F.count("*").alias("c"))
        main = shares.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("all")).where(F.col("all") > F.col("main.c"))
        rows = here.join(main, "key").withColumn("band", F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")).join(sketches, ["rep", "band"]).join(sized.select("rep", "n"), "rep")
        keys = rows.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("key")), 1, KNOWN).alias("keys"))
        rows = rows.join(keys, "rep")
        # blocks 0 .. m - 1 hold the largest component, which is not compared with itself, blocks m .. last the others
        m, others = F.ceil(F.col("main.c") / block), F.ceil((F.col("all") - F.col("main.c")) / block)
        largest = F.col("comp") == F.col("main.comp")
        rows = rows.withColumn("m", m).withColumn("last", m + others - 1)
        rows = rows.withColumn("own", F.when(largest, F.pmod(F.xxhash64("rep"), "m")).otherwise(F.col("m") + F.pmod(F.xxhash64("rep"), F.col("last") - F.col("m") + 1)))
        rows = rows.withColumn("other", F.explode(F.sequence(F.when(largest, F.col("m")).otherwise(F.lit(0)), "last")))
        rows = rows.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "rep", "comp", "n", "sketch", "keys")
        dealt = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")
        found = materialize(dealt.mapInPandas(_open_pairs(percent, forests), OPEN), "open")
        pairs = found.where("whole").select("a", "b").unionByName(closest(found.where("not whole"))).distinct()
        fresh = materialize(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if fresh.limit(1).count():
            new = verified(fresh)
            checked = materialize(checked.unionByName(new), "verified")
            if new.where("linked").limit(1).count():
                groups = grouped(new, groups)
        # a bucket whose pairs were all returned is settled
        again = found.where("not whole").select("key").distinct()
        if not again.limit(1).count():
            break
        members = materialize(members.join(again, "key", "left_semi"), "members")
    drop(spark, star)
    return described, classes.join(groups, "rep", "left").select("digest", "first", F.coalesce("comp", "rep").alias("comp"))


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id (smallest id with the same set) and component_id
    (smallest id reachable by links of similarity >= percent / 100)."""
    rows, classes = _classes(docs, n, percent, text_col, id_col, block)
    least = classes.groupBy("comp").agg(F.min("first.doc_id").alias("component_id"))
    named = classes.join(least, "comp").select("digest", F.col("first.doc_id").alias("class_id"), "component_id")
    out = rows.join(named, "digest", "left")
    own = lambda c: F.coalesce(c, "doc_id").alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("class_id"), own("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with their columns: of each component exactly one row stays, one with its smallest id
    (a null id counts as the largest); of rows that agree in id and text it is one with the least hash of all columns.
    Rows without words are components of their own and all stay."""
    rows, classes = _classes(docs, n, percent, text_col, id_col, BLOCK)
    first = classes.groupBy("comp").agg(F.min("first").alias("f")).select("f.doc_id", "f.th")
    times = rows.groupBy("doc_id", "th").agg(F.count("*").alias("times")).where("times > 1")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash"))
    repeated = times.select(F.col("doc_id").alias("id"), F.col("th").alias("hash"), F.lit(True).alias("many"))
    stay = first.join(repeated, same, "left").select("doc_id", "th", F.coalesce("many", F.lit(False)).alias("many"))
    stay = materialize(stay.unionByName(rows.where("digest is null").select("doc_id", "th").distinct().withColumn("many", F.lit(False))), "stay")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input_row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    kept = whole.join(stay, same)
    out = kept.where("not many").select("input_row")
    if stay.where("many").limit(1).count():
        one = kept.where("many").groupBy("id", "hash").agg(F.min_by("input_row", F.xxhash64(F.to_json("input_row"))).alias("input_row"))
        out = out.unionByName(one.select("input_row"))
    return out.select("input_row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    found = similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")
