"""Substring dedup by hashing lines or paragraphs.

A text is cut into units (lines by default, or paragraphs at blank lines). A unit is normalised
(lower case, runs of white space to one space, trimmed) and digested. Units of at least ``min_words`` words (by default
every unit that is not blank) are grouped by digest over the whole table; the occurrence first in (rank, doc_id, offset)
order stays and all others are removed together with the line break that ends them. Removed spans keep their
offsets in the original text (code points, end exclusive).

With ``runs``, as in op9 and in the pipeline, every unit that is not blank is grouped, and what counts is the run: later
occurrences that follow each other in a text, blank units between them aside, are removed if they have ``min_words``
words together. So a unit of that length always goes, and a shorter one where the passage around it repeats too; a short
line that stands alone is left to documents that share nothing else. Blank units stay.

With ``passages``, as in op9 and in the pipeline, repeats that do not fill lines are found too. Windows of ``GRAM`` words (lower case,
whatever the white space between them) stand for a text: of every ``NEAR`` that follow each other the one with the least hash, so any passage of
GRAM + NEAR - 1 = 50 words that two texts share has one that both of them chose. Windows are grouped by a 128-bit digest; the words of one that an earlier
document chose too go, in the same order of documents as above. What repeats within one document only is left to the lines. At either end of a
passage up to NEAR - 1 words can stay, and repeats of fewer than GRAM words that do not fill lines are none.

Null text has no units and stays null; an empty text stays empty; an empty table gives an empty result. Very long texts are
cut whole. Repeated rows with one id count as one document's copies in order of their row number, whatever their texts;
ties of rank go to the smaller id, and a null id comes first. Other columns pass through, but for those named like an
added one (n_removed, removed, n_units), which it replaces. Built-in functions find what is lost; only
documents that lose something are cut and joined again, in a pandas UDF. The group of a digest is reduced map-side to its first occurrence, so a very frequent
line moves one row per task. The windows' rows (about one in 8 words) go through one exchange.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ._common import materialize
from .jaccard import MULT, WordHashes, mix
from .pretokens import slices

PASSAGE_WORDS = 12  # of the runs that op9 and the pipeline remove
GRAM = 35  # words of a window
NEAR = 16  # windows of which the least is chosen
SPANS = "array<struct<start:bigint,end:bigint>>"

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BREAK = {"line": r"(?<=\n)", "paragraph": r"(?<=\n\n)(?!\n)"}


def _units(text: Column, by: str) -> Column:
    """Units with the break that ends them, so that joining them gives the text back."""
    return F.split(text, _BREAK[by])


def _normal(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), r"[\x20\x09-\x0D]+", " "))


def _long_runs(units: list[str], again: list[int], min_words: int) -> list[int]:
    """Those of the sorted positions ``again`` whose run, blank units aside, has ``min_words`` words."""
    gone, run, words, last = [], [], 0, -1
    for i in again:
        if any(_WORD.search(u) for u in units[last + 1 : i]):
            gone += run if words >= min_words else []
            run, words = [], 0
        run.append(i)
        words, last = words + len(_WORD.findall(units[i])), i
    return gone + (run if words >= min_words else [])


def _sliding(x: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` of every ``width`` values that follow each other, by parts of 1, 2, 4, ... values; ``width`` may be any number."""
    out, done, part, size = None, 0, x, 1
    while done < width:
        if width & size:
            n = len(x) - done - size + 1
            out, done = part[: max(n, 0)] if out is None else join(out[: max(n, 0)], part[done : done + max(n, 0)]), done + size
        part, size = join(part[: max(len(part) - size, 0)], part[size:]), 2 * size
    return out


def _chosen(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, two hashes) of the chosen windows of texts side by side; ``words``: hashes of their words, ``sizes``: words of each text."""
    none = np.zeros(0, np.int64)
    if len(words) < GRAM + NEAR - 1:
        return none, none, none
    h = _sliding(mix(words), GRAM, lambda a, b: mix(a * MULT[0] + b))
    of = np.repeat(np.arange(len(sizes)), sizes)
    # the least of each NEAR windows, 0 where these do not lie in one text
    least = _sliding(h, NEAR, np.minimum)
    least[of[: len(least)] != of[GRAM + NEAR - 2 :]] = 0
    # a window is chosen if it is the least one of some NEAR, so the largest of the least ones of all that it is in
    edge = np.zeros(NEAR - 1, np.uint64)
    best = _sliding(np.concatenate([edge, least, edge]), NEAR, np.maximum)
    chosen = (best == h) & (best > 0)
    chosen[1:] &= h[1:] != h[:-1]  # of a word that goes on and on the first window is enough
    at = np.flatnonzero(chosen)
    other = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        other = mix(other * MULT[1] + words[at + k])
    return at, h[at].view(np.int64), other.view(np.int64)


def _windows(names: list[str]):
    """Rows of the chosen windows: u_row, id and rank of the text, its word at which the window starts, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for b, held in slices(batch, "text"):
                parts = [t.lower().encode().split() for t in held]
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                words = np.fromiter((hashes[w] for p in parts for w in p), np.uint64, int(sizes.sum()))
                at, a, z = _chosen(words, sizes)
                ends = np.cumsum(sizes)
                of = np.searchsorted(ends, at, "right")
                kept = b.drop_columns(["text"]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at - (ends - sizes)[of]), pa.array(a), pa.array(z)], names)

    return run


def _passages(held: DataFrame, text: Column, id_: Column, rank: Column) -> DataFrame:
    """u_row, pos: the chosen windows (by their first word) of which an earlier text has one too."""
    rows = held.select("u_row", id_.alias("id"), rank.alias("rank"), text.cast("string").alias("text"))
    schema = T.StructType([*rows.drop("text").schema, *[T.StructField(c, T.LongType()) for c in ("pos", "ha", "hb")]])
    found = rows.mapInArrow(_windows(schema.names), schema)
    first = F.min(F.struct("rank", "id", "u_row")).over(Window.partitionBy("ha", "hb"))
    return found.withColumn("first", first).where(F.col("u_row") != F.col("first.u_row")).select("u_row", "pos")


def _cut_out(text: str, lines: list[tuple[int, int]], windows: list[int]) -> list[tuple[int, int]]:
    """Spans that are lost, in order: ``lines`` (sorted spans) and what the words of ``windows`` (first words) cover outside of them, up to the
    next word or the end of the line."""
    if not windows:
        return lines
    words = [m.span() for m in re.finditer(r"([^\x20\x09-\x0D]+)[\x20\x09]*", text)]
    runs: list[list[int]] = []
    for w in windows:
        if runs and w <= runs[-1][1]:
            runs[-1][1] = w + GRAM
        else:
            runs.append([w, w + GRAM])
    spans, k = list(lines), 0
    for a, z in ((words[i][0], words[j - 1][1]) for i, j in runs):
        while k < len(lines) and lines[k][1] <= a:
            k += 1
        n = k
        while n < len(lines) and lines[n][0] < z:
            if a < lines[n][0]:
                spans.append((a, lines[n][0]))
            a, n = max(a, lines[n][1]), n + 1
        if a < z:
            spans.append((a, z))
    return sorted(spans)


def _rebuild(by: str, min_run: int):
    """(text, sorted positions of repeated units, sorted first words of repeated windows) -> kept text and offsets of what is lost, in linear time;
    with ``min_run`` only runs of so many words are lost."""
    pattern = re.compile(_BREAK[by])

    @F.pandas_udf("kept string, starts array<bigint>, ends array<bigint>")
    def run(text: pd.Series, gone: pd.Series, windows: pd.Series) -> pd.DataFrame:
        rows = []
        for t, g, w in zip(text, gone, windows, strict=True):
            if t is None:
                rows.append((None, None, None))
                continue
            units = pattern.split(t)
            g = _long_runs(units, g.tolist(), min_run) if min_run else g.tolist()
            ends = list(accumulate(map(len, units)))
            lost = _cut_out(t, [(ends[i] - len(units[i]), ends[i]) for i in g], w.tolist())
            bounds = [0, *(x for span in lost for x in span), len(t)]
            kept = "".join(t[a:z] for a, z in zip(bounds[::2], bounds[1::2], strict=True))
            rows.append((kept, [a for a, _ in lost], [z for _, z in lost]))
        return pd.DataFrame(rows, columns=["kept", "starts", "ends"])

    return run


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rank_col: str | None = None, by: str = "line", min_words: int = 1, runs: bool = False, passages: bool = False) -> DataFrame:
    """``docs`` with the text replaced by what is kept, and n_removed, removed (array of start, end in the
    original text) and n_units added."""
    # the input row travels as one struct, so that none of its names can clash
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input_row")
    held = materialize(docs.select(whole, F.monotonically_increasing_id().alias("u_row")), "line-rows")
    text = F.col("input_row")[text_col]
    rank = F.col("input_row")[rank_col] if rank_col else F.lit(0)
    cut = held.select("u_row", F.col("input_row")[id_col].alias("id"), rank.alias("rank"), _units(text, by).alias("units"))
    unit = cut.select("u_row", "id", "rank", F.posexplode("units").alias("pos", "unit")).withColumn("norm", _normal(F.col("unit")))
    words = F.size(F.split("norm", " "))
    compared = (F.col("norm") != "") & (F.lit(runs) | (words >= min_words))
    # written once: the groups and the join back would else cut and digest every text twice
    keyed = materialize(unit.where(compared).select("u_row", "pos", F.unhex(F.md5("norm")).alias("digest"), "rank", "id", words.alias("words")), "line-keys")
    place = F.struct("rank", "id", "u_row", "pos")
    first = keyed.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = keyed.join(first, "digest").where((F.col("u_row") != F.col("first.u_row")) | (F.col("pos") != F.col("first.pos")))
    again = again.select("u_row", "pos", "words", F.lit(False).alias("window"))
    if passages:
        windows = _passages(held, text, F.col("input_row")[id_col], rank)
        again = again.unionByName(windows.select("u_row", "pos", F.lit(0).alias("words"), F.lit(True).alias("window")))
    listed = lambda w: F.sort_array(F.collect_list(F.when(F.col("window") == w, F.col("pos").cast("bigint"))))
    # a text without so many repeated words has no run of them
    gone = again.groupBy("u_row").agg(listed(False).alias("gone"), listed(True).alias("windows"), F.sum("words").alias("words")).where((F.col("words") >= min_words) | (F.size("windows") > 0)).drop("words")
    # only documents that lose something are cut again; the others pass as they are
    out = held.join(gone, "u_row", "left")
    lost = F.col("gone").isNotNull()
    out = out.withColumn("made", _rebuild(by, min_words if runs else 0)(F.when(lost, text), F.col("gone"), F.col("windows")))
    spans = F.arrays_zip(F.col("made.starts").alias("start"), F.col("made.ends").alias("end")).cast(SPANS)
    added = {
        "n_removed": F.when(lost, F.size("made.starts")).otherwise(0).cast("long"),
        "removed": F.when(lost, spans).otherwise(F.array().cast(SPANS)),
        "n_units": F.when(text.isNull(), 0).otherwise(F.size(_units(text, by))).cast("long"),
    }
    kept = F.when(lost, F.col("made.kept")).otherwise(text).alias(text_col)
    same = [kept if c == text_col else F.col("input_row")[c].alias(c) for c in docs.columns if c == text_col or c not in added]
    return out.select(*same, *[c.alias(n) for n, c in added.items()])


def op9(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), runs=True, min_words=PASSAGE_WORDS, passages=True)
    return found.select("doc_id", "n_removed", "removed", F.col("text").alias("kept_text"))
