"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix between its tokens and put together anew.

A text becomes an array of its code points (UTF-32); where a point is no white space and the one after it is (or the text
ends) a token ends, so a token is a word with the white space before it, and white space at the end is a token of its own.
Two ranks among the n + 1 boundaries, drawn by hash of seed and id, give the cuts; the pieces are slices of the array. By a
third and a fourth number the text stays plain, or its pieces stand in the order suffix, prefix, middle (spm) or prefix,
suffix, middle (psm), each behind its mark. Texts that hold a mark stay plain, so the first marks of an output are ours and
``restore`` rebuilds every text from output and form alone.

Null and empty texts have no token and stay plain, as the empty text. A text of white space alone is one token. Very long
texts are taken whole, one at a time. Repeated rows each get their row; equal ids get equal numbers, whatever their texts; a
null id counts as the empty text. There are no ties: equal ranks leave the middle empty. Empty tables give empty results.
Other columns are ignored, or carried along as the struct ``input_row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .pretokens import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50  # of 100 texts, those that are cut
SPM = 80  # of 100 cut texts, those with the suffix first


def boundaries(points: np.ndarray) -> np.ndarray:
    """0 and the end of every token of an array of code points."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate([[0], ends, [len(points)]] if len(points) else [[0]]).astype(np.int64)


def cut(text: str, drawn: str, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, prefix characters, middle characters, output); ``drawn``: a hex digest, its first four groups of eight digits are the numbers."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = boundaries(points)
    n = len(ends) - 1
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not n or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = ends[sorted((h1 % (n + 1), h2 % (n + 1)))].tolist()
    prefix, middle, suffix = (points[x:y].tobytes().decode("utf-32-le") for x, y in ((0, a), (a, b), (b, len(points))))
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transform(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, held in slices(batch, "text"):
                made = [cut(t, h, rate, spm) for t, h in zip(held, b.column("drawn").to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*made, strict=True)
                arrays = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output)]
                kept = [c for c in b.schema.names if c not in ("text", "drawn")]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *arrays], [*kept, "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM, carry: bool = False) -> DataFrame:
    """Per row (with the whole input row as the struct ``input_row`` if ``carry``): id, n (tokens), form, prefix_chars, middle_chars, output."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input_row")] if carry else []
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    d = docs.select(F.col(id_col).alias("doc_id"), *rest, F.col(text_col).cast("string").alias("text"), drawn.alias("drawn"))
    made = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    return d.mapInArrow(_transform(rate, spm), T.StructType([f for f in d.schema.fields if f.name not in ("text", "drawn")] + made))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    ordered = lambda *at: F.concat(*[F.get(parts, F.lit(i)) for i in at])
    return F.when(form == "plain", output).when(form == "psm", ordered(1, 3, 2)).otherwise(ordered(2, 3, 1))


def op11(spark, sf_dir: str) -> DataFrame:
    d = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


OP11_SQL = r"""
with base as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), cut as (
  select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::bigint) as r
  from base
), form as (
  select *, len(u) as n,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 50 then 'plain' when r[4] % 100 < 80 then 'spm' else 'psm' end as form,
    least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) as a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) as b
  from cut
), parts as (
  select doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m, coalesce(array_to_string(u[b + 1:], ''), '') as s
  from form
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""
