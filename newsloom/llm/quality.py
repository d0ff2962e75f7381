"""Quality rules as a bitmask ledger, in built-in functions only.

``ledger`` evaluates every rule once per document and stores the measurements and one long of failure
bits. Policies are versioned masks over those bits: ``apply_policy`` needs no text, and ``ablation``
compares rules and policies by bitwise aggregation of the ledger.

Null text has no words: all its counts are 0 and the base rules fail. Empty tables give empty results;
repeated rows each get their row, whatever their ids; very long texts are measured whole, as the arrays of one row; there are no
ties; columns of the input other than the id are ignored by ``ledger``.
Windows of three words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ._common import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"




def _rules() -> list[tuple[str, Column]]:
    """Rule of each bit and when it fails; ratios as integers, so that no rounding decides."""
    n, c = F.col("n_words"), F.col
    return [
        ("few_words", n < 50),
        ("repeated_words", 100 * c("n_repeat_words") > 50 * n),
        ("word_length", (c("word_chars") < 3 * n) | (c("word_chars") > 12 * n)),
        ("symbols", 10 * c("n_symbols") > n),
        ("duplicate_lines", 10 * c("n_dup_lines") > 6 * c("n_lines")),
        ("upper_case", 10 * c("n_upper") > 3 * c("word_chars")),
    ]


NAMES = ["few_words", "repeated_words", "word_length", "symbols", "duplicate_lines", "upper_case"]
BASE = 0b000011
#: (policy, version) -> mask of the bits that reject.
POLICIES = {("base", 1): BASE, ("standard", 1): 0b001111, ("standard", 2): 0b111111}
CURRENT = ("standard", 2)


def ledger(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: bool = False) -> DataFrame:
    """Per row (with the whole input row as the struct ``input_row`` if ``carry``): id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, fail_bits."""
    rest = ["input_row"] if carry else []
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input_row")] if carry else []
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *whole)
    d = d.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.regexp_like(x, F.lit(WORD))))
    n = F.size("w")
    at = lambda i: F.element_at("w", i.cast("int"))
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    d = d.select(
        "doc_id",
        *rest,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # most texts repeat no window; only the others sort theirs
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(repeats, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    hash_at = lambda i: F.get("s", i)["h"]
    twice = F.filter("s", lambda e, i: (e["h"] == hash_at(i + 1)) | F.coalesce(e["h"] == hash_at(i - 1), F.lit(False)))
    inside = F.flatten(F.transform(twice, lambda e: F.array(e["p"], e["p"] + 1, e["p"] + 2)))
    covered = F.size(F.array_distinct(inside))
    d = d.withColumn("n_repeat_words", F.when(F.col("s").isNull(), 0).otherwise(covered).cast("long")).drop("h", "s")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(_rules())])
    return d.withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return led.withColumn("base_failed", failed(BASE)).withColumn("kept", ~failed(BASE | POLICIES[policy]))


def keep(docs: DataFrame, policy: tuple[str, int] = CURRENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns."""
    # the ledger is stored before a policy filters it: pushed into the ledger, the filter would repeat every rule
    stored = materialize(ledger(docs, text_col, id_col, carry=True), "ledger")
    return apply_policy(stored, policy).where("kept").select("input_row.*")


def ablation(led: DataFrame, policies: dict[tuple[str, int], int] | None = None) -> DataFrame:
    """Per policy and rule: how many documents fail the rule, fail it alone, and would be kept without it."""
    policies = POLICIES if policies is None else policies
    # documents meet by their bits before anything else: at most 2^rules rows are left
    by_bits = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    plan = [(name, version, mask, NAMES[i], 1 << i) for (name, version), mask in policies.items() for i in range(len(NAMES)) if mask >> i & 1]
    rules = by_bits.sparkSession.createDataFrame(plan, "policy string, version int, mask bigint, rule string, bit bigint")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    has = hit.bitwiseAND(F.col("bit")) != 0
    each = by_bits.join(F.broadcast(rules), F.lit(True))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return each.groupBy("policy", "version", "rule").agg(
        count(has)("n_failed"), count(hit == F.col("bit"))("n_failed_alone"), count(hit == 0)("n_kept"), count((hit == 0) | (hit == F.col("bit")))("n_kept_without"),
        F.bit_or(hit).alias("bits_seen"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return led.select(*cols, "n_lines", "n_upper", "fail_bits")


OP7_SQL = r"""
with base as (
  select doc_id, coalesce(text, '') as t from documents
), cut as (
  select doc_id, t,
    regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from base
), win as (
  select doc_id, p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from cut)
), twice as (
  select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as n from win) where n > 1
), rep as (
  select doc_id, count(distinct q) as n_repeat_words
  from (select doc_id, unnest([p, p + 1, p + 2]) as q from twice) group by doc_id
), m as (
  select c.doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, len(ls) as n_lines, len(regexp_extract_all(t, '\p{Lu}')) as n_upper
  from cut c left join rep using (doc_id)
), b as (
  select *,
    (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when word_chars < 3 * n_words or word_chars > 12 * n_words then 4 else 0 end)
    + (case when 10 * n_symbols > n_words then 8 else 0 end)
    + (case when 10 * n_dup_lines > 6 * n_lines then 16 else 0 end)
    + (case when 10 * n_upper > 3 * word_chars then 32 else 0 end) as fail_bits
  from m
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept,
  cast(n_lines as bigint) as n_lines, cast(n_upper as bigint) as n_upper, cast(fail_bits as bigint) as fail_bits
from b
"""
