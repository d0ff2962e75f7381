"""Each training-data operator against a brute-force version on a small, awkward table."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from newsloom.llm import bpe, jaccard, langid, linededup, maxscore, packing, quality, suffixdedup, tokencount, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, band int, gone string"


def corpus():
    """Nulls, empty and very long texts, copies, near copies, repeated lines and rows."""
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdeéß漢ABC", k=rng.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    line = text(30)
    base = text(300)
    out = [None, "", "   \n\t ", "one", "one", "One", "a b c", text(20_000), "x" * 30_000, "é" * 500, "<|endoftext|> hi <|endoftext|>"]
    for _ in range(12):
        words = base.split(" ")
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append(" ".join(words))
    out += [base] * 5 + [f"{text(60)}\n{line}\n{text(60)}" for _ in range(8)] + [text(rng.randint(1, 200)) for _ in range(40)]
    out += ["the cat sat on the mat\n" * 40, f"{line}\n{line}\n"]
    return out


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 9 == 0 else "en", "s", len(t or ""), "clash", 7, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def by_id(df):
    found = df.toPandas().set_index("doc_id").sort_index()
    assert len(found) == len(TEXTS)
    return found


def shingle_sets(n):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for t in TEXTS:
        w = WORD.findall((t or "").translate(low))
        yield {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 2000), (5, 80, 3)])
def test_jaccard(docs, n, percent, block):
    sets = list(shingle_sets(n))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = by_id(jaccard.similar_groups(docs, n, percent, block=block))
    assert got["n_shingles"].tolist() == [len(s) for s in sets]
    assert got["component_id"].tolist() == [find(i) for i in range(len(sets))]
    kept = {r.doc_id for r in jaccard.keep_first(docs, n, percent).collect()}
    assert kept == {i for i in range(len(sets)) if find(i) == i}


def test_narrow_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    for pieces in (1, 5, 40, 333):
        a, b = (np.sort(rng.choice(pool, 500, replace=False)) for _ in "ab")
        x, y = (int.from_bytes(jaccard.narrow_sketch(s, pieces), "big") for s in (a, b))
        assert (x ^ y).bit_count() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("bound", [100_000, 2])
def test_suffix_dedup(docs, bound):
    length = 60
    raw = [(t or "").encode() for t in TEXTS]
    seen = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    got = by_id(suffixdedup.suffix_dedup(docs, length, group_bound=bound))
    for i, r in enumerate(raw):
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        assert bytes(got.loc[i, "kept"]) == bytes(b for b, g in zip(r, gone, strict=True) if not g), i
        assert [(x["start"], x["end"]) for x in got.loc[i, "removed"]] == [m.span() for m in re.finditer(b"\1+", gone)]


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(5)
    whole = [bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(200)]
    runs = []
    for k in range(5):
        part = sorted(whole[k::5])
        lcp, tail = suffixdedup.front_coded(part)
        runs.append(suffixdedup._Run({"lcp": lcp, "tail": tail, "size": np.array([len(p) for p in part], "<u2").tobytes()}))
    heads = [r.head for r in runs]
    merged = [(heads[k], lcp) for k, _, lcp in suffixdedup.merge_heads(runs, heads)]
    assert [m[0] for m in merged] == sorted(whole)
    for (a, _), (b, lcp) in zip(merged, merged[1:], strict=False):
        assert lcp == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_bpe_is_the_library(docs):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.bpe_encode(docs))
    for i, t in enumerate(TEXTS):
        ids = lib.encode_ordinary(t or "")
        assert list(got.loc[i, "ids"]) == ids
        assert got.loc[i, "ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.loc[i, "decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_token_counts_and_cache(spark, docs, tmp_path):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokencount.MODEL))
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = by_id(tokencount.token_counts(docs, cache))
        assert got["n_tokens"].tolist() == [len(lib.encode(t or "")) for t in TEXTS]
        assert got["n_bytes"].tolist() == [len((t or "").encode()) for t in TEXTS]
        assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    got = packing.pack_documents(docs).toPandas()
    for i, t in enumerate(TEXTS):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == i].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own)))
        assert sum(own["length"]) == len(ids) and len(own) == -(-len(ids) // 2048)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.1 * got["length"].sum() / 2048 + 1


def test_best_fit_takes_the_tightest_bin():
    into, offset, filled = packing.best_fit(np.array([6, 5, 4, 5, 1]), 10)
    assert filled.tolist() == [10, 10, 1] and into.tolist() == [0, 1, 0, 1, 2] and offset.tolist() == [0, 0, 6, 5, 0]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vecs = [[float(x) for x in v] for v in rng.integers(-3, 4, (300, 8)) / 16]
    vecs[3], vecs[40], vecs[41] = None, [None] + [0.5] * 7, [float("nan")] * 8
    rows = spark.createDataFrame(list(enumerate(vecs)), "vec_id bigint, embedding array<double>").select("vec_id", maxscore.quantized("embedding").alias("vec"))
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = defaultdict(list)
    for r in maxscore.top_k(queries, rows, 20, shard_rows=64, query_rows=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v in enumerate(vecs) if i not in (3, 40, 41)}
    want = {a: sorted(((b, int(q[a] @ q[b])) for b in q if b != a), key=lambda x: (-x[1], x[0]))[:20] for a in q if a % 20 == 0}
    assert got == want


def test_quality(docs):
    led = quality.ledger(docs)
    got = by_id(quality.apply_policy(led))
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]]) == want
    for r in quality.ablation(led).collect():
        mask, bit = quality.POLICIES[r.policy, r.version], 1 << quality.NAMES.index(r.rule)
        assert r.n_failed == sum(b & bit > 0 for b in got.fail_bits) and r.n_kept_without == sum(b & mask & ~bit == 0 for b in got.fail_bits)


@pytest.mark.parametrize("least", [1, 12])
def test_line_dedup(docs, least):
    seen = set()
    got = by_id(linededup.line_dedup(docs, min_words=least))
    for i, t in enumerate(TEXTS):
        kept, spans, at = [], [], 0
        for u in re.split(r"(?<=\n)", t or ""):
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", u.lower()).strip(" ")
            if norm and len(norm.split(" ")) >= least and norm in seen:
                spans.append((at, at + len(u)))
            else:
                seen.add(norm)
                kept.append(u)
            at += len(u)
        assert got.loc[i, "text"] == (None if t is None else "".join(kept))
        assert [(x["start"], x["end"]) for x in got.loc[i, "removed"]] == spans


def test_op9_removes_passages_of_short_lines(spark, tmp_path):
    verse = "the first short line\nof a planted passage\n\nthat stands in lines\nof three to ten words\n"
    texts = [f"alone here one\n{verse}the end of it", f"other words start\n{verse}and stop now", "a common short line\nnothing else", "A common  short line\nbut this\n", None, "", "\n\n"]
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in linededup.op9(spark, str(tmp_path)).collect()}
    assert [got[i].kept_text for i in got if i != 1] == [texts[i] for i in got if i != 1]  # one short line alone is no passage
    assert got[1].kept_text == "other words start\n\nand stop now" and got[1].n_removed == 4
    assert [texts[1][r.start : r.end] for r in got[1].removed] == [u + "\n" for u in verse.split("\n") if u]
    once = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()}
    assert once == {i: r.kept_text for i, r in got.items()}


def test_line_dedup_keeps_a_passage_inside_a_line(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    texts = [f"{head} {passage} {tail}\n{passage}" for head, tail in (("one", "two"), ("three", "four"))]
    got = linededup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), runs=True, min_words=linededup.PASSAGE_WORDS)
    # the limit that the README states: only where the passage fills its line is it found
    assert {r.doc_id: r.text for r in got.collect()} == {0: texts[0], 1: f"three {passage} four\n"}


def test_a_pair_is_returned_by_the_first_bucket_that_holds_both():
    rng = np.random.default_rng(3)
    n, percent = 60, 85
    sketch, size = rng.integers(0, 2**63, (1, 4), dtype=np.uint64).repeat(n, 0), np.full(n, 40)
    sketch[np.arange(n), rng.integers(0, 4, n)] ^= np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64)
    inside = rng.random((9, n)) < 0.6  # buckets by members
    want = {(i, j) for b in inside for i in np.flatnonzero(b) for j in np.flatnonzero(b) if i < j}
    for known in (9, 2):
        found = Counter()
        for key, b in enumerate(inside):
            at = np.flatnonzero(b)
            earlier = [frozenset(k for k in np.flatnonzero(inside[:, i])[:known].tolist() if k < key) for i in at]
            whole, pairs = jaccard.bucket_pairs(at, size[at], sketch[at], np.zeros(len(at), np.int8), percent, None, earlier)
            assert whole
            found.update((int(at[i]), int(at[j])) for a, z, _ in pairs for i, j in zip(a, z, strict=True))
        assert set(found) == want
        assert known < 9 or set(found.values()) == {1}


def test_passages_inside_lines_are_found_whatever_stands_around_them(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    passages, texts = [text(rng.randint(50, 90)) for _ in range(40)], []
    for k, p in enumerate(passages):
        texts += [f"{text(rng.randint(0, 40))} {p} {text(rng.randint(0, 40))}" for _ in range(2)]
        texts.append(f"{text(5)}\n{text(7)} {p.upper() if k % 2 else p.replace(' ', chr(10), 3)}\t{text(9)}\n{text(3)}")
    texts += [text(300) for _ in range(20)] + [text(5) + " " + " ".join(passages[0].split()[:30]), " ".join([text(1)] * 200), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = linededup.line_dedup(docs, runs=True, min_words=linededup.PASSAGE_WORDS, passages=True).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        spans, kept, at = got.loc[i, "removed"], "", 0
        if i >= 120 or i % 3 == 0:  # alone, or the first of its passage, or too short a part of one
            assert len(spans) == 0 and got.loc[i, "text"] == t
            continue
        assert len(spans)
        for r in spans:
            kept, at = kept + t[at : r["start"]], r["end"]
            lost = " ".join(t[r["start"] : r["end"]].lower().split())
            assert lost in passages[i // 3] and len(lost.split()) >= 1
        assert got.loc[i, "text"] == kept + t[at:]
        n = sum(len(t[r["start"] : r["end"]].split()) for r in spans)
        assert n >= max(linededup.GRAM, len(passages[i // 3].split()) - 2 * (linededup.NEAR - 1))


def test_line_runs_are_brute_force(docs):
    seen, got = set(), by_id(linededup.line_dedup(docs, runs=True, min_words=linededup.PASSAGE_WORDS))
    for i, t in enumerate(TEXTS):
        units, again, filled = re.split(r"(?<=\n)", t or ""), set(), []
        for k, u in enumerate(units):
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", u.lower()).strip(" ")
            if norm:
                filled.append(k)
                again |= {k} if norm in seen else set()
                seen.add(norm)
        lost = set()
        for at, k in enumerate(filled):
            lo = hi = at
            while lo > 0 and filled[lo - 1] in again:
                lo -= 1
            while hi + 1 < len(filled) and filled[hi + 1] in again:
                hi += 1
            if k in again and sum(len(WORD.findall(units[x])) for x in filled[lo : hi + 1]) >= linededup.PASSAGE_WORDS:
                lost.add(k)
        assert got.loc[i, "n_removed"] == len(lost)
        assert got.loc[i, "text"] == (None if t is None else "".join(u for k, u in enumerate(units) if k not in lost))


def test_toxicity_sample_is_the_least_hashes_of_each_label(spark):
    from pyspark.sql import Window, functions as F

    rows = spark.range(90_000).select(F.col("id").alias("doc_id"), F.lit(3).cast("bigint").alias("th"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    turn = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", "th"), "doc_id"))
    want = rows.withColumn("turn", turn).where(F.col("turn") <= toxicity.SAMPLE).select("doc_id", "th", "toxic")
    got = toxicity._sample_ids(rows, {0: 81_000, 1: 9_000})
    assert got.count() == 19_000 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_learned_operators_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    f = langid.op3(spark, sf).join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").toPandas()
    assert (f.lang == f.lang_pred).mean() >= 0.95 and f.score.between(0, 1).all()
    t = toxicity.op10(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    pos, neg = t[t.toxic == 1].score.to_numpy(), t[t.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() >= 0.9 and t.score.between(0, 1).all()


def test_empty_and_null_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for rows in ([], [(1, None, None, None, None, None, None, None)] * 2):
        d, n = spark.createDataFrame(rows, SCHEMA), len(rows)
        assert jaccard.similar_groups(d).count() == n
        assert all(r.n_shingles == 0 and r.component_id == 1 for r in jaccard.similar_groups(d).collect())
        assert suffixdedup.suffix_dedup(d).count() == n
        assert tokencount.token_counts(d, str(tmp_path / f"c{n}")).count() == n
        assert packing.pack_documents(d).count() == n
        assert bpe.bpe_encode(d).count() == n
        assert quality.ledger(d).count() == n and quality.keep(d).count() == 0
        assert linededup.line_dedup(d).count() == n
        assert [r.lang_pred for r in langid.predict(d, langid.fit(d)).collect()] == ["und"] * n
        assert [r.predicted for r in toxicity.score(d, toxicity.fit(d, labels)).collect()] == [0] * n
    none = spark.createDataFrame([], "query_id bigint, vec_id bigint, vec array<bigint>")
    assert maxscore.top_k(none.select("query_id", "vec"), none.select("vec_id", "vec"), 5).count() == 0
