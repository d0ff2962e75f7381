"""Fill-in-middle, Merkle manifest and quality votes against plain Python on small, awkward tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import fillmiddle, merkle, neighbours, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def awkward_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abé漢😀  <PSM>", k=rng.randint(1, 6)))
    space = lambda: "".join(rng.choices(" \t\n\v\f\r", k=rng.randint(1, 3)))
    out = [None, "", " ", "\n\n", "x", " x", "x ", "<P>", "a<S>b c", "<M> ", "<", "P> <", "\x00 \x1f", "é ́e", "漢 字" * 9]
    out += ["".join(word() + space() for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return [*out, "long word " * 60_000, "x" * 400_000, "a b", "a b"]


def test_tokens_end_where_the_pattern_says():
    for t in awkward_texts():
        t = t or ""
        ends = fillmiddle.boundaries(np.frombuffer(t.encode("utf-32-le"), "<u4"))
        assert ends.tolist() == [0, *(m.end() for m in TOKEN.finditer(t))]


def forms(i, t, rate=50, spm=80):
    u = TOKEN.findall(t)
    h = [int(sha(f"42:{'' if i is None else i}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_fill_in_middle(spark, rate, spm):
    texts = awkward_texts()
    rows = [(None if k == 9 else k % 160, t, k, None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form int, output string").repartition(3)
    d = fillmiddle.fill_in_middle(docs, rate=rate, spm=spm, carry=True).withColumn("back", fillmiddle.restore(F.col("output"), F.col("form")))
    got = {r.input_row.form: r for r in d.collect()}
    assert len(got) == len(rows)
    for i, t, k, _ in rows:
        r, t = got[k], t or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == forms(i, t, rate, spm) and r.back == t and r.doc_id == i
    assert {r.form for r in got.values()} == ({"plain"} if not rate else {"plain", "spm"} if spm == 100 else {"plain", "psm"} if not spm else {"plain", "spm", "psm"})


def test_fill_in_middle_of_nothing(spark):
    assert fillmiddle.fill_in_middle(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def tree(nodes, fanout):
    """Root, and of every node its siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            paths[k] += [nodes[j] for j in range(i - i % fanout, min(len(nodes), i - i % fanout + fanout)) if j != i]
        at = [i // fanout for i in at]
        nodes = [sha("".join(nodes[a : a + fanout])) for a in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout=3):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every (doc_id, text, lang, source, n_chars)."""
    def digest(i, source, lang, n, text):
        return sha(b"".join(b"-" if x is None else b"%d:%s" % (len(str(x).encode()), str(x).encode()) for x in (i, source, lang, n, text)))

    by = {}
    for i, text, lang, source, n in rows:
        cut = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        by.setdefault(source, []).append((i is not None, i, digest(i, source, lang, n, text), digest(i, source, lang, n, cut)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    trees = {s: tree([r[2] for r in by[s]], fanout) for s in sources}
    root, tops = tree([trees[s][0] for s in sources], fanout)

    def fold(h, at, n, path):
        path = list(path)
        while n > 1:
            run = min(fanout, n - (at - at % fanout))
            mine, path = path[: run - 1], path[run - 1 :]
            mine.insert(at % fanout, h)
            h, at, n = sha("".join(mine)), at // fanout, -(-n // fanout)
        return h

    for k, s in enumerate(sources):
        for pos, (_, i, leaf, other) in enumerate(by[s]):
            folded = fold(fold(other, pos, len(by[s]), trees[s][1][pos]), k, len(sources), tops[k])
            yield i, leaf, trees[s][0], root, sha("".join(trees[s][1][pos] + tops[k])), folded, folded == root


def manifest_rows():
    rng = random.Random(8)
    rows = [(k, f"text {k}\nline", "en", "big", 9) for k in range(200)]
    rows += [(k, rng.choice([None, "", "a", "a\nb", "é漢\n\n", "-", "1:a"]), rng.choice([None, "en"]), rng.choice([None, "", "a", "é", "z", "-"]), rng.choice([None, 3])) for k in range(300, 360)]
    return rows + [(5, "text 5\nline", "en", "big", 9), (5, "other", "en", "big", 9), (5, "other", "en", "big", 9), (None, "no\nid", "en", "big", 1), (1000, "x" * 300_000 + "\n", "en", "alone", 1)]


@pytest.mark.parametrize(("fanout", "depth"), [(3, 6), (3, 1), (3, 2), (2, 2), (5, 1)])
def test_manifest(spark, fanout, depth):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, tree int, digest string").repartition(5)
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.manifest(docs, {"text": cut}, fanout=fanout, depth=depth).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(rows, fanout), key=str)
    assert 0 < sum(r.verified for r in got) < len(got)


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(7, "t\n", None, None, 2)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    r = merkle.manifest(docs).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == sha("1:7--1:22:t\n") and r.proof_sha256 == sha("") and r.verified
    assert merkle.manifest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_merkle_manifest"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def labelled_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    good = lambda: " ".join(word() for _ in range(rng.randint(20, 60))).capitalize() + "."
    junk = lambda: rng.choice([" ".join(f"{word()}###" for _ in range(30)), " ".join([word()] * 40), " ".join(f"{word()}!!" for _ in range(30)).upper()])
    rows = [(k, good() if k % 4 else junk(), int(k % 4 > 0)) for k in range(240)]
    return rows


def test_votes_are_those_of_the_nearest(spark):
    rows = labelled_rows()
    extra = [(500, None, None), (501, "", None), (502, "9 %% \n", None), (0, rows[0][1], None), (7, "a text of the id seven", None), (None, "no id", None), (503, "long " * 300_000, None)]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t, _ in [*rows, *extra]], "doc_id bigint, text string, score string, y int").repartition(3)
    labels = spark.createDataFrame([*[(i, q) for i, _, q in rows], (9, 0), (12, None), (13, 7)], "doc_id bigint, quality int")
    model = neighbours.fit(docs, labels, sample=60)
    assert len(model.vectors) == 120 and model.space.shape == (neighbours.TERMS, neighbours.DIMS)
    got = sorted(((r.doc_id, r.text, r.score, r.predicted, r.y) for r in neighbours.score(docs, model).collect()), key=str)
    assert len(got) == len(rows) + len(extra) and {r[4] for r in got} == {3}
    hashes, want = neighbours.WordHashes(), []
    for i, t in ((r[0], r[1]) for r in got):
        x = neighbours.weighted(neighbours.counts(t or "", hashes)[None], model.idf)[0] @ model.space
        x = x / max(float(np.linalg.norm(x)), 1e-12)
        sims = [max(round(float(x @ v), 5), 0.0) for v in model.vectors]
        least = sorted(sims)[-neighbours.NEIGHBOURS]
        near = [(s, v) for s, v in zip(sims, model.votes, strict=True) if s >= least]
        all_ = sum(s * v[1] for s, v in near)
        want.append(sum(s * v[0] for s, v in near) / all_ if all_ else model.share)
    assert [r[2] for r in got] == pytest.approx(want, abs=2e-3)
    assert {r[2] for r in got if not r[1]} == {model.share} and all(r[3] == (r[2] >= 0.3) for r in got)
    truth = dict((i, q) for i, _, q in rows)
    assert np.mean([(r[2] >= 0.5) == truth[r[0]] for r in got if r[0] in truth and r[0] not in (0, 7, 9)]) > 0.95
    kept = neighbours.keep(docs, labels)
    assert kept.columns == docs.columns and 170 < kept.count() < 200


def test_sample_is_full_under_repeated_rows(spark):
    rows = labelled_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [rows[3][:2]] * 4000, "doc_id bigint, text string")
    model = neighbours.fit(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int"), sample=30)
    assert len(model.vectors) == 60 and model.votes[:, 1].sum() == pytest.approx(240) and model.share == pytest.approx(0.75)


def test_pieces_count_like_the_whole(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abé#!9\n", k=rng.randint(1, 5))) for _ in range(500)) + " end end end"
    whole = neighbours.counts(text, neighbours.WordHashes())
    monkeypatch.setattr(neighbours, "PIECE", 50)
    assert len(list(neighbours._pieces(text))) > 5 and (neighbours.counts(text, neighbours.WordHashes()) == whole).all()


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in neighbours.score(docs, neighbours.fit(docs, labels)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert [r.score for r in neighbours.score(docs, neighbours.fit(docs, one)).collect()] == [1.0, 1.0]
    assert neighbours.score(docs.limit(0), neighbours.fit(docs.limit(0), one)).count() == 0


def test_held_out_quality(spark):
    got = queries.QUERIES["op13_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert {bool(h) == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True)} == {True}


def test_components_end_where_only_stars_are_left(spark, monkeypatch):
    from newsloom.llm import components as cc

    made = []
    monkeypatch.setattr(cc, "materialize", lambda d, label, keep=cc.materialize: made.append(label) or keep(d, label))
    found = lambda links: {r.node: r.component for r in cc.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert found([(1, 2), (3, 1), (3, 1), (9, 8), (5, 5)]) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert made == ["cc-edges"]  # no round: stars are given
    assert found([(1, 2), (3, 2), (4, 3), (4, 6), (7, 6), (20, 21)]) == dict.fromkeys((1, 2, 3, 4, 6, 7), 1) | {20: 20, 21: 20}
    made.clear()
    rng = np.random.default_rng(5)
    links = rng.integers(0, 120, (90, 2)).tolist()
    least = {n: n for x in links for n in x if x[0] != x[1]}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found(links) == least
