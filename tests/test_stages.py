"""Stored stages, dictionaries of ids and parameters from outside."""

import logging

import pytest
from pyspark.sql import functions as F

from newsloom import config
from newsloom.operators import ids
from newsloom.plans import queries
from newsloom.stages import Stages

SF = "/root/testdata/sf0.001"


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_a_stage_is_made_once_for_its_inputs_and_parameters(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    read, calls = lambda: spark.read.parquet(str(tmp_path / "in")), []

    def made(p):
        s = Stages(spark, str(tmp_path / "store"))
        given = s.given(str(tmp_path / "in"), read)
        a = s.table("a", lambda: calls.append("a") or given.df.where(F.col("id") < p), given, params=p)
        b = s.table("b", lambda: calls.append("b") or a.df.selectExpr("id + 1 as id"), a)
        return sorted(r.id for r in b.df.collect()), s.built

    assert made(3) == ([1, 2, 3], ["a", "b"]) and made(3) == ([1, 2, 3], []) and made(2) == ([1, 2], ["a", "b"])
    spark.range(10, 20).write.mode("append").parquet(str(tmp_path / "in"))
    assert made(3)[1] == ["a", "b"] and calls == ["a", "b"] * 3


def test_a_failed_stage_leaves_nothing(spark, tmp_path, caplog):
    s = Stages(spark, str(tmp_path))
    with pytest.raises(ValueError, match="clicks is empty"):
        s.table("clicks", lambda: spark.range(0), required=True)
    assert not any("clicks" in p.name for p in tmp_path.iterdir())
    rows = spark.createDataFrame([(1, None), (1, 2), (2, None)], "user_id bigint, item bigint")
    with caplog.at_level(logging.INFO, "newsloom"):
        got = s.table("clicks", lambda: rows, required=True)
    assert got.seen == {"rows": 3, "users": 2, "null item": 2} and "3 rows" in caplog.text


def test_of_two_writers_one_wins(spark, tmp_path):
    s = Stages(spark, str(tmp_path))

    def late():
        s.table("x", lambda: spark.range(3))
        return spark.range(5)

    assert s.table("x", late).df.count() == 3
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = Stages(spark, str(tmp_path))
        a = s.table("a", lambda: spark.range(1000).selectExpr("id % 50 as k", "id as x"), bucket="k", sort=("x",))
        b = s.table("b", lambda: spark.range(50).selectExpr("id as k", "id * 2 as y"), bucket="k")
        joined = a.df.join(b.df, "k")
        assert "Exchange" not in plan(joined) and joined.count() == 1000
        again = Stages(spark, str(tmp_path)).table("a", lambda: pytest.fail("made again"), bucket="k", sort=("x",))
        assert "Exchange" not in plan(again.df.join(b.df, "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_and_deleted_bucketed_tables(spark, tmp_path):
    made = lambda n: Stages(spark, str(tmp_path)).table("e", lambda: spark.range(n).selectExpr("id as k", "id as user_id"), bucket="k")
    first = made(0)
    assert first.df.count() == 0 and first.df.columns == ["k", "user_id"] and made(5).df.count() == 0
    Stages(spark, str(tmp_path)).files.delete(first.path)
    again = made(3)
    assert again.key == first.key and again.df.count() == 3


def test_features_read_stored_graphs_and_build_none(spark, tmp_path):
    spark.conf.set("spark.newsloom.store", str(tmp_path))
    try:
        t = queries.Tables(spark, SF)
        t.features_of(t.fused_of(t.unseen_s))
        assert sorted(t.run.built) == sorted(set(t.run.built)) and {"itemcf_edges", "swing_edges", "knn_edges", "fused", "features"} <= set(t.run.built)
        again = queries.Tables(spark, SF)
        text = plan(again.features_of(again.fused_of(again.unseen_s)).df)
        assert not again.run.built and text.count("FileScan") == 1 and "Exchange" not in text
        # a graph of the user's own takes the place of the built one
        t.swing.where("item_i % 2 = 0").select("item_i", "item_j", "sim").write.parquet(str(tmp_path / "own"))
        own = queries.Tables(spark, SF, graphs={"swing": str(tmp_path / "own")})
        assert own.swing.count() == t.swing.where("item_i % 2 = 0").count() and own.run.built == ["swing_edges"]
        assert own.swing_c().count() < t.swing_c().count()
    finally:
        spark.conf.unset("spark.newsloom.store")


def test_codes_stay_when_values_come(spark, tmp_path):
    d = ids.Dictionary(spark, str(tmp_path / "ids"))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "item bigint")
    assert d.codes() is None
    first = {r.value: r.code for r in d.extend(rows(30, 10, 10, None, 50), "item").collect()}
    assert first == {10: 1, 30: 2, 50: 3}
    second = {r.value: r.code for r in d.extend(rows(40, 30, 5, None), "item").collect()}
    assert second == first | {5: 4, 40: 5}
    assert {r.value: r.code for r in d.extend(rows(5, 50), "item").collect()} == second and d.generations() == 2
    rows(77).selectExpr("item as value", "6L as code").write.parquet(str(tmp_path / "ids" / "gen=2"))
    assert d.extend(rows(78), "item").count() == 7


def test_parameters_from_outside():
    p = config.Settings().set("itemcf.k=7", "cold.day=86400000", 'fusion.weights={"itemcf": 2.0}')
    assert p.itemcf.k == 7 and p.cold.day == 86400000.0 and p.fusion.weights == {"itemcf": 2.0} and p.swing == config.Swing()
    for wrong in ("itemcf.no=1", "none.k=1", "itemcf", "itemcf.k=x"):
        with pytest.raises(ValueError):
            config.Settings().set(wrong)


def test_the_second_run_starts_no_similarity_job(spark, tmp_path):
    from newsloom.__main__ import main

    spark.conf.set("spark.newsloom.store", str(tmp_path / "store"))
    try:
        small = ["--set", "two_tower.epochs=1", "--set", "two_tower.negatives=64", "--set", "lambda_rank.trees=3", "--set", "lambda_rank.folds=3"]
        run = lambda out, *more: main(["--input", SF, "--output", str(tmp_path / out), *small, *more]).run.built
        first = run("a")
        assert {"itemcf_edges", "swing_edges", "knn_edges", "two_tower", "fused", "features", "lambda_ranker"} <= set(first) and len(first) == len(set(first))
        assert run("b") == []
        read = lambda out, name: sorted(map(tuple, spark.read.csv(str(tmp_path / out / name), header=True).collect()))
        assert read("a", "submission") == read("b", "submission") and len(read("a", "submission")) > 0
        assert [r[0] for r in sorted(read("a", "recall_metrics"), key=lambda r: int(r[0]))] == ["5", "10", "20", "40", "50"]
        # another weight of the fusion makes anew what comes after recall, and nothing before
        assert set(run("c", "--set", "fusion.k=20", "--until", "features")) == {"fused", "features"}
    finally:
        spark.conf.unset("spark.newsloom.store")
