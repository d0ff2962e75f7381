"""Work that grows with what is there: sets of channels as bits, an article of a history once a candidate, seeds dealt by user."""

import pytest
from pyspark.sql import functions as F

from newsloom import config
from newsloom.operators import features as ft, recall as rc, twotower as tt


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_sets_of_channels_are_bits(spark):
    some = lambda *rows: spark.createDataFrame(rows, "user_id bigint, article_id bigint")
    d = rc.overlaps({"a": some((1, 10), (1, 11), (2, 10), (2, 10)), "b": some((1, 10)), "c": some((3, 12), (1, 10))})
    assert "collect_set" not in plan(d)
    assert {(r.a, r.b): r.overlap for r in d.collect()} == {("a", "b"): 1 / 3, ("a", "c"): 1 / 3, ("b", "a"): 1.0, ("b", "c"): 1.0, ("c", "a"): 0.5, ("c", "b"): 0.5}


@pytest.mark.parametrize("history", [2, None])
def test_an_article_of_a_history_meets_a_candidate_once(spark, history):
    clicks = [(1, 11, 5, 1), (1, 12, 6, 2), (1, 11, 7, 3), (1, 11, 8, 4), (2, 12, 9, 5)]
    click = spark.createDataFrame(clicks, "user_id bigint, click_article_id bigint, click_timestamp bigint, event_id bigint")
    cand = spark.createDataFrame([(1, 20), (1, 21), (1, 22), (2, 20), (2, 20), (3, 20)], "user_id bigint, article_id bigint")
    edges = spark.createDataFrame([(11, 20, 0.5), (12, 20, 0.25), (12, 21, 1.0), (20, 11, 9.0)], "item_i bigint, item_j bigint, sim double")
    d = ft.decayed_sum(cand, click, edges, history)
    assert "left_semi" in d._jdf.queryExecution().analyzed().toString().lower().replace("leftsemi", "left_semi")
    power = "power(0.7" if "power(0.7" in plan(d).lower() else "pow(0.7"
    lines = [x for x in plan(d).lower().split("\n") if power in x]
    assert lines and not any("sim#" in x for x in lines)  # worth is summed before edges are met
    got = {(r.user_id, r.article_id): round(r.sim_sum, 9) for r in d.collect()}
    first = 0.5 * (1 + 0.7)
    want = {(1, 20): first, (2, 20): 0.25} if history else {(1, 20): first + 0.7**2 * 0.25 + 0.7**3 * 0.5, (1, 21): 0.7**2, (2, 20): 0.25, (2, 21): 1.0}
    assert got == {k: round(v, 9) for k, v in want.items() if k != (2, 21)}


def test_seeds_are_dealt_by_user_before_they_meet_neighbours(spark, monkeypatch):
    monkeypatch.setattr(rc, "USERS", 3)
    n = 40
    click = spark.createDataFrame([(u, u % 2, u, u) for u in range(n)], "user_id bigint, click_article_id bigint, click_timestamp bigint, event_id bigint")
    query = spark.createDataFrame([(u, -1) for u in range(n)], "user_id bigint, click_article_id bigint")
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "article_id bigint, vec array<double>")
    d = rc.vector_recall_last(vectors, click, query)
    assert "hashpartitioning(user_id#" in plan(d) and "REPARTITION_BY_NUM" in plan(d)
    assert {r.user_id: r.n for r in d.groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {u: 4 for u in range(n)}


def test_the_negatives_of_all_steps_are_one_draw(spark, monkeypatch):
    click = spark.createDataFrame([(u, (u + k) % 4, k, 10 * u + k) for u in range(6) for k in range(5)], "user_id bigint, click_article_id bigint, click_timestamp bigint, event_id bigint")
    asked, draw = [], tt.negatives.draw
    monkeypatch.setattr(tt.negatives, "draw", lambda s, *given, **named: asked.append(sorted(r.key for r in s.collect())) or draw(s, *given, **named))
    tt.train(click, config.TwoTower(dim=4, hidden=4, length=3, negatives=5, epochs=2, steps=2))
    assert asked == [["0-0", "0-1", "1-0", "1-1"]]
