"""What is looked up per user leaves candidates where they are; the same results as joins of pairs."""

import re

import pytest
from pyspark.sql import functions as F

from newsloom.operators import features as ft, recall as rc
from newsloom.plans.queries import Tables

PAIRS = re.compile(r"hashpartitioning\(user_id#\d+L?, (article_id|category_id)#")


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small(spark):
    cand = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12)], "user_id bigint, article_id bigint")
    click = spark.createDataFrame([(1, 11, 5, 1), (1, 12, 6, 2), (2, 11, 7, 3), (2, 11, 8, 4)], "user_id bigint, click_article_id bigint, click_timestamp bigint, event_id bigint")
    articles = spark.createDataFrame([(10, 0), (11, 0), (12, None)], "article_id bigint, category_id bigint")
    edges = spark.createDataFrame([(12, 10, 0.5), (11, 10, 0.25), (11, 12, 0.75)], "item_i bigint, item_j bigint, sim double")
    return cand, click, articles, edges


def test_no_exchange_of_pairs(spark, small):
    cand, click, articles, edges = small
    query = cand.select("user_id").distinct().withColumn("click_article_id", F.lit(-1).cast("bigint"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not PAIRS.search(plan(ft.last_sim(cand, click, edges, "s")))
        assert len(PAIRS.findall(plan(ft.counts(cand, click, articles)))) <= 1  # the clicks', not the candidates'
        assert not PAIRS.search(plan(rc.labelled(rc.top_per_user(cand.withColumn("sim_score", F.lit(1.0)), 1), query)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_values_of_joins(small):
    cand, click, articles, edges = small
    assert {(r.user_id, r.article_id): r.s for r in ft.last_sim(cand, click, edges, "s").collect()} == {(1, 10): 0.5, (1, 11): 0.0, (2, 10): 0.25, (3, 12): 0.0}
    got = ft.counts(cand, click, articles)
    assert got.columns == ["user_id", "category_id", "article_id", "user_id_cnt", "article_id_cnt", "category_click_cnt", "user_id_category_id_cnt"]
    assert {(r.user_id, r.article_id): r[3:] for r in got.collect()} == {(1, 10): (2, None, 3, 1), (1, 11): (2, 3, 3, 1), (2, 10): (2, None, 3, 2), (3, 12): (None, 1, 0, None)}
    over = rc.overlaps({"a": cand, "b": cand.where("user_id = 1").union(cand.where("user_id = 1")), "c": cand.where("user_id = 3")})
    assert {(r.a, r.b): r.overlap for r in over.collect()} == {("a", "b"): 0.5, ("a", "c"): 0.25, ("b", "a"): 1.0, ("b", "c"): 0.0, ("c", "a"): 1.0, ("c", "b"): 0.0}


def test_neighbours_of_clicked_articles_only(spark, tmp_path):
    spark.conf.set("spark.newsloom.store", str(tmp_path))
    try:
        t = Tables(spark, "/root/testdata/sf0.001")
        near = {(r.item_i, r.item_j, r.sim) for r in t.knn_clicked.collect()}
        clicked = t.click.select(F.col("click_article_id").alias("item_i")).distinct()
        assert t.run.built == ["click", "knn_edges"]
        assert near == {(r.item_i, r.item_j, r.sim) for r in t.knn.join(clicked, "item_i", "left_semi").collect()}
        assert len({i for i, _, _ in near}) == clicked.count() < t.vectors.count()
    finally:
        spark.conf.unset("spark.newsloom.store")


def test_mean_vectors_are_gathered_whole(spark):
    """A row a click and not a row a dimension is dealt; unknown values and vectors are left out of the mean, as avg does."""
    vec = {1: [1.0, 2.0, None], 2: [3.0, None, None], 3: None, 4: [], 5: [5.0], 9: [7.0, 7.0, 7.0]}
    vectors = spark.createDataFrame(list(vec.items()), "article_id bigint, vec array<double>")
    history = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 5), (2, 0, 2), (2, 1, 2), (2, 2, 3), (3, 0, 3), (4, 0, 4), (5, 0, 8)], "user_id bigint, loc bigint, item bigint")
    d = rc.mean_vectors(history, vectors)
    assert {r.user_id: r.vec for r in d.collect()} == {1: [3.0, 2.0, None], 2: [3.0, None, None]}
    click = history.select("user_id", F.col("item").alias("click_article_id"), F.col("loc"))
    asked = []
    before = rc.recall_by_vectors
    rc.recall_by_vectors = lambda users, *rest: asked.append(users)
    try:
        rc.vector_recall_unseen(vectors, click, history.select("user_id").distinct())
    finally:
        rc.recall_by_vectors = before
    assert "dim#" not in plan(asked[0])
