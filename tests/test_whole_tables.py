"""Queries that work on whole tables, and made-up gaps and cold users for their operators."""

import duckdb
import pytest

from newsloom.operators import ranking, recall
from newsloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["submission_top5", "cold_user_fallback"])
def test_registered_on_the_whole_table(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("events", "embeddings", "documents", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def clicks(spark, pairs):
    return spark.createDataFrame(pairs, "user_id bigint, click_article_id bigint")


def test_submission_fills_gaps_with_popular_articles(spark):
    click = clicks(spark, [(9, a) for a in range(1, 8) for _ in range(20 - a)])  # 1 is the most popular
    pred = spark.createDataFrame([(1, 50, 0.1), (1, 2, 0.9), *[(2, a, a / 100) for a in range(30, 40)], (3, 60, 1.0)], "user_id bigint, article_id bigint, pred double")
    users = spark.createDataFrame([(1,), (2,), (4,)], "user_id bigint")
    got = {r[0]: tuple(r[1:]) for r in ranking.submission(pred, users, click).collect()}
    assert got == {1: (2, 50, 1, 3, 4), 2: (39, 38, 37, 36, 35), 4: (1, 2, 3, 4, 5)}


def test_cold_users_get_popular_articles(spark):
    click = clicks(spark, [(1, 7), (1, 8), (2, 8), (7, 9), (7, 9), (7, 9)])
    query = spark.createDataFrame([(1, -1), (5, 3), (14, -1)], "user_id bigint, click_article_id bigint")
    got = sorted((r.user_id, r.article_id, round(r.sim_score, 6)) for r in recall.cold_fallback(click, query, 2).collect())
    assert got == [(u, a, s) for u in (5, 14) for a, s in ((8, 0.99), (9, 1.0))]
