"""What the learned queries are given."""

import pytest
from pyspark.sql import functions as F

from newsloom import config
from newsloom.plans import queries

SF = "/root/testdata/sf0.001"


def scores(frame):
    return {(r.user_id, r.article_id): r.sim_score for r in frame.collect()}


@pytest.fixture
def store(spark, tmp_path):
    spark.conf.set("spark.newsloom.store", str(tmp_path / "store"))
    yield
    spark.conf.unset("spark.newsloom.store")


def test_every_fifth_channel_counts(spark, store):
    t = queries.Tables(spark, SF)
    user, known = t.query.first()["user_id"], 10**9
    learned = spark.createDataFrame([(user, known, 3.0, None)], "user_id bigint, article_id bigint, sim_score double, label int")
    stage = t.run.table("made_up", lambda: learned)
    for name in ("itemcf_s", "w2v_s", "swing_c_s", "cold_s"):
        setattr(t, name, t.run.table("nothing", lambda: learned.limit(0)))
    got = scores(t.fused_of(stage).df)
    assert list(got) == [(user, known)] and abs(got[user, known] - 0.01 * (1 + config.EPS)) < 1e-9


def test_ranker_learns_from_the_whole_feature_table(spark, store):
    t = queries.Tables(spark, SF)
    rows = t.features_of(t.fused_of(t.unseen_s), kept=True).df
    table = queries.queries()["feature_v3"](spark, SF)
    cols = queries.learned_from(rows)
    assert cols == sorted(set(table.columns) - {"label"}) and len(cols) == 32
    positives = {r.user_id: r.pos for r in rows.groupBy("user_id").agg(F.sum("label").alias("pos")).collect()}
    assert positives and set(positives.values()) <= {None, 1}


def test_item_vectors_have_the_default_size(spark):
    assert {len(r.vec) for r in queries.queries()["item2vec_train"](spark, SF).collect()} == {256}


def test_a_trained_state_is_read_and_not_trained_again(spark, store, monkeypatch):
    small = config.Settings().set("two_tower.epochs=1", "two_tower.negatives=64", "lambda_rank.trees=3", "lambda_rank.folds=3", "item2vec.dim=8")
    first = queries.Tables(spark, SF, small)
    want = scores(first.two_tower_c())
    ranker, oof, rows = first.ranker_of(first.two_tower_c_s)
    assert {"two_tower", "youtubednn", "lambda_ranker"} <= set(first.run.built) and len(ranker.folds) == 3 and all(ranker.folds)
    for module, name in ((queries.tt, "train"), (queries.lr.LambdaRanker, "fit_oof"), (queries.sm, "itemcf_edges"), (queries.sm, "swing_edges"), (queries.sm, "knn_edges")):
        monkeypatch.setattr(module, name, lambda *_: pytest.fail("made again"))
    again = queries.Tables(spark, SF, small)
    assert scores(again.two_tower_c()) == want
    _, oof_again, rows_again = again.ranker_of(again.two_tower_c_s)
    assert not again.run.built and oof_again.count() == oof.count() and rows_again.count() == rows.count() > 0
    key = lambda d: {(r.user_id, r.article_id): r.pred for r in d.collect()}
    assert key(again.ranker_of(again.two_tower_c_s)[0].predict(rows_again)) == pytest.approx(key(ranker.predict(rows)))
    # other parameters are another state
    with pytest.raises(pytest.fail.Exception):
        queries.Tables(spark, SF, small.set("two_tower.rate=0.01")).two_tower_c()
