"""Registry of the recommendation queries: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config, sources
from ..operators import features as ft, ids, item2vec as i2v, lambdarank as lr, negatives, ranking, recall as rc, similarity as sm, split as sp, twotower as tt
from ..operators.folds import group_kfold
from ..stages import Input, Stage, Stages
from .sql import oracle

class Tables:
    """Inputs and stored stages of one data directory. ``graphs``: paths of stored similarity tables (itemcf, swing, knn) to read in place of building them."""

    def __init__(self, spark: SparkSession, sf_dir: str, p: config.Settings = config.Settings(), online: bool = False, graphs: dict[str, str] | None = None):
        self.spark, self.dir, self.p, self.online, self.graphs = spark, sf_dir.rstrip("/"), p, online, graphs or {}
        self.run = Stages(spark)

    def _given(self, name: str) -> Input:
        path = f"{self.dir}/{name}.parquet"
        return self.run.given(path, lambda: self.spark.read.parquet(path))

    @cached_property
    def all_clicks(self) -> DataFrame:
        return sources.clicks(self.spark, self.dir)

    @cached_property
    def given_articles(self) -> DataFrame:
        return sources.articles(self.spark, self.dir)

    @cached_property
    def vectors(self) -> DataFrame:
        return sources.vectors(self.spark, self.dir)

    # stages

    def _users(self, name: str, make, *inputs, params=(), required: bool = False) -> Stage:
        """A stage of rows of users."""
        return self.run.table(name, make, *inputs, params=params, bucket="user_id", required=required)

    @cached_property
    def click_s(self) -> Stage:
        made = lambda: sp.sequence(sp.split(self.all_clicks, self.online)[0])
        return self.run.table("click", made, self._given("events"), params=(self.online,), bucket="user_id", sort=("pos",), required=True)

    @cached_property
    def query_s(self) -> Stage:
        return self._users("query", lambda: sp.split(self.all_clicks, self.online)[1], self._given("events"), params=(self.online,), required=True)

    @cached_property
    def articles_s(self) -> Stage:
        return self.run.table("articles", lambda: self.given_articles, *map(self._given, ("embeddings", "documents", "orders")), required=True)

    def _graph(self, name: str, make, *inputs, params=()) -> Stage:
        if name in self.graphs:
            path = self.graphs[name]
            given = self.run.given(path, lambda: sources.read_edges(self.spark, path))
            make, inputs, params = lambda: given.df, (given,), ()
        return self.run.table(f"{name}_edges", make, *inputs, params=params, bucket="item_i", sort=("item_j",))

    @cached_property
    def cf_s(self) -> Stage:
        return self._graph("itemcf", lambda: sm.itemcf_edges(self.click, self.p.itemcf), self.click_s, params=self.p.itemcf)

    @cached_property
    def swing_s(self) -> Stage:
        return self._graph("swing", lambda: sm.swing_edges(self.click, self.p.swing), self.click_s, params=self.p.swing)

    @cached_property
    def knn_s(self) -> Stage:
        return self._graph("knn", lambda: sm.knn_edges(self.vectors, config.EMB_TOP), self._given("embeddings"), params=config.EMB_TOP)

    @cached_property
    def knn_clicked_s(self) -> Stage:
        """The neighbours of clicked articles: recall and features look up no others."""
        if "knn" in self.graphs:
            return self.knn_s
        made = lambda: sm.knn_edges(self.vectors, config.EMB_TOP, self.click.select(F.col("click_article_id").alias("article_id")))
        return self._graph("knn", made, self._given("embeddings"), self.click_s, params=config.EMB_TOP)

    def _seeded(self, edges: Stage, p: config.ItemCf | config.Swing) -> DataFrame:
        return rc.seeded_recall(edges.df, self.click, self.query, p.seeds, p.top_m, p.seed_decay, p.k)

    @cached_property
    def itemcf_s(self) -> Stage:
        return self._users("itemcf", lambda: self._seeded(self.cf_s, self.p.itemcf), self.cf_s, self.click_s, self.query_s, params=self.p.itemcf)

    @cached_property
    def swing_c_s(self) -> Stage:
        return self._users("swing", lambda: self._seeded(self.swing_s, self.p.swing), self.swing_s, self.click_s, self.query_s, params=self.p.swing)

    @cached_property
    def w2v_s(self) -> Stage:
        return self._users("w2v", lambda: rc.vector_recall_last(self.vectors, self.click, self.query), self._given("embeddings"), self.click_s, self.query_s)

    @cached_property
    def cold_s(self) -> Stage:
        made = lambda: rc.cold_recall(self.knn_clicked, self.click, self.query, self.articles, self.p.cold)
        return self._users("cold_start", made, self.knn_clicked_s, self.click_s, self.query_s, self.articles_s, params=self.p.cold)

    @cached_property
    def unseen_s(self) -> Stage:
        return self._users("unseen", lambda: rc.vector_recall_unseen(self.vectors, self.click, self.query), self._given("embeddings"), self.click_s, self.query_s)

    @cached_property
    def item2vec_s(self) -> Stage:
        return self.run.table("item2vec", lambda: i2v.train(self.click, self.p.item2vec), self.click_s, params=self.p.item2vec)

    @cached_property
    def als_s(self) -> Stage:
        return self._users("als", lambda: ranking.als_recall(self.click, self.query), self.click_s, self.query_s)

    @cached_property
    def two_tower_s(self) -> Stage:
        """The trained state, by the clicks and parameters that it came from."""
        return self.run.table("two_tower", lambda: tt.train(self.click, self.p.two_tower), self.click_s, params=self.p.two_tower)

    @cached_property
    def two_tower_c_s(self) -> Stage:
        made = lambda: tt.recall_from(self.two_tower_s.df, self.click, self.query, self.p.two_tower)
        return self._users("youtubednn", made, self.two_tower_s, self.click_s, self.query_s, params=self.p.two_tower)

    def fused_of(self, fifth: Stage) -> Stage:
        """All five channels with ``fifth`` as the last one."""
        parts = {"itemcf": self.itemcf_s, "w2v": self.w2v_s, "swing": self.swing_c_s, "cold_start": self.cold_s, "youtubednn": fifth}
        return self._users("fused", lambda: rc.fuse({k: s.df for k, s in parts.items()}, self.p.fusion), *parts.values(), params=self.p.fusion)

    def features_of(self, cand: Stage, kept: bool = False) -> Stage:
        """The feature table of fused candidates; ``kept``: only of users that the ranker can use."""
        made = lambda: ft.feature_v3(rc.keep_users(cand.df) if kept else cand.df, self.click, self.articles, self.cf, self.swing, self.knn_clicked, self.vectors)
        return self._users("features", made, cand, self.click_s, self.articles_s, self.cf_s, self.swing_s, self.knn_clicked_s, self._given("embeddings"), params=kept)

    def ranker_of(self, fifth: Stage) -> tuple[lr.LambdaRanker, DataFrame, DataFrame]:
        """(trained ranker, out-of-fold predictions, open rows); trained once for the same rows and parameters."""
        rows = self.features_of(self.fused_of(fifth), kept=True)

        def write(path: str) -> None:
            ranker = lr.LambdaRanker(learned_from(rows.df), self.p.lambda_rank)
            ranker.fit_oof(rows.df.where("label is not null")).write.parquet(f"{path}/oof")
            ranker.save(self.spark, path)

        path, _ = self.run.folder("lambda_ranker", write, rows, params=self.p.lambda_rank)
        return lr.LambdaRanker.load(self.spark, path, self.p.lambda_rank), self.spark.read.parquet(f"{path}/oof"), rows.df.where("label is null")

    # their tables

    click, query, articles = (cached_property(lambda self, s=s: getattr(self, s).df) for s in ("click_s", "query_s", "articles_s"))
    cf, swing, knn, knn_clicked = (cached_property(lambda self, s=s: getattr(self, s).df) for s in ("cf_s", "swing_s", "knn_s", "knn_clicked_s"))

    def itemcf_c(self):
        return self.itemcf_s.df

    def swing_c(self):
        return self.swing_c_s.df

    def coarse(self):
        p = self.p.cold
        return rc.seeded_recall(self.knn_clicked, self.click, self.query, p.seeds, p.top_m, p.seed_decay, p.raw_k, "none")

    def w2v_c(self):
        return self.w2v_s.df

    def cold_c(self):
        return self.cold_s.df

    def unseen_c(self):
        return self.unseen_s.df

    def channels(self):
        return {"itemcf": self.itemcf_c(), "w2v": self.w2v_c(), "swing": self.swing_c(), "cold_start": self.cold_c(), "youtubednn": self.unseen_c()}

    def fused(self):
        """All five channels; the user vectors of the fifth are means of given vectors, which SQL can follow."""
        return self.fused_of(self.unseen_s).df

    def two_tower_c(self):
        return self.two_tower_c_s.df

    def texts(self):
        return self.spark.read.parquet(f"{self.dir}/documents.parquet")

    def pred(self):
        """A stand-in prediction for the ranking glue."""
        return self.fused().select("user_id", "article_id", F.col("sim_score").alias("pred"))


def _cand(d: DataFrame) -> DataFrame:
    return d.select("user_id", "article_id", F.round("sim_score", 6).alias("sim_score"), "label")


def _edges(d: DataFrame) -> DataFrame:
    return d.select("item_i", "item_j", F.round("sim", 6).alias("sim"))


def _eval(d: DataFrame) -> DataFrame:
    return d.select("k", F.round("hr", 6).alias("hr"), F.round("mrr", 6).alias("mrr"))


C = "select user_id, article_id, round(sim_score, 6) as sim_score, label from {}"
E = "select i as item_i, j as item_j, round(sim, 6) as sim from {}"
EV = """select k, round(coalesce(sum(case when r < k then 1e0 end), 0e0) / (select count(distinct user_id) from query where target <> -1), 6) as hr,
  round(coalesce(sum(case when r < k then 1e0 / (r + 1) end), 0e0) / (select count(distinct user_id) from query where target <> -1), 6) as mrr
from (select unnest([5, 10, 20, 40, 50]) as k) left join
  (select user_id, min(r) as r from (select *, row_number() over (partition by user_id order by round(sim_score, 9) desc, article_id) - 1 as r from {} where label is not null) where label = 1 group by 1) on true group by k"""


def _rounded(d: DataFrame, digits: int = 5) -> DataFrame:
    return d.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


STATS = {
    "user_id_click_article_created_at_ts_diff_mean": "dcm", "user_id_click_diff_mean": "dsm", "user_click_datetime_hour_mean": "hm", "user_click_datetime_hour_std": "hs",
    "user_click_timestamp_created_at_ts_diff_mean": "scm", "user_click_timestamp_created_at_ts_diff_std": "scs", "user_clicked_article_words_count_mean": "wm",
}
LASTS = {"user_clicked_article_created_time_max": "crx", "user_click_last_article_words_count": "lw", "user_click_last_article_created_time": "lcr", "user_click_last_article_click_time": "lsec", "user_clicked_category_nunique": "nc"}
STAT_SQL = ", ".join([f"round({v}, 5) as {k}" for k, v in STATS.items()] + [f"{v} as {k}" for k, v in LASTS.items()])
BASE_MEANS = {"created_diff_mean": "dcm", "click_diff_mean": "dfm", "click_created_diff_mean": "scm", "click_created_diff_std": "scs", "hour_std": "hs", "words_mean": "wm", "click_mean": "cm"}
BASE_LASTS = {"last_words": "lw", "last_created": "lcr", "created_max": "crx", "last_click": "lsec"}
BASE_SQL = ", ".join([f"round({v}, 5) as {k}" for k, v in BASE_MEANS.items()] + [f"{v} as {k}" for k, v in BASE_LASTS.items()])
COUNT_SQL = "cast(user_id_cnt as bigint) as user_id_cnt, article_id_cnt, cast(category_click_cnt as bigint) as category_click_cnt, user_id_category_id_cnt"
LAST_JOIN = "left join (select user_id, item as li from seq where loc = 0) using (user_id) left join cf e1 on e1.i = li and e1.j = cc.article_id left join sw e2 on e2.i = li and e2.j = cc.article_id left join knn e3 on e3.i = li and e3.j = cc.article_id"
SIM_SQL = "round(coalesce(e1.sim, 0e0), 5) as user_last_click_article_itemcf_sim, round(coalesce(e2.sim, 0e0), 5) as user_last_click_article_swing_sim, round(coalesce(e3.sim, 0e0), 5) as user_last_click_article_emb_i2i_sim"
DIFF_SQL = "created // 1000 - lcr as user_last_click_created_at_ts_diff, created // 1000 - lsec as user_last_click_timestamp_diff, words - lw as user_last_click_words_count_diff, coalesce(cast(cat = lcat as integer), 0) as same_as_last_category"


def learned_from(rows: DataFrame) -> list[str]:
    """The columns of a feature table that a ranker learns from, sorted."""
    return sorted(c for c in rows.columns if c not in ("label", "created_at_datetime"))


def _gbt(t: Tables) -> tuple[ranking.Ranker, DataFrame, DataFrame]:
    rows = t.features_of(t.fused_of(t.als_s), kept=True).df
    cols = learned_from(rows)
    ranker, rows = ranking.Ranker(cols), rows.select("label", *cols)
    return ranker, ranker.fit_oof(rows.where("label is not null")), rows.where("label is null")


def _lambda_online(t: Tables) -> DataFrame:
    """Open rows scored by the stored models of all folds."""
    ranker, _, rows = t.ranker_of(t.two_tower_c_s)
    return ranker.predict(rows)


def _negatives(t: Tables) -> DataFrame:
    s = tt.model_input(t.click, 30).select(F.concat_ws(":", "user_id", "pos").alias("key"), "target")
    return negatives.draw(s, t.click, 10).withColumn("slot", F.col("slot").cast("bigint"))


def _two_runs_of_ids(t: Tables) -> DataFrame:
    """Codes of the users of the training clicks, then of all clicks: the first ones keep theirs."""
    train = t.all_clicks.where("user_id % 5 <> 0")
    known = ids.fresh_codes(None, train, "user_id")
    return known.unionByName(ids.fresh_codes(known, t.all_clicks, "user_id"))


def _last_sims(t: Tables) -> DataFrame:
    d = t.fused().select("user_id", "article_id")
    for name, e in (("itemcf", t.cf), ("swing", t.swing), ("emb_i2i", t.knn_clicked)):
        d = ft.last_sim(d, t.click, e, f"user_last_click_article_{name}_sim")
    return _rounded(d)


def _last_diff(t: Tables) -> DataFrame:
    d = t.fused().join(t.articles, "article_id", "left").join(ft.user_stats(t.click, t.articles), "user_id", "left")
    return ft.with_last_diffs(d)


PERCENTILES = (10, 25, 50, 75, 90, 95, 99)
DIFFS = ["user_last_click_created_at_ts_diff", "user_last_click_timestamp_diff", "user_last_click_words_count_diff"]

REGISTRY: dict[str, tuple] = {
    "clicks_view": (lambda t: t.all_clicks, oracle("select user_id, item as click_article_id, t as click_timestamp, event_id from clicks")),
    "articles_view": (lambda t: t.given_articles, oracle("select item as article_id, cat as category_id, created as created_at_ts, words as words_count from arts")),
    "split_train": (lambda t: sp.split(t.all_clicks)[0], oracle("select user_id, item as click_article_id, t as click_timestamp, event_id from click")),
    "split_query": (lambda t: sp.split(t.all_clicks)[1], oracle("select user_id, target as click_article_id from query")),
    "query_sentinel": (lambda t: sp.split(t.all_clicks, online=True)[1], oracle("select distinct user_id, cast(-1 as bigint) as click_article_id from clicks where user_id % 5 = 0")),
    "user_sample": (lambda t: sp.sample_users(t.all_clicks, 10), oracle("select user_id from (select distinct user_id from clicks) order by md5(concat_ws('-', user_id, 2020)) limit 10")),
    "user_sequence": (lambda t: sp.sequence(t.click).select("user_id", "click_article_id", "pos", "loc", "n_clicks"), oracle("select user_id, item as click_article_id, pos, loc, n as n_clicks from seq")),
    "recent_n_items": (lambda t: sp.recent(t.click, 20), oracle("select user_id, loc, item from seq where loc < 20")),
    "seed_decay": (lambda t: sp.recent(t.click, 2).withColumn("weight", F.round(F.pow(F.lit(0.7), F.col("loc")), 6)), oracle("select user_id, loc, item, round(power(0.7e0, loc), 6) as weight from seq where loc < 2")),
    "prefix_history": (
        lambda t: sp.prefix_samples(t.click).select("user_id", "pos", "target", "is_test", F.size("hist").cast("bigint").alias("hist_len"), F.element_at("hist", 1).alias("newest")),
        oracle("select user_id, pos, item as target, cast(loc = 0 as integer) as is_test, pos as hist_len, lag(item) over (partition by user_id order by pos) as newest from seq qualify pos > 0 union all select user_id, 0, item, unnest([0, 1]), 1, item from seq where n = 1")),
    "pad_sequence": (
        lambda t: sp.recent(t.click, 30).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("loc", "item"))), lambda s: s["item"] + 1).alias("h")).select("user_id", F.posexplode(sp.padded(F.col("h"), 30)).alias("at", "item")).withColumn("at", F.col("at").cast("bigint")),
        oracle("select u.user_id, g.at, coalesce(seq.item + 1, 0) as item from (select distinct user_id from click) u cross join (select unnest(range(0, 30)) as at) g left join seq on seq.user_id = u.user_id and seq.loc = g.at")),
    "item_inverted_index": (lambda t: t.click.groupBy(F.col("click_article_id").alias("item")).agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("clicks")), oracle("select item, count(distinct user_id) as users, count(*) as clicks from click group by item")),
    "ordinal_encode": (lambda t: sp.ordinal(t.click, "click_article_id"), oracle("select item as click_article_id, dense_rank() over (order by item) as code from (select distinct item from click)")),
    "id_dictionary": (_two_runs_of_ids, oracle("select user_id as value, row_number() over (order by user_id % 5 = 0, user_id) as code from (select distinct user_id from clicks)")),
    "itemcf_sim": (lambda t: _edges(t.cf), oracle(E.format("cf"))),
    "itemcf_topn": (lambda t: sm.top_edges(t.cf, 20).select("item_i", "item_j", F.col("rank").cast("bigint").alias("rank")), oracle("select i as item_i, j as item_j, rank from (select i, j, row_number() over (partition by i order by round(sim, 9) desc, j) as rank from cf) where rank <= 20")),
    "itemcf_recall": (lambda t: _cand(t.itemcf_c()), oracle(C.format("itemcf_c"))),
    "itemcf_recall_small": (lambda t: _cand(rc.seeded_recall(t.cf, t.click, t.query, 2, 20, 0.7, 10, "history")), oracle(C.format("(@seeded(cf,2,20,10,none))").replace("@seeded(cf,2,20,10,none)", "select user_id, article_id, sim_score, label from (select d.user_id, d.article_id, d.sim_score, case when target <> -1 then cast(d.article_id = target as integer) end as label, row_number() over (partition by d.user_id order by round(d.sim_score, 9) desc, d.article_id) as rk from (select s.user_id, e.j as article_id, sum(power(0.7e0, s.loc) * e.sim) as sim_score from seq s join (select *, row_number() over (partition by i order by round(sim, 9) desc, j) as rn from cf) e on e.i = s.item and rn <= 20 where s.loc < 2 group by 1, 2) d join query using (user_id) where not exists (select 1 from click z where z.user_id = d.user_id and z.item = d.article_id)) where rk <= 10"))),
    "eval_itemcf": (lambda t: _eval(rc.evaluate(t.itemcf_c(), t.query)), oracle(EV.format("itemcf_c"))),
    "popular_topk": (lambda t: rc.popular(t.click, 50), oracle("select item as article_id, count(*) as clicks from click group by item order by clicks desc, item limit 50")),
    "swing_user_pairs": (lambda t: sm.swing_user_pairs(t.click).select("u", "v", F.round("w", 9).alias("w"), "n_common"), oracle("select u, v, round(w, 9) as w, c as n_common from sw_pairs")),
    "swing_sim": (lambda t: _edges(t.swing), oracle(E.format("sw"))),
    "swing_recall": (lambda t: _cand(t.swing_c()), oracle(C.format("swing_c"))),
    "eval_swing": (lambda t: _eval(rc.evaluate(t.swing_c(), t.query)), oracle(EV.format("swing_c"))),
    "l2_normalize": (lambda t: t.vectors.select("article_id", F.posexplode(sm.normalized(F.col("vec"))).alias("dim", "x")).select("article_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 9).alias("x")), oracle("select item as article_id, unnest(range(0, len(v))) as dim, round(unnest(list_transform(v, lambda x: x / norm)), 9) as x from vecs")),
    "emb_i2i_sim": (lambda t: t.knn, oracle("select i as item_i, j as item_j, sim from knn")),
    "vector_recall_last": (lambda t: _cand(t.w2v_c()), oracle(C.format("w2v_c"))),
    "vector_recall_unseen": (lambda t: t.unseen_c(), oracle("select user_id, article_id, sim_score, label from unseen_c")),
    "user_profile": (lambda t: rc.user_profile(t.click, t.articles).select("user_id", F.size("cats").cast("bigint").alias("n_cats"), F.round("mean_words", 5).alias("mean_words"), "last_created"), oracle("select user_id, cast(coalesce(len(cats), 0) as bigint) as n_cats, round(mw, 5) as mean_words, lc as last_created from prof")),
    "cold_coarse": (lambda t: _cand(t.coarse()), oracle(C.format("coarse"))),
    "cold_soft_score": (lambda t: _cand(rc.soft_scored(t.coarse(), t.click, t.articles)), oracle(C.format("soft"))),
    "cold_recall": (lambda t: _cand(t.cold_c()), oracle(C.format("cold_c"))),
    "minmax_channel": (lambda t: _cand(rc.minmax(t.itemcf_c())), oracle("select user_id, article_id, round(s, 6) as sim_score, label from (@mm(itemcf_c,1.0))")),
    "fuse_recall": (lambda t: _cand(t.fused()), oracle(C.format("fused"))),
    "user_filter": (lambda t: _cand(rc.keep_users(t.fused())), oracle(C.format("fused") + " where user_id in (select user_id from fused group by 1 having count(*) filter (label is null) > 0 or sum(label) = 1)")),
    "eval_fused": (lambda t: _eval(rc.evaluate(t.fused(), t.query)), oracle(EV.format("fused"))),
    "recall_overlap": (lambda t: rc.overlap(t.itemcf_c(), t.swing_c()).select(F.round("overlap", 6).alias("overlap")), oracle("select round(count(b.user_id) / count(*), 6) as overlap from itemcf_c a left join (select distinct user_id, article_id from swing_c) b using (user_id, article_id)")),
    "recall_count_percentiles": (lambda t: t.fused().groupBy("user_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), *[F.expr(f"percentile(n, {p / 100})").alias(f"p{p}") for p in PERCENTILES]), oracle("select cast(min(n) as bigint) as least, cast(max(n) as bigint) as most, round(avg(n), 6) as mean, median(n) as median, " + ", ".join(f"quantile_cont(n, {p / 100}e0) as p{p}" for p in PERCENTILES) + " from (select user_id, cast(count(*) as double) as n from fused group by 1)")),
    "label_distribution": (lambda t: t.fused().where("label is not null").groupBy("label").count().withColumnRenamed("count", "n"), oracle("select label, count(*) as n from fused where label is not null group by label")),
    "group_sizes": (lambda t: t.fused().groupBy("user_id").agg(F.count("*").alias("n")), oracle("select user_id, count(*) as n from fused group by 1")),
    "cold_user_fallback": (lambda t: rc.cold_fallback(t.click, sources.customers(t.spark, t.dir), 50).withColumn("sim_score", F.round("sim_score", 6)), oracle("select user_id, article_id, round(1e0 - rn * 0.01e0, 6) as sim_score from (select distinct c_custkey as user_id from customer where c_custkey not in (select user_id from click)) cross join (select item as article_id, row_number() over (order by count(*) desc, item) - 1 as rn from click group by item order by count(*) desc, item limit 50)")),
    "feat_article_meta": (lambda t: t.articles.select("article_id", "category_id", "words_count", F.floor(F.col("created_at_ts") / 1000).alias("created_at_ts"), F.timestamp_seconds(F.floor(F.col("created_at_ts") / 1000)).cast("timestamp_ntz").alias("created_at_datetime")), oracle("select item as article_id, cat as category_id, words as words_count, created // 1000 as created_at_ts, make_timestamp(created // 1000 * 1000000) as created_at_datetime from arts")),
    "feat_user_stats_v3": (lambda t: _rounded(ft.user_stats(t.click, t.articles).drop("last_category")), oracle(f"select user_id, {STAT_SQL} from us")),
    "feat_user_stats_baseline": (lambda t: _rounded(ft.user_stats_baseline(t.click, t.articles)), oracle(f"select user_id, {BASE_SQL} from usb")),
    "feat_last_diff": (lambda t: _last_diff(t).select("user_id", "article_id", *DIFFS), oracle("select user_id, article_id, " + DIFF_SQL.rsplit(", coalesce", 1)[0] + " from cc left join us using (user_id)")),
    "feat_same_category": (lambda t: _last_diff(t).select("user_id", "article_id", "same_as_last_category"), oracle("select user_id, article_id, coalesce" + DIFF_SQL.rsplit(", coalesce", 1)[1] + " from cc left join us using (user_id)")),
    "feat_counts": (lambda t: ft.counts(t.fused().select("user_id", "article_id"), t.click, t.articles).drop("category_id"), oracle(f"select user_id, article_id, {COUNT_SQL} from cc")),
    "feat_itemcf_sum": (lambda t: _rounded(ft.decayed_sum(t.fused(), t.click, t.cf)), oracle("select user_id, article_id, round(s, 5) as sim_sum from cfsum")),
    "feat_last_sims": (_last_sims, oracle(f"select user_id, article_id, {SIM_SQL} from cc {LAST_JOIN}")),
    "feat_w2v_sims": (lambda t: _rounded(ft.vector_sims(t.fused().select("user_id", "article_id"), t.click, t.vectors)), oracle("select user_id, article_id, round(coalesce(l, 0e0), 5) as user_last_click_article_w2v_sim, round(coalesce(s, 0e0), 5) as user_click_article_w2w_sim_sum_2 from fused left join w2s using (user_id, article_id)")),
    "feature_v3": (
        lambda t: _rounded(t.features_of(t.fused_of(t.unseen_s)).df).drop("created_at_datetime"),
        oracle(f"select user_id, article_id, round(sim_score, 5) as sim_score, label, cat as category_id, words as words_count, created // 1000 as created_at_ts, {COUNT_SQL}, {STAT_SQL}, {DIFF_SQL}, round(coalesce(cfsum.s, 0e0), 5) as user_clicked_article_itemcf_sim_sum, {SIM_SQL}, round(coalesce(w2s.l, 0e0), 5) as user_last_click_article_w2v_sim, round(coalesce(w2s.s, 0e0), 5) as user_click_article_w2w_sim_sum_2 from cc left join us using (user_id) left join cfsum using (user_id, article_id) left join w2s using (user_id, article_id) {LAST_JOIN}")),
    "feature_baseline": (
        lambda t: _rounded(ft.feature_baseline(t.fused(), t.click, t.articles, t.cf)),
        oracle(f"select user_id, article_id, round(sim_score, 5) as sim_score, label, cat as category_id, words as words_count, created as created_at_ts, user_id_cnt, article_id_cnt, user_id_category_id_cnt, {BASE_SQL}, created // 1000 - lcr as last_created_diff, created // 1000 - lsec as last_click_diff, words - lw as last_words_diff, round(coalesce(s, 0e0), 5) as itemcf_sum, round(coalesce(e1.sim, 0e0), 5) as itemcf_last from cc left join usb using (user_id) left join cfall using (user_id, article_id) left join (select user_id, item as li from seq where loc = 0) using (user_id) left join cf e1 on e1.i = li and e1.j = cc.article_id")),
    "memory_profile": (
        lambda t: ft.column_profile(t.articles, ["article_id", "category_id", "words_count", "created_at_ts"]),
        oracle("select c as \"column\", lo, hi, case when lo > -128 and hi < 127 then 'int8' when lo > -32768 and hi < 32767 then 'int16' when lo > -2147483648 and hi < 2147483647 then 'int32' else 'int64' end as type from (" + " union all ".join(f"select '{c}' as c, min({k}) as lo, max({k}) as hi from arts" for c, k in (("article_id", "item"), ("category_id", "cat"), ("words_count", "words"), ("created_at_ts", "created"))) + ")")),
    "group_kfold": (
        lambda t: group_kfold(t.fused().where("label is not null")).select("user_id", "article_id", "fold"),
        oracle("""select user_id, article_id, fold from fused join (
          with recursive g as (select user_id, n, row_number() over (order by n desc, md5(cast(user_id as varchar)), user_id) as r from (select user_id, count(*) as n from fused where label is not null group by 1)),
            d as (select cast(0 as bigint) as r, cast([0, 0, 0, 0, 0] as bigint[]) as loads, cast(null as bigint) as user_id, cast(null as integer) as fold
              union all select g.r, list_transform(range(1, 6), lambda k: d.loads[k] + case when k = list_position(d.loads, list_min(d.loads)) then g.n else 0 end), g.user_id, cast(list_position(d.loads, list_min(d.loads)) - 1 as integer) from d join g on g.r = d.r + 1)
          select user_id, fold from d where r > 0) using (user_id) where label is not null""")),
    "oof_mean": (lambda t: ranking.fold_mean([t.pred().withColumn("pred", F.col("pred") * k) for k in range(1, 6)]).withColumn("pred", F.round("pred", 6)), oracle("select user_id, article_id, round(3e0 * sim_score, 6) as pred from fused")),
    "submission_top5": (
        lambda t: ranking.submission(t.pred(), t.query.where("click_article_id = -1"), t.click),
        oracle("select user_id, " + ", ".join(f"max(article_id) filter (rn = {i}) as article_{i}" for i in range(1, 6)) + """ from (select *, row_number() over (partition by user_id order by src, round(s, 9) desc, article_id) as rn from (
          select user_id, article_id, s, src from (select user_id, article_id, sim_score as s, 0 as src, row_number() over (partition by user_id order by round(sim_score, 9) desc, article_id) as r0 from fused) where r0 <= 5 and user_id in (select user_id from query where target = -1)
          union all select q.user_id, p.item, p.n, 1 from (select distinct user_id from query where target = -1) q cross join (select item, cast(count(*) as double) as n from click group by item order by n desc, item limit 10) p
            where not exists (select 1 from (select user_id, article_id, row_number() over (partition by user_id order by round(sim_score, 9) desc, article_id) as r0 from fused) o where o.r0 <= 5 and o.user_id = q.user_id and o.article_id = p.item))) group by user_id""")),
    "neg_sampling_prob": (lambda t: _rounded(ranking.negative_sampling_prob(t.click), 9), oracle("select item as article_id, round(p, 9) as p, round(ln(p + 1e-10), 9) as log_q from (select item, power(c, 0.75e0) / sum(power(c, 0.75e0)) over () as p from cnt)")),
    "negative_samples": (_negatives, oracle("""select key, slot, coalesce(d.item, f.item) as article_id from (
        select key, slot, h, n, nth, list_filter(us, lambda u: u < lo or u >= lo + w)[1] as u from (
          select key, slot, lo, w, nth, ng_size.n, ('0x' || substr(md5(concat_ws('-', key, slot, 10, 2020)), 1, 15))::bigint as h,
            list_transform(range(0, 10), lambda a: ('0x' || substr(md5(concat_ws('-', key, slot, a, 2020)), 1, 15))::bigint % total) as us
          from (select concat_ws(':', user_id, pos) as key, item as target, unnest(range(0, 10)) as slot from seq where (pos > 0 and loc > 0) or n = 1) s join ng_line on ng_line.item = s.target cross join ng_size)) q
        left join ng_line d on q.u >= d.lo and q.u < d.lo + d.w left join ng_line f on q.u is null and f.nth = q.h % (q.n - 1) + cast(q.h % (q.n - 1) >= q.nth as bigint) where q.n > 1""")),
    "model_input": (
        lambda t: tt.model_input(t.click, 30).select("user_id", "pos", "target", "hist_len", F.posexplode(sp.padded(F.col("hist"), 30)).alias("at", "item")).where("at < 30").withColumn("at", F.col("at").cast("bigint")).groupBy("user_id", "pos", "target", "hist_len").agg(F.sum(F.col("item") * (F.col("at") + 1)).alias("checksum")),
        oracle("select a.user_id, a.pos, a.item as target, case when a.n = 1 then 1 else least(a.pos, 30) end as hist_len, cast(sum(b.item * (case when a.n = 1 then 1 else a.pos - b.pos end)) as bigint) as checksum from seq a join seq b on a.user_id = b.user_id and (a.n = 1 or (b.pos < a.pos and b.pos >= a.pos - 30)) where (a.pos > 0 and a.loc > 0) or a.n = 1 group by all")),
    "category_codes": (
        lambda t: sp.category_codes(t.texts().select("doc_id", "lang", "source"), ["lang", "source"]),
        "select doc_id, cast(case when lang is null then -1 else (select count(distinct lang) from documents b where b.lang < d.lang) end as integer) as lang, cast(case when source is null then -1 else (select count(distinct source) from documents b where b.source < d.source) end as integer) as source from documents d"),
    "channel_overlap": (
        lambda t: rc.overlaps(t.channels()).withColumn("overlap", F.round("overlap", 6)),
        oracle("select x.a, y.a as b, round((select count(*) from ov o join ov o2 using (user_id, article_id) where o.a = x.a and o2.a = y.a) / x.n, 6) as overlap from (select a, count(*) as n from ov group by a) x, (select distinct a from ov) y where x.a <> y.a")),
    "two_tower_vectors": (lambda t: t.two_tower_s.df.select("kind", "id", "vec"), None),
    "two_tower_recall": (lambda t: t.two_tower_c(), None),
    "lambda_rank": (lambda t: t.ranker_of(t.two_tower_c_s)[1], None),
    "lambda_online": (_lambda_online, None),
    "lambda_importance": (lambda t: t.ranker_of(t.two_tower_c_s)[0].importance(t.spark), None),
    "item2vec_train": (lambda t: t.item2vec_s.df, None),
    "item2vec_recall": (lambda t: rc.vector_recall_last(t.item2vec_s.df, t.click, t.query), None),
    "als_recall": (lambda t: t.als_s.df, None),
    "gbt_rank": (lambda t: _gbt(t)[1], None),
    "gbt_online": (lambda t: (lambda g: g[0].predict(g[2]))(_gbt(t)), None),
    "feature_importance": (lambda t: _gbt(t)[0].importance(t.spark), None),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
