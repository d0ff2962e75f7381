"""Recall channels, fusion and evaluation. Candidates are user_id, article_id, sim_score, label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .. import config
from ..storage import stored
from .similarity import knn_edges, nearest, top_edges
from .split import recent, sequence


USERS = 2000  # whose candidates meet in one task


def top_per_user(cand: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("sim_score", 9)), "article_id"))
    return cand.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def by_users(d: DataFrame, query: DataFrame) -> DataFrame:
    """``d`` dealt by user, ``USERS`` of ``query`` to a task: what follows per user then needs no exchange, and a task's rows do not grow with
    the number of users."""
    least = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(max(least, -(-query.count() // USERS)), "user_id")


def labelled(cand: DataFrame, query: DataFrame) -> DataFrame:
    """label: null for the sentinel target, else 1 for the target and 0."""
    t = query.select("user_id", F.col("click_article_id").alias("target"))
    label = F.when(F.col("target") != -1, (F.col("article_id") == F.col("target")).cast("int"))
    return cand.join(t, "user_id").select("user_id", "article_id", "sim_score", label.alias("label"))


def seeded_recall(edges: DataFrame, click: DataFrame, query: DataFrame, seeds: int, top_m: int, decay: float, k: int, exclude: str = "seeds") -> DataFrame:
    """Decayed sum over the neighbours of a user's last clicks; ``exclude``: seeds, history or none."""
    s = by_users(recent(click, seeds).join(query.select("user_id").distinct(), "user_id", "left_semi"), query)
    near = top_edges(edges, top_m).select(F.col("item_i").alias("item"), F.col("item_j").alias("article_id"), "sim")
    d = s.join(near, "item").groupBy("user_id", "article_id").agg(F.sum(F.pow(F.lit(decay), F.col("loc")) * F.col("sim")).alias("sim_score"))
    if exclude == "seeds":  # by the user alone, so that candidates stay where they are
        d = d.join(s.groupBy("user_id").agg(F.collect_set("item").alias("own")), "user_id").where(~F.array_contains("own", F.col("article_id"))).drop("own")
    elif exclude != "none":
        d = d.join(click.select("user_id", F.col("click_article_id").alias("article_id")).distinct(), ["user_id", "article_id"], "left_anti")
    return labelled(top_per_user(d, k), query)


def vector_recall_last(vectors: DataFrame, click: DataFrame, query: DataFrame, fetch: int = config.VECTOR_FETCH, k: int = config.VECTOR_K) -> DataFrame:
    """Neighbours of the last click, the seed left out; users without history are skipped."""
    seed = recent(click, 1).join(query.select("user_id"), "user_id", "left_semi")
    near = stored(knn_edges(vectors, fetch - 1, seed.select(F.col("item").alias("article_id"))), "last-near")
    # dealt by user first: joined by articles, the users of a few popular ones meet in few tasks
    d = by_users(seed, query).join(near.withColumnRenamed("item_i", "item"), "item").select("user_id", F.col("item_j").alias("article_id"), F.col("sim").alias("sim_score"))
    return labelled(top_per_user(d, k), query)


def popular(click: DataFrame, k: int) -> DataFrame:
    return click.groupBy(F.col("click_article_id").alias("article_id")).agg(F.count("*").alias("clicks")).orderBy(F.desc("clicks"), "article_id").limit(k)


def vector_recall_unseen(vectors: DataFrame, click: DataFrame, query: DataFrame, k: int = config.VECTOR_K, over: int = config.OVERFETCH) -> DataFrame:
    """The mean of a user's last 30 vectors as query vector; k + over nearest, clicked ones dropped, first k kept; users without history get popular items."""
    h = recent(click, 30).join(query.select("user_id"), "user_id", "left_semi")
    user = mean_vectors(h, vectors)
    return recall_by_vectors(user, vectors, click, query, k, over)


def mean_vectors(history: DataFrame, vectors: DataFrame) -> DataFrame:
    """user_id, vec: per dimension the mean of the known values over a user's ``history`` (user_id, loc, item). Vectors of clicked articles alone are stored,
    so that where these are few they go to the users, and are joined whole; a user's sums are kept per dimension, no history is gathered."""
    known = vectors.select(F.col("article_id").alias("item"), "vec").where("size(vec) > 0")
    own = stored(known.join(history.select("item").distinct(), "item", "left_semi"), "clicked-vectors")
    longest = own.agg(F.max(F.size("vec"))).first()[0] or 0
    means = F.array(*[F.avg(F.get("vec", F.lit(i))) for i in range(longest)]).cast("array<double>")
    d = history.join(own, "item").groupBy("user_id").agg(means.alias("all"), F.max(F.size("vec")).alias("n"))
    return d.select("user_id", F.slice("all", F.lit(1), F.col("n")).alias("vec"))


def recall_by_vectors(users: DataFrame, vectors: DataFrame, click: DataFrame, query: DataFrame, k: int = config.VECTOR_K, over: int = config.OVERFETCH) -> DataFrame:
    """The k + over articles nearest to each user's vector (user_id, vec), clicked ones dropped, first k kept; users without history get popular items."""
    near = knn_users(users, vectors, k + over)
    seen = click.select("user_id", F.col("click_article_id").alias("article_id")).distinct()
    known = top_per_user(near.join(seen, ["user_id", "article_id"], "left_anti"), k)
    return labelled(known.unionByName(cold_fallback(click, query, k)), query)


def knn_users(users: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k articles nearest to each of ``users`` (user_id, vec)."""
    near = nearest(users.select("user_id", "vec"), vectors, k)
    return near.select(F.col("item_i").alias("user_id"), F.col("item_j").alias("article_id"), F.col("sim").alias("sim_score"))


def cold_fallback(click: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Popular items with scores 1, 0.99, ... for users without history."""
    rank = F.row_number().over(Window.orderBy(F.desc("clicks"), "article_id")) - 1  # k rows
    list_ = popular(click, k).withColumn("rn", rank).select("article_id", (F.lit(1.0) - F.col("rn") * F.lit(0.01)).alias("sim_score"))
    cold = query.select("user_id").distinct().join(click.select("user_id").distinct(), "user_id", "left_anti")
    return cold.crossJoin(F.broadcast(list_)).select("user_id", "article_id", "sim_score")


def user_profile(click: DataFrame, articles: DataFrame, history: int = config.ColdStart.history) -> DataFrame:
    """Over the last clicks: categories, mean words, creation time of the newest known article."""
    h = recent(click, history).join(articles.withColumnRenamed("article_id", "item"), "item", "left")
    # a known article without words or creation time has 0
    known = lambda c: F.when(F.col("category_id").isNotNull(), F.coalesce(c, F.lit(0)))
    created = known("created_at_ts")
    return h.groupBy("user_id").agg(
        F.array_sort(F.collect_set("category_id")).alias("cats"), F.avg(known("words_count")).alias("mean_words"), F.max_by(created, F.when(created.isNotNull(), -F.col("loc"))).alias("last_created")
    )


def soft_scored(cand: DataFrame, click: DataFrame, articles: DataFrame, p: config.ColdStart = config.ColdStart()) -> DataFrame:
    """Candidates rescored by seen state, category, length and freshness."""
    seen = click.select(F.col("click_article_id").alias("article_id")).distinct().withColumn("seen", F.lit(1))
    d = cand.join(user_profile(click, articles, p.history), "user_id", "left").join(articles, "article_id", "left").join(seen, "article_id", "left")
    words, created = (F.when(F.col("category_id").isNotNull(), F.coalesce(c, F.lit(0))) for c in ("words_count", "created_at_ts"))
    fade = lambda x, tol: F.exp(-F.abs(x) / F.greatest(F.lit(1.0), F.lit(tol)))
    score = (
        F.col("sim_score") - F.when(F.col("seen").isNotNull(), F.lit(p.seen_penalty)).otherwise(0.0)
        + F.when(F.col("category_id").isNotNull() & (F.size("cats") > 0), F.when(F.array_contains("cats", F.col("category_id")), F.lit(p.category_bonus)).otherwise(F.lit(-p.category_penalty))).otherwise(0.0)
        + F.when(words.isNotNull() & (F.col("mean_words") > 0), p.words_weight * fade(words - F.col("mean_words"), p.words_scale)).otherwise(0.0)
        + F.when(created.isNotNull() & (F.col("last_created") > 0), p.fresh_weight * fade((created - F.col("last_created")) / p.day, p.fresh_days)).otherwise(0.0)
    )
    return d.select("user_id", "article_id", score.alias("sim_score"), "label")


def by_user_map(got: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """user_id and ``name``, a map from ``key`` to ``value``: joined by the user alone, it leaves rows that are dealt by user where they are."""
    one = F.struct(key, value)
    return got.where(F.col(key).isNotNull()).groupBy("user_id").agg(F.map_from_entries(F.collect_list(one)).alias(name))


def minmax(cand: DataFrame, const: float = 1.0) -> DataFrame:
    """Per user to 0..1, ``const`` where all scores are equal, plus a small floor."""
    w = Window.partitionBy("user_id")
    lo, hi = F.min("sim_score").over(w), F.max("sim_score").over(w)
    return cand.withColumn("sim_score", F.coalesce((F.col("sim_score") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(const)) + config.EPS)


def cold_recall(edges: DataFrame, click: DataFrame, query: DataFrame, articles: DataFrame, p: config.ColdStart = config.ColdStart()) -> DataFrame:
    coarse = seeded_recall(edges, click, query, p.seeds, p.top_m, p.seed_decay, p.raw_k, "none")
    top = top_per_user(soft_scored(coarse, click, articles, p), p.k)
    w = Window.partitionBy("user_id")
    lo, hi = F.min("sim_score").over(w), F.max("sim_score").over(w)
    scaled = F.when(hi > lo, (F.col("sim_score") - lo) / (hi - lo)).otherwise(0.0) + config.EPS
    return top.withColumn("sim_score", scaled)


def fuse(channels: dict[str, DataFrame], p: config.Fusion = config.Fusion()) -> DataFrame:
    """Weighted sum of min-max scores over the channels that are given."""
    parts = [minmax(c).withColumn("sim_score", F.col("sim_score") * F.lit(p.weights[name])) for name, c in channels.items()]
    dealt = by_users(reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, [c.select("user_id") for c in channels.values()]).distinct())
    d = dealt.groupBy("user_id", "article_id").agg(F.sum("sim_score").alias("sim_score"), F.max("label").alias("label"))
    return top_per_user(d, p.k)


def keep_users(cand: DataFrame) -> DataFrame:
    """Users with a null label (test users) or exactly one positive."""
    ok = cand.groupBy("user_id").agg(F.count_if(F.col("label").isNull()).alias("open"), F.sum("label").alias("pos")).where("open > 0 or pos = 1")
    return cand.join(ok.select("user_id"), "user_id", "left_semi")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    pairs = lambda d: d.select("user_id", "article_id").distinct()
    d = pairs(a).join(pairs(b).withColumn("hit", F.lit(1)), ["user_id", "article_id"], "left")
    return d.agg((F.count("hit") / F.count("*")).alias("overlap"))


def overlaps(channels: dict[str, DataFrame]) -> DataFrame:
    """a, b, overlap of every two channels, from one pass over their distinct candidates."""
    tagged = reduce(DataFrame.unionByName, [d.select("user_id", "article_id", F.lit(1 << k).alias("bit")) for k, d in enumerate(channels.values())])
    found = tagged.groupBy("user_id", "article_id").agg(F.bit_or("bit").alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))  # a row for every set of channels
    names = F.array(*[F.when(F.col("bits").bitwiseAND(1 << k) > 0, n) for k, n in enumerate(channels)])
    found = found.select(F.array_compact(names).alias("all"), "n")
    hits = found.withColumn("a", F.explode("all")).withColumn("b", F.explode("all")).groupBy("a", "b").agg(F.sum("n").alias("hits"))
    whole = hits.where("a = b").select("a", F.col("hits").alias("size"))
    two = whole.crossJoin(whole.select(F.col("a").alias("b"))).where("a <> b")  # a row for every two channels
    return two.join(hits, ["a", "b"], "left").select("a", "b", (F.coalesce("hits", F.lit(0)) / F.col("size")).alias("overlap"))


def evaluate(cand: DataFrame, query: DataFrame, at: tuple[int, ...] = config.EVAL_AT) -> DataFrame:
    """Per k: hit rate and mean reciprocal rank over all users with a known target."""
    total = query.where("click_article_id <> -1").agg(F.count_distinct("user_id").alias("total"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("sim_score", 9)), "article_id")) - 1
    hits = cand.where("label is not null").withColumn("r", rank).where("label = 1").groupBy("user_id").agg(F.min("r").alias("r"))
    sums = hits.agg(*[f(k) for k in at for f in (lambda k: F.sum(F.when(F.col("r") < k, 1.0).otherwise(0.0)).alias(f"h{k}"), lambda k: F.sum(F.when(F.col("r") < k, 1.0 / (F.col("r") + 1)).otherwise(0.0)).alias(f"m{k}"))])
    row = lambda k: F.struct(F.lit(k).alias("k"), (F.coalesce(f"h{k}", F.lit(0.0)) / F.col("total")).alias("hr"), (F.coalesce(f"m{k}", F.lit(0.0)) / F.col("total")).alias("mrr"))
    # one row each
    return sums.crossJoin(total).select(F.inline(F.array(*[row(k) for k in at])))
