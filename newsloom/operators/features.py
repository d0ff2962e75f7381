"""Ranking features of candidates. History-to-candidate similarities are looked up as sim[history item][candidate]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .recall import by_user_map
from .split import recent, sequence


def clicked(click: DataFrame, articles: DataFrame) -> DataFrame:
    """Clicks with their article's columns, seconds, hour (UTC) and lag differences."""
    c = sequence(click).join(articles.withColumnRenamed("article_id", "click_article_id"), "click_article_id", "left")
    c = c.withColumn("sec", F.floor(F.col("click_timestamp") / 1000)).withColumn("created", F.floor(F.col("created_at_ts") / 1000))
    w = Window.partitionBy("user_id").orderBy("pos")
    return c.withColumn("hour", F.pmod(F.floor(F.col("sec") / 3600), F.lit(24))).withColumn("d_sec", F.col("sec") - F.lag("sec").over(w)).withColumn("d_created", F.col("created") - F.lag("created").over(w))


def user_stats(click: DataFrame, articles: DataFrame) -> DataFrame:
    """Statistics per user; the last_* columns skip nulls."""
    c = clicked(click, articles)
    last = lambda col: F.max_by(col, F.when(F.col(col).isNotNull(), F.col("pos")))
    return c.groupBy("user_id").agg(
        F.avg("d_created").alias("user_id_click_article_created_at_ts_diff_mean"),
        F.avg("d_sec").alias("user_id_click_diff_mean"),
        F.avg("hour").alias("user_click_datetime_hour_mean"),
        F.stddev_samp("hour").alias("user_click_datetime_hour_std"),
        F.avg(F.col("sec") - F.col("created")).alias("user_click_timestamp_created_at_ts_diff_mean"),
        F.stddev_samp(F.col("sec") - F.col("created")).alias("user_click_timestamp_created_at_ts_diff_std"),
        F.max("created").alias("user_clicked_article_created_time_max"),
        F.avg("words_count").alias("user_clicked_article_words_count_mean"),
        last("words_count").alias("user_click_last_article_words_count"),
        last("created").alias("user_click_last_article_created_time"),
        last("sec").alias("user_click_last_article_click_time"),
        F.count_distinct("category_id").alias("user_clicked_category_nunique"),
        last("category_id").alias("last_category"),
    )


def user_stats_baseline(click: DataFrame, articles: DataFrame) -> DataFrame:
    """Statistics per user with fractional click seconds; the last_* columns keep a null of the last row."""
    c = clicked(click, articles).withColumn("fsec", F.col("click_timestamp") / 1000.0)
    w = Window.partitionBy("user_id").orderBy("pos")
    c = c.withColumn("d_fsec", F.col("fsec") - F.lag("fsec").over(w))
    last = lambda col: F.max_by(col, "pos")
    return c.groupBy("user_id").agg(
        F.avg("d_created").alias("created_diff_mean"), F.avg("d_fsec").alias("click_diff_mean"), F.avg(F.col("sec") - F.col("created")).alias("click_created_diff_mean"),
        F.stddev_samp(F.col("sec") - F.col("created")).alias("click_created_diff_std"), F.stddev_samp("hour").alias("hour_std"), F.avg("words_count").alias("words_mean"),
        last("words_count").alias("last_words"), last("created").alias("last_created"), F.max("created").alias("created_max"), last("sec").alias("last_click"), F.avg("sec").alias("click_mean"),
    )


def counts(cand: DataFrame, click: DataFrame, articles: DataFrame) -> DataFrame:
    """Clicks of the user, the article, the article's category (0 if none) and the user in that category."""
    cat = articles.select("article_id", "category_id")
    c = click.select("user_id", F.col("click_article_id").alias("article_id")).join(cat, "article_id", "left")
    by = lambda keys, name: c.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(name))
    d = cand.join(cat, "article_id", "left").join(by(["user_id"], "user_id_cnt"), "user_id", "left").join(by(["article_id"], "article_id_cnt"), "article_id", "left")
    d = d.join(by(["category_id"], "category_click_cnt"), "category_id", "left")
    own = by_user_map(by(["user_id", "category_id"], "n"), "category_id", "n", "own")
    d = d.join(own, "user_id", "left").withColumn("user_id_category_id_cnt", F.col("own")[F.col("category_id")])
    rest = [c for c in cand.columns if c not in ("user_id", "article_id")]
    return d.select("user_id", "category_id", "article_id", *rest, "user_id_cnt", "article_id_cnt", F.coalesce("category_click_cnt", F.lit(0)).alias("category_click_cnt"), "user_id_category_id_cnt")


def decayed_sum(cand: DataFrame, click: DataFrame, edges: DataFrame, history: int | None = 20, decay: float = 0.7) -> DataFrame:
    """user_id, article_id, sum over the history of decay^loc * sim; pairs without an edge are absent."""
    h = recent(click, history if history is not None else 1 << 30)
    h = h.groupBy("user_id", "item").agg(F.sum(F.pow(F.lit(decay), F.col("loc"))).alias("worth"))  # an article meets a candidate once, however often it was clicked
    e = edges.select(F.col("item_i").alias("item"), F.col("item_j").alias("article_id"), "sim")
    # candidates that no edge leads to meet nothing
    known = cand.select("user_id", "article_id").distinct().join(e.select("article_id").distinct(), "article_id", "left_semi")
    pairs = known.join(h, "user_id").join(e, ["item", "article_id"])
    return pairs.groupBy("user_id", "article_id").agg(F.sum(F.col("worth") * F.col("sim")).alias("sim_sum"))


def last_sim(cand: DataFrame, click: DataFrame, edges: DataFrame | None, name: str) -> DataFrame:
    """``cand`` with the similarity of the user's last click to the candidate, 0 if none or if there are no edges."""
    if edges is None:
        return cand.withColumn(name, F.lit(0.0))
    e = edges.select(F.col("item_i").alias("last_item"), F.col("item_j").alias("article_id"), F.col("sim").alias(name))
    d = cand.join(recent(click, 1).select("user_id", F.col("item").alias("last_item")), "user_id", "left").join(e, ["last_item", "article_id"], "left")
    return d.select(*cand.columns, F.coalesce(name, F.lit(0.0)).alias(name))


def with_sum(cand: DataFrame, sums: DataFrame, value: str, name: str) -> DataFrame:
    """``cand`` with ``value`` of ``sums`` (user_id, article_id, ...), 0 where there is none, as ``name``."""
    d = cand.join(by_user_map(sums, "article_id", value, "own"), "user_id", "left")
    return d.select(*cand.columns, F.coalesce(F.col("own")[F.col("article_id")], F.lit(0.0)).alias(name))


def unit(vec):
    """The vector at length 1; null where its length is 0."""
    lengths = F.array_repeat(F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)), F.size(vec))
    return F.when(F.get(lengths, F.lit(0)) > 0, F.zip_with(vec, lengths, lambda x, n: x / n))


def dot(a, b):
    """Cosine of vectors of length 1, -1 where one has none (null)."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(-1.0))


def cosine(a, b):
    """Cosine, -1 where a norm is zero."""
    return dot(unit(a), unit(b))


def vector_sims(cand: DataFrame, click: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the candidate with the last click (0 without vectors) and summed over the last two (cosines above -1)."""
    # lengths are divided out once an article, not once a pair
    v = vectors.select("article_id", unit(F.col("vec")).alias("vec"))
    h = recent(click, 2)
    # a cosine is computed once a pair of articles
    pairs = cand.select("user_id", "article_id").distinct().join(h, "user_id")
    c = pairs.select("item", "article_id").distinct().join(v.toDF("item", "hv"), "item").join(v, "article_id").select("item", "article_id", dot(F.col("hv"), F.col("vec")).alias("c"))
    # dealt by user as the candidates are
    d = pairs.join(c, ["item", "article_id"]).repartition(int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")
    s = d.groupBy("user_id", "article_id").agg(F.max(F.when(F.col("loc") == 0, F.col("c"))).alias("w2v_last"), F.sum(F.when(F.col("c") > -1, F.col("c"))).alias("w2v_sum"))
    s = s.select("user_id", "article_id", F.struct("w2v_last", "w2v_sum").alias("two"))
    out = cand.join(by_user_map(s, "article_id", "two", "own"), "user_id", "left").select(*cand.columns, F.col("own")[F.col("article_id")].alias("two"))
    return out.select("*", F.coalesce("two.w2v_last", F.lit(0.0)).alias("user_last_click_article_w2v_sim"), F.coalesce("two.w2v_sum", F.lit(0.0)).alias("user_click_article_w2w_sim_sum_2")).drop("two")


def with_last_diffs(d: DataFrame) -> DataFrame:
    """Candidate against the user's last click: creation time, click time, words, same category (null is not the same)."""
    created = F.floor(F.col("created_at_ts") / 1000)
    return d.withColumn("user_last_click_created_at_ts_diff", created - F.col("user_click_last_article_created_time")).withColumn("user_last_click_timestamp_diff", created - F.col("user_click_last_article_click_time")).withColumn(
        "user_last_click_words_count_diff", F.col("words_count") - F.col("user_click_last_article_words_count")).withColumn("same_as_last_category", F.coalesce((F.col("category_id") == F.col("last_category")).cast("int"), F.lit(0)))


def feature_v3(cand: DataFrame, click: DataFrame, articles: DataFrame, itemcf: DataFrame, swing: DataFrame | None, emb: DataFrame | None, vectors: DataFrame) -> DataFrame:
    d = counts(cand, click, articles).join(articles.drop("category_id"), "article_id", "left").join(user_stats(click, articles), "user_id", "left")
    d = with_last_diffs(d).withColumn("created_at_datetime", F.timestamp_seconds(F.floor(F.col("created_at_ts") / 1000)))
    d = with_sum(d, decayed_sum(cand, click, itemcf), "sim_sum", "user_clicked_article_itemcf_sim_sum")
    for name, e in (("itemcf", itemcf), ("swing", swing), ("emb_i2i", emb)):
        d = last_sim(d, click, e, f"user_last_click_article_{name}_sim")
    return vector_sims(d, click, vectors).withColumn("created_at_ts", F.floor(F.col("created_at_ts") / 1000)).drop("last_category")


def feature_baseline(cand: DataFrame, click: DataFrame, articles: DataFrame, itemcf: DataFrame) -> DataFrame:
    d = counts(cand, click, articles).join(articles.drop("category_id"), "article_id", "left").join(user_stats_baseline(click, articles), "user_id", "left")
    created = F.floor(F.col("created_at_ts") / 1000)
    d = d.withColumn("last_created_diff", created - F.col("last_created")).withColumn("last_click_diff", created - F.col("last_click")).withColumn("last_words_diff", F.col("words_count") - F.col("last_words"))
    d = with_sum(d, decayed_sum(cand, click, itemcf, None), "sim_sum", "itemcf_sum")
    return last_sim(d, click, itemcf, "itemcf_last").drop("category_click_cnt")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum per integer column and the smallest integer type that holds them strictly inside its range."""
    one = df.agg(*[f(c).cast("bigint").alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    d = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").alias("lo"), F.col(f"max_{c}").alias("hi")) for c in columns])))
    fits = lambda bits: (F.col("lo") > -(1 << bits - 1)) & (F.col("hi") < (1 << bits - 1) - 1)
    return d.withColumn("type", F.when(fits(8), "int8").when(fits(16), "int16").when(fits(32), "int32").otherwise("int64"))
