"""Splits, queries and user sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _by_user(newest_first: bool):
    order = [F.desc(c) if newest_first else F.col(c) for c in ("click_timestamp", "event_id")]
    return Window.partitionBy("user_id").orderBy(*order)


def sample_users(clicks: DataFrame, n: int, seed: int = 2020) -> DataFrame:
    """n distinct users in an order that every engine reproduces; all users if there are fewer."""
    return clicks.select("user_id").distinct().orderBy(F.md5(F.concat_ws("-", "user_id", F.lit(seed)))).limit(n)


def leave_last_out(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clicks without each user's last, that last click as query)."""
    d = train.withColumn("back", F.row_number().over(_by_user(True)))
    query = d.where("back = 1").select("user_id", "click_article_id")
    return d.where("back > 1").drop("back"), query


def sentinel_queries(test: DataFrame) -> DataFrame:
    return test.select("user_id").distinct().withColumn("click_article_id", F.lit(-1).cast("bigint"))


def split(clicks: DataFrame, online: bool = False) -> tuple[DataFrame, DataFrame]:
    """(click, query): test users are those divisible by 5; offline, every other user's last click is held out."""
    test, train = clicks.where("user_id % 5 = 0"), clicks.where("user_id % 5 <> 0")
    if online:
        return clicks, sentinel_queries(test)
    kept, query = leave_last_out(train)
    return kept.unionByName(test), query.unionByName(sentinel_queries(test))


def sequence(click: DataFrame) -> DataFrame:
    """pos (from 0, oldest first), loc (from 0, newest first) and n_clicks (repeats count) of every click; clicks that have them stay as they are."""
    if "loc" in click.columns:
        return click
    n = F.count("*").over(Window.partitionBy("user_id"))
    d = click.withColumn("pos", (F.row_number().over(_by_user(False)) - 1).cast("bigint")).withColumn("n_clicks", n)
    return d.withColumn("loc", F.col("n_clicks") - 1 - F.col("pos"))


def recent(click: DataFrame, n: int) -> DataFrame:
    """user_id, loc, item: the last n clicks, newest at loc 0."""
    if "loc" in click.columns:
        return click.where(F.col("loc") < n).select("user_id", "loc", F.col("click_article_id").alias("item"))
    # numbered from the newest, so that the limit works in each task before the exchange
    d = click.withColumn("turn", F.row_number().over(_by_user(True))).where(F.col("turn") <= n)
    return d.select("user_id", (F.col("turn") - 1).cast("bigint").alias("loc"), F.col("click_article_id").alias("item"))


def prefix_samples(click: DataFrame) -> DataFrame:
    """Per click but the first (or the only one): target, history before it newest first, and is_test for the last.
    A user with one click has it as history and target, in both sets."""
    before = _by_user(False).rowsBetween(Window.unboundedPreceding, -1)
    s = sequence(click).withColumn("hist", F.reverse(F.collect_list("click_article_id").over(before)))
    many = s.where("pos > 0").select("user_id", "pos", "hist", F.col("click_article_id").alias("target"), (F.col("loc") == 0).cast("int").alias("is_test"))
    single = s.where("n_clicks = 1").select("user_id", "pos", F.array("click_article_id").alias("hist"), F.col("click_article_id").alias("target"), F.explode(F.array(F.lit(0), F.lit(1))).alias("is_test"))
    return many.unionByName(single)


def padded(hist, length: int):
    """The first ``length`` items, filled up with 0 behind."""
    return F.slice(F.concat(hist, F.array_repeat(F.lit(0).cast("bigint"), length)), 1, length)


def ordinal(df: DataFrame, col: str) -> DataFrame:
    """value -> 1-based rank among the sorted distinct values (0 stays free for padding). Ranks are numbered per range
    partition and shifted by the partitions' counts, so that no single task sees all values."""
    d = df.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), col).withColumn("part", F.spark_partition_id())
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy(col)))
    sizes = d.groupBy("part").agg(F.max("rn").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(F.broadcast(before), "part").select(col, (F.col("rn") + F.col("before")).cast("bigint").alias("code"))


def category_codes(df: DataFrame, columns: list[str], most: int = 64) -> DataFrame:
    """``df`` with every one of the text ``columns`` that has at most ``most`` distinct values (null counts as one) replaced by the
    value's place in alphabetical order, from 0; null becomes -1. Columns with more values stay."""
    few = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]).first()
    for c in columns:
        if (few[c] or 0) <= most:
            # at most ``most`` values
            values = df.agg(F.array_sort(F.collect_set(c)).alias("all")).select("all")
            df = df.crossJoin(F.broadcast(values)).withColumn(c, F.coalesce(F.array_position("all", F.col(c)) - 1, F.lit(-1)).cast("int")).drop("all")
    return df
