"""Click log, article dimension and vectors as DataFrames; readers of the file forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CLICK_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("user_id", "click_article_id", "click_timestamp")])
ALIASES = {"article_id": ["click_article_id"], "category_id": ["category"], "words_count": ["words"], "created_at_ts": ["created_at"]}


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, click_article_id, click_timestamp (ms), event_id from the event table; null keys have no place in any group."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    item = F.get_json_object("props", "$.k").cast("bigint")
    d = e.select("user_id", item.alias("click_article_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("click_timestamp"), "event_id")
    return d.where("user_id is not null and click_article_id is not null")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, category_id, created_at_ts (ms), words_count."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("article_id"), F.col("label").cast("bigint").alias("category_id"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("article_id"), F.col("n_chars").alias("words_count"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("article_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at_ts"))
    return v.join(d, "article_id", "left").join(o, "article_id", "left").select("article_id", "category_id", "created_at_ts", "words_count")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, vec array<double>."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("article_id"), F.col("embedding").cast("array<double>").alias("vec"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, click_article_id (-1, nothing known): every customer as a user to recommend to."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("bigint").alias("click_article_id"))


def read_clicks_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLICK_SCHEMA).csv(path, header=True)


def read_embeddings_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV: article_id, then one column per dimension in file order."""
    d = spark.read.csv(path, header=True)
    if "article_id" not in d.columns:
        raise ValueError("embedding file has no article_id column")
    return d.select(F.col("article_id").cast("bigint").alias("article_id"), F.array(*[F.col(f"`{c}`").cast("float") for c in d.columns if c != "article_id"]).alias("embedding"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """article_id, embedding from a wide CSV or from Parquet, by the name's ending."""
    if path.rstrip("/").endswith(".csv"):
        return read_embeddings_csv(spark, path)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("article_id", "embedding")
    raise ValueError(f"neither .csv nor .parquet: {path}")


def required(df: DataFrame, name: str) -> DataFrame:
    """``df``, or an error where it has no row."""
    if df.isEmpty():
        raise ValueError(f"{name} is empty")
    return df


def read_articles(df: DataFrame) -> DataFrame:
    """An article table with known alternative column names; absent columns become null, words and creation time 0 where null."""
    def found(name: str):
        return next((c for c in (name, *ALIASES[name]) if c in df.columns), None)

    if found("article_id") is None:
        raise ValueError("article table has no id column")
    col = lambda name: F.col(found(name)).cast("bigint") if found(name) else F.lit(None).cast("bigint")
    return df.select(col("article_id").alias("article_id"), col("category_id").alias("category_id"), F.coalesce(col("created_at_ts"), F.lit(0)).alias("created_at_ts"), F.coalesce(col("words_count"), F.lit(0)).alias("words_count"))


def read_articles_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_articles(spark.read.csv(path, header=True))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """A stored similarity table: item_i, item_j, sim."""
    d = spark.read.parquet(path)
    if missing := {"item_i", "item_j", "sim"} - set(d.columns):
        raise ValueError(f"edge table has no {', '.join(sorted(missing))}")
    return d.select("item_i", "item_j", "sim")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
