"""Append-only dictionaries: a value keeps its code for ever, new values get the next numbers (0 stays free for padding)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import Files
from .split import ordinal


def fresh_codes(known: DataFrame | None, df: DataFrame, col: str) -> DataFrame:
    """(value, code) of the values of ``df`` that ``known`` (value, code) lacks: in their order, after its largest code. Nulls have no code.
    New values are numbered per range partition, so that no task sees all of them."""
    values = df.select(F.col(col).alias("value")).where(F.col(col).isNotNull())
    if known is None:
        return ordinal(values, "value")
    values = values.distinct().join(known.select("value"), "value", "left_anti")
    top = known.agg(F.coalesce(F.max("code"), F.lit(0)).alias("top"))  # one row
    return ordinal(values, "value").crossJoin(F.broadcast(top)).select("value", (F.col("code") + F.col("top")).alias("code"))


class Dictionary:
    """Codes below a path, a folder a generation. A generation is moved into place when it is whole; of two writers of one generation
    the second gets an error and has to begin again with what the first one wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def generations(self) -> int:
        n = 0
        while self.files.exists(f"{self.path}/gen={n}"):
            n += 1
        return n

    def codes(self) -> DataFrame | None:
        """value, code; None before the first generation."""
        n = self.generations()
        return self.spark.read.parquet(*[f"{self.path}/gen={k}" for k in range(n)]) if n else None

    def extend(self, df: DataFrame, col: str) -> DataFrame:
        """All codes, after the values of ``df`` that have none got theirs."""
        n, known = self.generations(), self.codes()
        fresh = f"{self.path}/new-{n}"
        self.files.delete(fresh)
        fresh_codes(known, df, col).write.parquet(fresh)
        if known is not None and self.spark.read.parquet(fresh).isEmpty():
            self.files.delete(fresh)
        elif not self.files.rename(fresh, f"{self.path}/gen={n}"):
            raise OSError(f"{self.path} has another generation {n} by now")
        return self.codes()


def write_id_maps(click: DataFrame, path: str) -> dict[str, DataFrame]:
    """Dictionaries ``users`` and ``articles`` below ``path``, extended by the ids of ``click``."""
    return {name: Dictionary(click.sparkSession, f"{path}/{name}").extend(click, col) for col, name in (("user_id", "users"), ("click_article_id", "articles"))}
