"""Helpers shared by the training-data operators: scratch tables, splits, text access."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_FALLBACK: list[str] = []
_HELD = threading.local()
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, local mode (tests) takes
    a temporary folder of this process; on a cluster there is no such folder, and it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: intermediate tables are written there")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="newsloom-"))
    return _FALLBACK[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends or by ``drop``."""
    path = f"{shared_dir(spark)}/newsloom/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    for paths in getattr(_HELD, "scopes", ()):
        paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    except Exception:  # the gateway may be gone when the interpreter ends
        pass


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the paths of the scratch tables that this thread makes inside the block."""
    scopes = _HELD.scopes = getattr(_HELD, "scopes", [])
    scopes.append(paths := [])
    try:
        yield paths
    finally:
        scopes.pop()


def drop(spark: SparkSession, *held: DataFrame | str) -> None:
    """Delete scratch tables that nothing reads any more, and let Spark delete the shuffle files of plans that are gone
    (it does so when the driver's heap is collected, which may be long after)."""
    for x in held:
        path = x if isinstance(x, str) else _PATHS.get(x)
        if path:
            _delete(spark, path)
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)).cast("int")


def words_re() -> re.Pattern:
    """Words of the contracts: maximal runs without space, tab, \\n, \\v, \\f and \\r."""
    return re.compile(r"[^\x20\x09-\x0D]+")


def texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that the Python objects of few texts live at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
