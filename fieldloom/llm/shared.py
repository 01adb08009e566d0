"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one is made on a local master; a cluster's executors could not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: Tables made inside the innermost scratch() of this thread or task.
_open: ContextVar[list | None] = ContextVar("tables", default=None)
#: Rows of two numbers that are broadcast at most (some 30 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its size is checked to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if (tables := _open.get()) is not None:
        tables.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """A list of the tables that materialize() makes inside, for drop(): an operator deletes those that its result doesn't read before it returns."""
    token = _open.set(tables := [])
    try:
        yield tables
    finally:
        _open.reset(token)


def drop(tables: list[DataFrame], *kept: DataFrame) -> None:
    for t in tables:
        if all(t is not k for k in kept):
            release(t)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame | None) -> None:
    """Delete the files of a table made by materialize(); later reads of it would fail."""
    path = getattr(df, "_stored_at", None)
    if path:
        delete(df.sparkSession, path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
