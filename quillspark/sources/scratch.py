"""Intermediate files that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder only where a local session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it again, for results that several outputs need: they are computed once, and a lost executor costs no more than
    the reading."""
    path = folder(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which reads tables made by ``table``, or what reads them: to release it is to release those."""
    df._scratch_parts = tables
    return df


def release(*tables: DataFrame) -> None:
    """Deletes tables made by ``table`` that nothing reads any more."""
    for t in tables:
        if "_scratch_parts" in vars(t):
            release(*t._scratch_parts)
        else:
            remove(t.sparkSession, t._scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
