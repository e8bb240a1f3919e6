"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where it is unset and all tasks run on this machine, a temporary folder becomes it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    path = f"file://{tempfile.mkdtemp(prefix='pelagia-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/pelagia/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that no plan will read any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged inside the block are deleted at its end, but for paths put on the list that it gives.

    Only for blocks whose results are staged: a plan that still reads a deleted table fails.
    """
    begin, kept = len(_written), []
    try:
        yield kept
    finally:
        for path in _written[begin:]:
            if path not in kept:
                discard(spark, path)
        _written[begin:] = kept


def staged_alone(make, spark: SparkSession, name: str) -> DataFrame:
    """The DataFrame that ``make()`` plans, staged; what was staged on the way is deleted."""
    with scratch(spark) as kept:
        df = make()
        path = new_path(spark, name)
        df.write.parquet(path)
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)
