"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one, which only serves a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    warnings.warn("spark.checkpoint.dir is not set: intermediate tables go to a temporary folder of this machine", stacklevel=3)
    return os.path.join(tempfile.gettempdir(), "newsloom-shared")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """While this lasts, Spark removes a write's shuffle files as soon as the write has ended."""
    before = spark.conf.get(_FREES_SHUFFLES, "false")
    spark.conf.set(_FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREES_SHUFFLES, before)


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing has used; release() knows it."""
    path = f"{shared_folder(spark).rstrip('/')}/newsloom/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Unlike localCheckpoint the files outlive executors; unlike checkpoint() later reads prune columns, and the shuffle
    files behind df are gone once it is written.
    """
    spark = df.sparkSession
    path = new_path(spark)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df for a join that is never broadcast: what stored tables hold is many times what the sizes of their files tell, and the
    driver would have to gather it."""
    return df.hint("merge")


def release(spark: SparkSession) -> int:
    """Empty every intermediate table of this application: call it when the results that were built on them are written."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        spark.createDataFrame([], "x int").write.mode("overwrite").parquet(path)
    return len(paths)
