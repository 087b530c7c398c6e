"""Cutting the lineage of tables that several branches of a plan read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_SCOPES: list[list[str]] = []
_OWN: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, in local mode alone, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="folioscope-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: branches read the columns that they need, and lost executors cost no more than a task.
    It stays until the ``scratch`` around it ends, or else the application."""
    spark = df.sparkSession
    own = f"{folder(spark)}/folioscope/{spark.sparkContext.applicationId}"
    path = f"{own}/cut-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    elif own not in _OWN:
        _OWN.add(own)
        atexit.register(_remove_at_exit, spark, own)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may be gone
        remove(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are removed at the end; what is computed from them has to be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        remove(spark, *_SCOPES.pop())
