"""Shared plumbing: the folder all executors see, written tables, partition sizing, packed arrays."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="folioscope-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    if _SCOPES:
        _SCOPES[-1].append(table)
    return table


_SCOPES: list[list[DataFrame]] = []


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """Tables that are written inside are removed at the end, but for those taken out of the list that it gives."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop()
        discard(*made)


def open_shared(uri: str, mode: str):
    """Opens a file below the shared folder from Python: a local mount by path, any other store by pyarrow."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        path = unquote(at.path)
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_file(path)


def replace_shared(source: str, target: str) -> None:
    """Renames a finished file, so that a task that ran twice leaves one whole file."""
    at, to = urlparse(source), urlparse(target)
    if at.scheme in ("", "file"):
        os.replace(unquote(at.path), unquote(to.path))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(source)
    store.move(path, fs.FileSystem.from_uri(target)[1])


_CACHES: dict[str, dict] = {}


def cache_of(owner: str) -> dict:
    """What a worker process remembers for one operator; what it remembered for others goes, so that stages don't add up."""
    if owner not in _CACHES:
        _CACHES.clear()
        give_back()
    return _CACHES.setdefault(owner, {})


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(stream):
    """``stream`` of a task; at its end freed memory goes back, so that an idle worker holds little beside the next stage."""
    yield from stream
    give_back()


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one aggregate over one column."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def parts(total: int, each: int, least: int = 1) -> int:
    """Partitions of about ``each`` units; grows with the input."""
    return max(least, math.ceil(total / each))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z so that comparison with ASCII words is exact.

    ``lower`` works on all of Unicode; of the characters outside ASCII only the Kelvin sign and the dotted capital I have
    an ASCII letter in their lower case. They are replaced by letters outside ASCII first, so no ASCII word arises from them.
    """
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(modulus))


def pack(values, dtype) -> bytes:
    return np.ascontiguousarray(values, dtype=dtype).tobytes()


def unpack(blob, dtype) -> np.ndarray:
    return np.frombuffer(blob, dtype=dtype)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i]`` one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
