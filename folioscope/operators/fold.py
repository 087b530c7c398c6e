"""Folds in Python over sorted Arrow streams: rows of one group lie together, whatever number of groups a batch holds.

Spark deals the rows out by key and sorts them within each partition, so a partition is one stream in which a group may begin and
end anywhere. No call is made and no table is built for a group; what is carried from batch to batch is the group that is open.
A function that takes its rows as they come (``lazily``) holds no group at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a result batch, and bytes of one that holds files or parts of them.
ROWS, FLUSH_BYTES = 8192, 8 << 20


def sorted_stream(df: DataFrame, keys: list[str], order: list = ()) -> DataFrame:
    """Rows of a key in one partition, next to each other, in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def records(stream: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict]]:
    """Key and row of each row of the batches."""
    for batch in stream:
        names = batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        places = [names.index(k) for k in keys]
        for key, row in zip(zip(*(columns[i] for i in places), strict=True), zip(*columns, strict=True), strict=True):
            yield key, dict(zip(names, row, strict=True))


def batched(rows: Iterable[dict], schema: pa.Schema, size: int = ROWS) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def by_bytes(rows: Iterable[tuple], schema: pa.Schema, size: int = FLUSH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches that end once they hold ``size`` bytes in binary columns, however many rows a task has; rows are tuples."""
    binary = [i for i, f in enumerate(schema) if pa.types.is_binary(f.type)]
    held: list[tuple] = []
    total = 0
    made = lambda: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        total += sum(len(row[i]) for i in binary if row[i] is not None)
        if total >= size or len(held) == ROWS:
            yield made()
            held, total = [], 0
    if held:
        yield made()


def each_file(df: DataFrame, function: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``function`` of the values of each row, one after another; what it gives are rows. Neither files nor results of many rows are held at once."""
    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in stream for values in zip(*b.columns, strict=True) for r in function(*(v.as_py() for v in values)))
        return by_bytes(rows, arrow)

    return df.mapInArrow(run, target)


def fold(df: DataFrame, keys: list[str], function: Callable[[list[dict] | Iterator[dict]], Iterable[dict]], schema: str | StructType, order: list = (), lazily: bool = False) -> DataFrame:
    """``function`` over the rows of each group, sorted by ``order``: a list of them, or ``lazily`` an iterator, of which what it leaves is
    skipped. Columns that its results lack are null. A group is one document or page."""
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(records(stream, keys), itemgetter(0))
        found = (row for _, group in groups for row in function(_rows(group) if lazily else list(_rows(group))))
        return batched(found, arrow)

    return sorted_stream(df, keys, order).mapInArrow(run, target)


def _rows(group: Iterator[tuple[tuple, dict]]) -> Iterator[dict]:
    return (row for _, row in group)


def tagged(keys: list[str], first: DataFrame, second: DataFrame, order: list = ()) -> DataFrame:
    """Two tables as one sorted stream: of each key, the rows of ``first`` come before those of ``second`` (column ``tag``: 0, 1)."""
    both = first.withColumn("tag", F.lit(0)).unionByName(second.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    return sorted_stream(both, keys, ["tag", *order])
