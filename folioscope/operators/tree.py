"""Levels and trees as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import global_rank


def rebase_levels(rows: DataFrame, key: str = "doc_id", level: str = "level") -> DataFrame:
    """Shifts levels so that the least of a document is 1."""
    return rows.withColumn(level, (F.col(level) - F.min(level).over(Window.partitionBy(key)) + 1).cast("int"))


def densify_levels(rows: DataFrame, key: str = "doc_id", level: str = "level", most: int = 6) -> DataFrame:
    """Numbers the levels in use from 1 without gaps."""
    return rows.withColumn(level, F.least(F.lit(most), F.dense_rank().over(Window.partitionBy(key).orderBy(level))).cast("int"))


def tree(rows: DataFrame, order: list, key: str = "doc_id", level: str = "level") -> DataFrame:
    """Adds seq, depth and parent_seq (null for a root).

    A row's depth is its level, but at most one more than the depth before; its parent is the last row one depth up. With
    places from 1 the depth is the place plus the least of 0 and, over this row and those before, of level - place.
    """
    document = Window.partitionBy(key)
    rows = rows.withColumn("seq", F.row_number().over(document.orderBy(*order)))
    upto = document.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("depth", (F.col("seq") + F.least(F.lit(0), F.min(F.col(level) - F.col("seq")).over(upto))).cast("int"))
    deepest = 6
    last = {d: F.last(F.when(F.col("depth") == d, F.col("seq")), ignorenulls=True).over(upto) for d in range(1, deepest)}
    parent = F.lit(None).cast("int")
    for d, place in last.items():
        parent = F.when(F.col("depth") == d + 1, place).otherwise(parent)
    return rows.withColumn("parent_seq", parent)


def prune_levels(headings: DataFrame, pages: DataFrame, least: int = 12, per_page: float = 1.2) -> DataFrame:
    """Drops the deepest levels while a document has more headings than its pages allow; the first level always stays.

    Levels that stay are those up to the last one whose headings, with all above it, are within the limit.
    """
    limit = pages.select("doc_id", F.greatest(F.lit(least), F.floor(F.col("pages") * per_page + 0.5)).alias("_cap"))
    counts = headings.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("doc_id").orderBy("level")
    counts = counts.withColumn("_sum", F.sum("n").over(upto)).join(limit, "doc_id")
    deepest = counts.groupBy("doc_id").agg(F.greatest(F.max(F.when(F.col("_sum") <= F.col("_cap"), F.col("level"))), F.lit(1)).alias("_deepest"))
    return headings.join(deepest, "doc_id").filter(F.col("level") <= F.col("_deepest")).drop("_deepest")


def blocks(rows: DataFrame, key: str = "doc_id", value: str = "page_index", step: int = 1) -> DataFrame:
    """Adds block: runs of values no more than ``step`` apart, from 1."""
    order = Window.partitionBy(key).orderBy(value)
    starts = F.coalesce((F.col(value) - F.lag(value).over(order) > step).cast("int"), F.lit(1))
    return rows.withColumn("_start", starts).withColumn("block", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_start")


def top_per_group(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def systematic_sample(rows: DataFrame, order: list, step: int, key: str | None = None) -> DataFrame:
    """Every ``step``-th row in order, from the first; per ``key`` where that is given."""
    if key is None:
        return global_rank(rows, order, "_r").filter(F.col("_r") % step == 0).drop("_r")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter((F.col("_r") - 1) % step == 0).drop("_r")


def style_votes(rows: DataFrame, style: str = "style", level: str = "level") -> DataFrame:
    """The level most rows of a style have, the lesser of equals."""
    n = rows.groupBy("doc_id", style, level).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("doc_id", style).agg(F.max_by(level, F.struct("n", -F.col(level))).alias(level))
