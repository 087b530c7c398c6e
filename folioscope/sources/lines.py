"""Line tables from plain text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Document numbers that are ranked together.
PAGE_RUN = 1 << 16


def with_heights(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds each page's ``height`` to its lines (792 where it is unknown)."""
    return lines.join(pages.select("doc_id", "page_index", "height"), ["doc_id", "page_index"], "left").withColumn("height", F.coalesce("height", F.lit(792.0)))


def book_number(source):
    """60 bits of the md5 of a source's name; -1 for none."""
    return F.when(source.isNull(), F.lit(-1).cast("long")).otherwise(F.conv(F.substring(F.md5(F.encode(source, "UTF-8")), 1, 15), 16, 10).cast("long"))


def page_numbers(documents: DataFrame, run: int = PAGE_RUN) -> DataFrame:
    """book, n, page_index: the rank of each document id in its book.

    Ids are ranked within runs of ``run`` numbers, and what lies in a book's runs before is added, so that no task holds a whole book.
    """
    ids = documents.select(book_number(F.col("source")).alias("book"), F.col("doc_id").alias("n")).distinct()
    ids = ids.withColumn("_run", F.coalesce(F.floor(F.col("n") / run), F.lit(-(1 << 62))))
    before = Window.partitionBy("book").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = ids.groupBy("book", "_run").agg(F.count(F.lit(1)).alias("_k")).withColumn("_first", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("book", "_run").orderBy("n"))
    return ids.join(runs, ["book", "_run"]).select("book", "n", (F.col("_first") + own - 1).cast("int").alias("page_index"))


def from_documents(documents: DataFrame) -> DataFrame:
    """A line table of a text table: a source is a book, its documents in order of id are pages, their lines are lines.

    The layout is made up by whole-number rules, the same in any engine: y falls by 7, size and font repeat by position. Rows without
    text have no lines; rows with one id are one page.
    """
    rows = documents.filter("text is not null").select(book_number(F.col("source")).alias("book"), F.col("doc_id").alias("n"), "text")
    numbers = page_numbers(documents.filter("text is not null")).select(F.col("book").alias("_b"), F.col("n").alias("_n"), "page_index")
    # texts are dealt out evenly by the join, also where a small table has all of them in one split
    rows = rows.join(numbers.hint("shuffle_hash"), (F.col("book") == F.col("_b")) & F.col("n").eqNullSafe(F.col("_n")))
    line = rows.select(F.col("book").alias("doc_id"), "page_index", F.coalesce("n", F.lit(0)).alias("n"), F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))
    k = F.pmod(F.col("n") * 7 + F.col("line_idx") * 13, F.lit(11))
    size = F.when(k == 0, 18.0).when(k == 1, 14.0).when(k == 2, 12.0).otherwise(10.0)
    y = (780 - 7 * F.col("line_idx")).cast("double")
    return line.select(
        "doc_id", "page_index", "line_idx", "text", F.lit(72.0).alias("x"), (F.lit(72.0) + F.length("text") * 5).alias("x_end"), y.alias("y"), F.lit(0).alias("col"),
        size.alias("size"), size.alias("max_size"), F.when(k <= 1, "bold").otherwise("body").alias("font"), F.lit(1).alias("n_frags"), F.lit(792.0).alias("height"),
    )


def pages_of(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "page_index", F.lit(612.0).alias("width"), "height", F.col("height").alias("view_top")).distinct()
