"""What recurs in a document: styles, running heads, repeated lines, contents pages. Inputs are line tables with ``height``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.text import norm_key, round_half_up, running_key
from .predicates import TOC_LINE, TOC_TITLE, relative_y


def page_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.countDistinct("page_index").alias("pages"))


def _order() -> Column:
    return F.struct("page_index", "line_idx")


def style_census(lines: DataFrame) -> DataFrame:
    """One row per document: the style with most characters (the first seen of equals) and fonts that look like those of headings."""
    chars = F.length("text")
    styles = lines.groupBy("doc_id", "font", (round_half_up(F.col("size") * 10) / 10).alias("size")).agg(
        F.sum(chars).alias("chars"), F.count(F.lit(1)).alias("n"), F.min(_order()).alias("first")
    )
    # a second, later place would win a tie under max_by of the place itself, so the place counts backwards
    back = F.struct(-F.col("first.page_index").alias("p"), -F.col("first.line_idx").alias("l"))
    body = styles.groupBy("doc_id").agg(F.max_by(F.struct("font", "size"), F.struct("chars", back.alias("b"))).alias("body"), F.sum("chars").alias("total_chars"))
    fonts = styles.groupBy("doc_id", "font").agg(F.sum("chars").alias("chars"), F.sum("n").alias("n"))
    own = fonts.select("doc_id", F.col("font").alias("_f"), F.col("chars").alias("body_chars"))
    body = body.join(own, (own["doc_id"] == body["doc_id"]) & F.col("_f").eqNullSafe(F.col("body.font")), "left").drop(own["doc_id"])
    short = (~F.col("font").eqNullSafe(F.col("body.font"))) & (F.col("chars") < F.col("body_chars") * 0.2) & (F.col("n") >= 2) & (F.col("chars") / F.col("n") < 100)
    heading = fonts.join(body.select("doc_id", "body", "body_chars"), "doc_id").filter(short).groupBy("doc_id").agg(F.array_sort(F.collect_set("font")).alias("heading_fonts"))
    out = body.join(heading, "doc_id", "left")
    size = F.when(F.col("body.size") > 0, F.col("body.size")).otherwise(10.0)
    return out.select("doc_id", F.col("body.font").alias("body_font"), size.alias("body_size"), F.coalesce("heading_fonts", F.array().cast("array<string>")).alias("heading_fonts"), "total_chars")


def running_heads(lines: DataFrame, margin: float = 0.18, least: int = 3, share: float = 0.3, anywhere_least: int = 4, anywhere_share: float = 0.5) -> DataFrame:
    """Keys (doc_id, key) on enough pages: within the margins, or anywhere on more of them."""
    rel = relative_y(F.col("y"), F.col("height"))
    # keys are made once; they are counted by hash, and themselves only where the hash stands on enough pages
    every = cut(lines.select("doc_id", "page_index", running_key(F.col("text")).alias("key"), ((rel <= margin) | (rel >= 1 - margin)).alias("edge")).withColumn("hash", F.xxhash64("key")))
    pages = page_counts(every)
    enough = lambda n, few, part: n >= F.greatest(F.lit(few), F.ceil(F.col("pages") * part))

    def often(keyed: DataFrame, name: str) -> DataFrame:
        seen = keyed.groupBy("doc_id", name, "page_index").agg(F.max("edge").alias("edge"))
        counted = seen.groupBy("doc_id", name).agg(F.count_if("edge").alias("edges"), F.count(F.lit(1)).alias("n")).join(pages, "doc_id")
        return counted.filter(enough(F.col("edges"), least, share) | enough(F.col("n"), anywhere_least, anywhere_share)).select("doc_id", name)

    keyed = every.filter(F.length("key") >= 3)
    return often(keyed.join(cut(often(keyed, "hash")), ["doc_id", "hash"], "left_semi"), "key")


def repeated_lines(lines: DataFrame, least: int = 3) -> DataFrame:
    """Keys (doc_id, key, pages) of four characters or more that stand on ``least`` pages."""
    keyed = lines.select("doc_id", "page_index", norm_key(F.col("text")).alias("key")).filter(F.length("key") >= 4)
    return keyed.distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least)


def toc_pages(lines: DataFrame) -> DataFrame:
    """Pages (doc_id, page_index) that read like a table of contents: titled so, or with references on enough lines."""
    long_ = F.length("text") > 4
    counted = lines.groupBy("doc_id", "page_index").agg(
        F.count_if(long_).alias("n"), F.count_if(long_ & F.col("text").rlike(TOC_LINE)).alias("refs"), F.max(F.trim("text").rlike(TOC_TITLE)).alias("titled")
    )
    return counted.filter("titled or (n >= 4 and refs >= greatest(3, n * 0.3))").select("doc_id", "page_index")


def gaps_above(lines: DataFrame) -> DataFrame:
    """Adds ``gap_above``: the last line's y less this one's in reading order, 999 for the first of a page."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("line_idx")
    return lines.withColumn("gap_above", F.coalesce(F.lag("y").over(order) - F.col("y"), F.lit(999.0)))


def dominant_styles(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Font and size (to a tenth) with most characters of each group, the first of equals, and the largest size."""
    s = fragments.groupBy(*keys, "font", (round_half_up(F.col("size") * 10) / 10).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min("frag_idx").alias("first"), F.max("size").alias("most"))
    return s.groupBy(*keys).agg(F.max_by(F.struct("font", "size"), F.struct("n", -F.col("first"))).alias("s"), F.max("most").alias("max_size")).select(*keys, "s.font", "s.size", "max_size")


def bin_occupancy(fragments: DataFrame, keys: list[str], width: int = 4) -> DataFrame:
    """How many fragments cover each bin of ``width`` points."""
    first = F.greatest(F.lit(0), F.floor(F.col("x") / width)).cast("int")
    last = F.ceil((F.col("x") + F.greatest("width", F.lit(1.0))) / width).cast("int") - 1
    return fragments.filter(last >= first).select(*keys, F.explode(F.sequence(first, last)).alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
