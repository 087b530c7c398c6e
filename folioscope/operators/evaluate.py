"""Outlines against true ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import same_title, truth_key
from .fold import fold
from .ranks import upper_median_of


def greedy_match(found: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, seq, truth_seq: each found heading takes the first unused true one of the same title within a page.

    Titles are the same only where their first eight letters are, so the headings of a document that begin alike are matched by
    themselves: pairs come in order, and only which headings are used up is remembered.
    """
    head = lambda k: F.substring(k, F.lit(1), F.lit(8))
    f = found.select("doc_id", "seq", "page_index", truth_key(F.col("title")).alias("k")).withColumn("head", head(F.col("k"))).alias("f")
    t = truth.filter("page >= 1").select("doc_id", F.col("seq").alias("truth_seq"), (F.col("page") - 1).alias("p"), truth_key(F.col("title")).alias("tk"))
    t = t.withColumns({"page_index": F.explode(F.sequence(F.col("p") - 1, F.col("p") + 1)), "head": head(F.col("tk"))}).alias("t")
    same = (F.col("f.doc_id") == F.col("t.doc_id")) & (F.col("f.page_index") == F.col("t.page_index")) & (F.col("f.head") == F.col("t.head"))
    pairs = f.join(t, same & same_title(F.col("k"), F.col("tk"))).select("f.doc_id", "f.head", "seq", "truth_seq")

    def take(rows):
        used, last = set(), None
        for r in rows:
            if r["seq"] != last and r["truth_seq"] not in used:
                last = r["seq"]
                used.add(r["truth_seq"])
                yield r

    return fold(pairs, ["doc_id", "head"], take, "doc_id long, seq int, truth_seq int", ["seq", "truth_seq"], lazily=True)


def prf(found: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, precision, recall, f1 of every document with a true outline."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    rows = n(truth, "_t0").select("doc_id").join(n(truth.filter("page >= 1"), "t"), "doc_id", "left").join(n(found, "f"), "doc_id", "left").join(n(greedy_match(found, truth), "tp"), "doc_id", "left").fillna(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("f")), "recall": ratio(F.col("tp"), F.col("t"))})
    both = F.col("precision") + F.col("recall")
    return rows.select("doc_id", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"))


def summary(scores: DataFrame) -> DataFrame:
    """Macro averages and the upper median of F1; the median is selected by counts, no list of scores is made."""
    rows = scores.agg(F.count(F.lit(1)).alias("documents"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("mean_f1"))
    return rows.withColumn("median_f1", F.lit(upper_median_of(scores, "f1")).cast("double"))


def uplift(without: DataFrame, with_model: DataFrame) -> DataFrame:
    """Mean F1 without and with a model over the documents that both have."""
    both = without.select("doc_id", F.col("f1").alias("a")).join(with_model.select("doc_id", F.col("f1").alias("b")), "doc_id")
    return both.agg(F.count(F.lit(1)).alias("documents"), F.avg("a").alias("without_model"), F.avg("b").alias("with_model"))


def placement_scores(entries: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, exact, near, missed, wrong_level of contents entries with a true page (``page_index``) against the first heading of the same title."""
    f = found.groupBy("doc_id", "title").agg(F.min_by(F.struct("page_index", "level"), "seq").alias("f"))
    rows = entries.join(f, ["doc_id", "title"], "left")
    away = F.abs(F.col("f.page_index") - F.col("page_index"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(away == 0).alias("exact"), F.count_if(away <= 1).alias("near"), F.count_if(F.col("f").isNull()).alias("missed"), F.count_if(F.col("f.level") != F.col("level")).alias("wrong_level"))


def good_truth(truth: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, book of true outlines fit for scoring: five entries, few junk, short or misplaced titles, most titles distinct."""
    title = F.trim("title")
    junk, short = title.rlike(r"(?i)^(?:page|slide|untitled|cover)?\s*[0-9]*$"), F.length(F.regexp_replace(title, r"[^\p{L}\p{N}_]", "")) < 3
    rows = truth.join(documents.select("doc_id", "page_count"), "doc_id")
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    n = rows.groupBy("doc_id", "page_count").agg(F.count(F.lit(1)).alias("n"), share(junk).alias("junk"), share(short).alias("short"), share((F.col("page") < 1) | (F.col("page") > F.col("page_count"))).alias("misplaced"), (F.countDistinct(F.lower("title")) / F.count(F.lit(1))).alias("distinct"))
    return n.filter("n >= 5 and junk <= 0.15 and short <= 0.15 and misplaced <= 0.1 and distinct >= 0.75").select("doc_id", (F.col("page_count") >= 60).alias("book"))


def outcomes(rows: DataFrame) -> DataFrame:
    """Files by status."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, page_count, seq, level, title, page of true outlines in JSON: a list of objects with file, pages and toc, whose
    items are [level, title, page from 1]."""
    raw = spark.read.option("multiLine", "true").schema("file string, pages int, toc array<array<string>>").json(path)
    rows = raw.select(F.xxhash64("file").alias("doc_id"), "file", F.col("pages").alias("page_count"), F.posexplode("toc").alias("p", "t"))
    item = lambda i: F.get("t", F.lit(i))
    return rows.select("doc_id", "file", "page_count", (F.col("p") + 1).alias("seq"), item(0).cast("int").alias("level"), item(1).alias("title"), item(2).cast("int").alias("page"))


def by_source(sources: DataFrame) -> DataFrame:
    """Documents and mean agreement of each chosen source."""
    return sources.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.avg("agree").alias("agree"))
