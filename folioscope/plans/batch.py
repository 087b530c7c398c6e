"""A folder of PDF and EPUB files from gate to written outline, as one plan with an outcome for each file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import predicates as P
from ..operators.layout import group_lines
from ..sinks import epub as epub_sink
from ..sinks import pdf as pdf_sink
from ..sinks.replaced import KEPT
from ..sources import archive, formats, pdf
from ..sources.lines import with_heights
from . import outline

OUTCOME = ["doc_id", "path", "status", "message", "headings", "used_model"]


@dataclass(frozen=True)
class Preferences:
    """What a user may set; ``of`` takes what the session names as ``folioscope.<name>`` and these values otherwise."""

    overwrite: bool = False
    pages: int = pdf.MAX_PAGES
    deepening: bool = True
    mode: str = "auto"
    contract: str = "edit"
    least: int = 2
    epub_entries: int = 5
    kept: str = KEPT
    write: bool = True

    @classmethod
    def of(cls, spark: SparkSession) -> Preferences:
        read = {"bool": lambda v: v.strip().lower() in ("true", "1", "yes"), "int": int, "str": str}
        given = {f.name: (spark.conf.get(f"folioscope.{f.name}", None), read[str(f.type)]) for f in fields(cls)}
        return cls(**{name: cast(value) for name, (value, cast) in given.items() if value is not None})


def gated(files: DataFrame, preferences: Preferences) -> DataFrame:
    """doc_id, path, mime, status, message: ``skipped`` with the first reason, ``error`` for an unreadable file, or null."""
    seen = pdf.inspect(files.filter(F.col("mime") == archive.PDF)).select("doc_id", "readable", "encrypted", "has_outline", "message")
    entries = cut(archive.zip_entries(files.filter(F.col("mime") == archive.EPUB)))
    lists = cut(archive.books(entries).select("doc_id", F.coalesce("nav", "ncx").alias("path")))
    lists = lists.join(archive.texts_of(entries, lists), ["doc_id", "path"], "left")
    enough = F.coalesce(archive.toc_count(F.col("text")) >= preferences.epub_entries, F.lit(False))
    null = F.lit(None).cast("string")
    seen = seen.unionByName(lists.select("doc_id", F.lit(True).alias("readable"), F.lit(False).alias("encrypted"), enough.alias("has_outline"), null.alias("message")))
    rows = files.select("doc_id", "path", "mime").join(seen, "doc_id", "left").withColumn("readable", F.coalesce("readable", F.lit(False)))
    reason = P.gate(F.col("mime"), F.lit(True), F.lit(True), F.coalesce("encrypted", F.lit(False)), F.coalesce("has_outline", F.lit(False)), preferences.overwrite)
    status = F.when(~F.col("readable"), "error").when(reason.isNotNull(), "skipped")
    return rows.select("doc_id", "path", "mime", status.alias("status"), F.when(~F.col("readable"), F.coalesce("message", F.lit("unreadable"))).otherwise(reason).alias("message"))


def process_files(files: DataFrame, preferences: Preferences | None = None, provider: Callable[[str], str] | None = None) -> DataFrame:
    """doc_id, path, status (ok, skipped or error), message, headings, used_model of each file (doc_id, path, mime, content). Files that are ``ok`` have
    their outline now, unless the preferences forbid writing; all take effect together at the end of the job."""
    spark = files.sparkSession
    preferences = preferences or Preferences.of(spark)
    gates = cut(gated(files, preferences))
    work = files.join(gates.filter("status is null").select("doc_id"), "doc_id", "left_semi")
    papers, books = work.filter(F.col("mime") == archive.PDF), work.filter(F.col("mime") == archive.EPUB)
    pages = cut(pdf.pages(papers, preferences.pages))
    found = outline.run(with_heights(group_lines(pdf.fragments(papers, preferences.pages), pages), pages), pages, preferences.deepening)
    headings, used = found.headings, None
    if provider is not None:
        headings, used = outline.refined(found, provider, preferences.mode, preferences.contract)
    headings = cut(headings.select("doc_id", "title", "level", "page_index", "y"))
    chapters = cut(archive.epub_headings(archive.zip_entries(books)))
    counts = headings.select("doc_id").unionByName(chapters.select("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("headings"))
    counts = cut(counts)
    many = counts.filter(F.col("headings") >= preferences.least).select("doc_id")
    made = pdf_sink.write_outlines(papers.join(many, "doc_id", "left_semi"), headings.join(many, "doc_id", "left_semi"))
    made = cut(made.unionByName(epub_sink.write_all(books.join(many, "doc_id", "left_semi"), chapters.join(many, "doc_id", "left_semi"))))
    if preferences.write:
        formats.register(spark)
        done = made.filter("status = 'ok'").join(gates.select("doc_id", "path"), "doc_id").select("path", "content")
        done.write.format("replaced_files").option("kept", preferences.kept).mode("append").save()
    rows = gates.join(counts, "doc_id", "left").join(made.select("doc_id", F.col("status").alias("_s"), F.col("message").alias("_m")), "doc_id", "left")
    rows = rows.join(used.select("doc_id", F.col("used").alias("used_model")), "doc_id", "left") if used is not None else rows.withColumn("used_model", F.lit(False))
    few = F.format_string("fewer than %d headings", F.lit(preferences.least))
    status = F.coalesce("status", "_s", F.lit("skipped"))
    message = F.when(F.col("status").isNotNull(), F.col("message")).when(F.col("_s").isNull(), few).otherwise(F.col("_m"))
    return rows.select("doc_id", "path", status.alias("status"), message.alias("message"), F.coalesce("headings", F.lit(0)).alias("headings"), F.coalesce("used_model", F.lit(False)).alias("used_model"))


def process(spark: SparkSession, path: str, preferences: Preferences | None = None, provider: Callable[[str], str] | None = None) -> DataFrame:
    """The files below ``path``."""
    return process_files(archive.targets(spark, path), preferences, provider)
