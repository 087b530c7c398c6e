"""ZIP archives and EPUB books from ``binaryFile`` rows."""

from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.markup import attribute, decode_entities, resolve, resolve_path, strip_tags
from ..operators.fold import each_file
from ..operators.tree import rebase_levels
from ..schemas import ZIP_ENTRY

EPUB, PDF = "application/epub+zip", "application/pdf"


def targets(spark: SparkSession, path: str, pattern: str = "*.{pdf,epub}") -> DataFrame:
    """doc_id, path, mime, content: the PDF and EPUB files below ``path``; one folder is listed once, so each path is there once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    head = F.substring("content", 1, 4)
    mime = F.when(head == F.lit(b"%PDF"), PDF).when(head == F.lit(b"PK\x03\x04"), EPUB)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", mime.alias("mime"), "content").filter("mime is not null")


def zip_entries(files: DataFrame) -> DataFrame:
    """A row per entry of each archive (doc_id, content); the central directory's sizes count. A broken archive has no rows."""

    def entries(doc_id, content):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                found = z.infolist()
        except (zipfile.BadZipFile, ValueError):
            return
        if any(max(e.compress_size, e.file_size, e.header_offset) >= 0xFFFFFFFF for e in found):
            return  # 64-bit archives are not read
        for i, e in enumerate(found):
            at = e.header_offset
            start = at + 30 + int.from_bytes(content[at + 26 : at + 28], "little") + int.from_bytes(content[at + 28 : at + 30], "little")
            yield doc_id, i, e.filename, e.compress_type, e.flag_bits, e.CRC, e.compress_size, e.file_size, content[start : start + e.compress_size]

    return each_file(files.select("doc_id", "content"), entries, ZIP_ENTRY)


def inflate_entry(method: int, raw: bytes) -> bytes | None:
    """Bytes of a stored or deflated entry; null for other methods or damaged data."""
    try:
        return raw if method == 0 else zlib.decompress(raw, -15) if method == 8 else None
    except zlib.error:
        return None


def entry_texts(entries: DataFrame) -> DataFrame:
    rows = each_file(entries.select("doc_id", "name", "method", "raw"), lambda doc_id, name, method, raw: [(doc_id, name, inflate_entry(method, raw))], "doc_id long, path string, data binary")
    return rows.select("doc_id", "path", F.decode("data", "UTF-8").alias("text"))


def texts_of(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the entries whose doc_id and path are in ``wanted``; no others are unpacked."""
    return entry_texts(entries.join(wanted.select("doc_id", F.col("path").alias("name")).distinct(), ["doc_id", "name"], "left_semi"))


def books(entries: DataFrame) -> DataFrame:
    """doc_id, opf, opf_text, manifest (array of id, path, type, properties), nav and ncx paths of each EPUB."""
    texts = entry_texts(entries.filter("name = 'META-INF/container.xml' or lower(name) like '%.opf'"))
    root = texts.filter("path = 'META-INF/container.xml'").select("doc_id", attribute(F.regexp_extract("text", r"(?is)<rootfile\b[^>]*>", 0), "full-path").alias("opf"))
    opf = root.join(texts.select("doc_id", F.col("path").alias("opf"), F.col("text").alias("opf_text")), ["doc_id", "opf"])
    items = opf.select("doc_id", "opf", "opf_text", F.explode(F.regexp_extract_all("opf_text", F.lit(r"(?is)<(?:\w+:)?item\b[^>]*>"), 0)).alias("tag"))
    items = items.select("doc_id", "opf", "opf_text", attribute(F.col("tag"), "id").alias("id"), resolve_path("opf", attribute(F.col("tag"), "href")).alias("path"), attribute(F.col("tag"), "media-type").alias("type"), attribute(F.col("tag"), "properties").alias("properties"))
    nav = F.array_contains(F.split(F.coalesce("properties", F.lit("")), r"\s+"), "nav")
    ncx = F.col("type") == "application/x-dtbncx+xml"
    return items.groupBy("doc_id", "opf", "opf_text").agg(F.collect_list(F.struct("id", "path", "type", "properties")).alias("manifest"), F.min(F.when(nav, F.col("path"))).alias("nav"), F.min(F.when(ncx, F.col("path"))).alias("ncx"))


def spine(opened: DataFrame) -> DataFrame:
    """doc_id, pos, path in reading order."""
    refs = opened.select("doc_id", "manifest", F.posexplode(F.regexp_extract_all("opf_text", F.lit(r"(?is)<(?:\w+:)?itemref\b[^>]*>"), 0)).alias("pos", "tag"))
    refs = refs.withColumn("id", attribute(F.col("tag"), "idref"))
    return refs.select("doc_id", "pos", F.explode(F.filter("manifest", lambda m: m["id"] == F.col("id"))).alias("m")).select("doc_id", "pos", "m.path")


def toc_count(markup):
    """Links in the contents list of a navigation document (in all of it, if none is marked), or points of an NCX."""
    nav = F.regexp_extract(markup, r"(?is)<nav\b[^>]*(?:epub:type|role)\s*=\s*[\"'][^\"']*toc[^\"']*[\"'][^>]*>(.*?)</nav\s*>", 1)
    where = F.when(nav != "", nav).otherwise(markup)
    return F.when(F.contains(markup, F.lit("<navPoint")), F.regexp_count(markup, F.lit(r"<navPoint\b"))).otherwise(F.regexp_count(where, F.lit(r"(?i)<a\b[^>]*\bhref"))).cast("long")


def contents_links(entries: DataFrame) -> DataFrame:
    """doc_id, pos, depth (from 1), text, path, anchor (null without one) of the contents list that each book has: of its navigation document, else of its NCX."""
    lists = cut(books(entries).select("doc_id", F.coalesce("nav", "ncx").alias("path")))
    lists = lists.join(texts_of(entries, lists), ["doc_id", "path"])
    nav = F.regexp_extract("text", r"(?is)<nav\b[^>]*(?:epub:type|role)\s*=\s*[\"'][^\"']*toc[^\"']*[\"'][^>]*>(.*?)</nav\s*>", 1)
    parts = F.split(F.when(nav != "", nav).otherwise(F.col("text")), r"(?i)<(?:li|navPoint)\b[^>]*>")
    rows = lists.select("doc_id", F.col("path").alias("home"), F.posexplode(parts).alias("pos", "part"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("closed", F.coalesce(F.sum(F.regexp_count("part", F.lit(r"(?i)</(?:li|navPoint)\s*>"))).over(before), F.lit(0))).filter("pos > 0")
    label = F.regexp_extract("part", r"(?is)<(a|text)\b[^>]*>(.*?)</\1\s*>", 2)
    href = attribute(F.regexp_extract("part", r"(?is)<(?:a|content)\b[^>]*>", 0), "(?:href|src)")
    rows = rows.select("doc_id", (F.col("pos") - 1).alias("pos"), (F.col("pos") - F.col("closed")).cast("int").alias("depth"), decode_entities(strip_tags(label)).alias("text"), "home", href.alias("href"))
    return rows.select("doc_id", "pos", "depth", "text", resolve_path("home", "href").alias("path"), F.nullif(F.regexp_extract("href", "#(.*)$", 1), F.lit("")).alias("anchor"))


def headings(pages: DataFrame, rebase: bool = True) -> DataFrame:
    """Headings h1 to h6 of markup rows (doc_id, pos, path, text): decoded, not empty, 300 characters at most; the least level becomes 1."""
    found = F.regexp_extract_all("text", F.lit(r"(?is)<(h[1-6])\b[^>]*>.*?</\1\s*>"), 0)
    rows = pages.select("doc_id", "pos", "path", F.posexplode(found).alias("h_pos", "tag"))
    open_ = F.regexp_extract("tag", r"(?is)^<h[1-6]\b[^>]*>", 0)
    inner = F.regexp_replace(F.regexp_replace("tag", r"(?is)^<h[1-6]\b[^>]*>", ""), r"(?is)</h[1-6]\s*>$", "")
    rows = rows.select("doc_id", F.col("pos").alias("spine_pos"), "h_pos", F.substring("tag", 3, 1).cast("int").alias("level"), F.trim(F.regexp_replace(decode_entities(strip_tags(inner)), r"[\s ]+", " ")).alias("text"), "path", attribute(open_, "id").alias("anchor"))
    rows = rows.filter("text <> '' and length(text) <= 300")
    return rebase_levels(rows) if rebase else rows


def epub_headings(entries: DataFrame) -> DataFrame:
    """Headings of every book in spine order."""
    order = spine(books(entries))
    return headings(order.join(texts_of(entries, order), ["doc_id", "path"]))


def unanchored(rows: DataFrame) -> DataFrame:
    """Adds ``target``: the anchor of a heading, or one named after its place where it has none."""
    name = F.format_string("toc-%d-%d", "spine_pos", "h_pos")
    return rows.withColumn("target", F.coalesce("anchor", name))


def pages_headings(pages: DataFrame) -> DataFrame:
    """Headings of web pages (page_id, html)."""
    rows = pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("pos"), F.lit("").alias("path"), F.col("html").alias("text"))
    return headings(rows)


def in_order(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("spine_pos", "h_pos")))


__all__ = ["books", "contents_links", "entry_texts", "epub_headings", "headings", "in_order", "inflate_entry", "pages_headings", "resolve", "spine", "targets", "texts_of", "toc_count", "unanchored", "zip_entries"]
