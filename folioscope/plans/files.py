"""PDF files and EPUB books made from text tables, one task for each part of the table, and queries that read, judge and rewrite them.

A document becomes a PDF file: lines of ``LINE_WORDS`` words, pages of ``PAGE_LINES`` lines. Files with an even id have a plain cross-reference
table, the others keep their page objects in a compressed object stream; contents are compressed on every other page, strings are literal on
every other line. ``BOOK_PAGES`` web pages become an EPUB book, with a navigation document, an NCX or neither.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..sinks import epub as epub_sink
from ..sinks import pdf as pdf_sink
from ..sources import archive, pdf
from . import batch
from .queries import ORACLE_SQL, QUERIES, query, table

LINE_WORDS, PAGE_LINES, BOOK_PAGES = 10, 10, 4
#: Files that a task hands on at once.
FLUSH_BYTES = 8 << 20
FILES = "doc_id long, mime string, content binary"
BLANKS = r"[ \t\n\x0B\f\r]+"


def _object(number: int, body: bytes) -> bytes:
    return b"%d 0 obj\n%s\nendobj\n" % (number, body)


def _stream(data: bytes, more: bytes = b"") -> bytes:
    return b"<<%s /Length %d>>\nstream\n%s\nendstream" % (more, len(data), data)


def pdf_file(pages: list[list[str]], packed: bool) -> bytes:
    """Pages of lines in ASCII; ``packed``: page objects in an object stream and a cross-reference stream."""
    n = len(pages)
    head = {1: b"<</Type /Catalog /Pages 2 0 R>>", 3: b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>"}
    head[2] = b"<</Type /Pages /Count %d /MediaBox [0 0 612 792] /Resources <</Font <</F1 3 0 R>>>> /Kids [%s]>>" % (n, b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(n)))
    whole = {}
    for i, page in enumerate(pages):
        head[4 + 2 * i] = b"<</Type /Page /Parent 2 0 R /Contents %d 0 R>>" % (5 + 2 * i)
        show = lambda k, t: b"(%s) Tj" % re.sub(rb"([\\()])", rb"\\\1", t.encode()) if k % 2 else b"<%s> Tj" % t.encode().hex().encode()
        content = b"\n".join(b"BT /F1 10 Tf 1 0 0 1 72 %d Tm %s ET" % (720 - 14 * k, show(k, t)) for k, t in enumerate(page))
        whole[5 + 2 * i] = _stream(zlib.compress(content), b" /Filter /FlateDecode") if i % 2 else _stream(content)
    out, at = bytearray(b"%PDF-1.5\n"), {}
    if packed:
        bodies = [head[k] for k in sorted(head)]
        starts = [0]
        for b in bodies:
            starts.append(starts[-1] + len(b) + 1)
        index = b" ".join(b"%d %d" % (k, s) for k, s in zip(sorted(head), starts, strict=False)) + b" "
        holder = 4 + 2 * n
        whole[holder] = _stream(zlib.compress(index + b"\n".join(bodies)), b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(bodies), len(index)))
    else:
        whole |= head
    for k in sorted(whole):
        at[k] = len(out)
        out += _object(k, whole[k])
    start = len(out)
    if packed:
        inside = {k: i for i, k in enumerate(sorted(head))}
        at[holder + 1] = start
        rows = [b"\x00" + bytes(6)] + [b"\x02" + holder.to_bytes(4, "big") + inside[k].to_bytes(2, "big") if k in inside else b"\x01" + at[k].to_bytes(4, "big") + bytes(2) for k in range(1, holder + 2)]
        out += _object(holder + 1, _stream(zlib.compress(b"".join(rows)), b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Filter /FlateDecode" % (holder + 2)))
    else:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % at[k] for k in sorted(at)) + b"trailer\n<</Size %d /Root 1 0 R>>\n" % (len(at) + 1)
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def epub_file(number: int, chapters: list[tuple[int, str]]) -> bytes:
    """A book of markup by page id: with a navigation document of ``number % 8`` links, an NCX of as many points, or neither, in turn."""
    names = [f"c{i}.xhtml" for i, _ in chapters]
    items = [f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for n, (i, _) in zip(names, chapters, strict=True)]
    links = [names[k % len(names)] for k in range(number % 8)]
    more = {}
    if number % 3 == 0:
        items.append('<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>')
        more["OEBPS/nav.xhtml"] = '<html><body><nav epub:type="toc"><h2>Contents</h2><ol>' + "".join(f'<li><a href="{n}">old</a></li>' for n in links) + "</ol></nav></body></html>"
    elif number % 3 == 1:
        items.append('<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>')
        more["OEBPS/toc.ncx"] = "<ncx><navMap>" + "".join(f'<navPoint id="o{k}"><navLabel><text>old</text></navLabel><content src="{n}"/></navPoint>' for k, n in enumerate(links)) + "</navMap></ncx>"
    opf = f'<package><manifest>{"".join(items)}</manifest><spine>{"".join(f"<itemref idref=\"c{i}\"/>" for i, _ in chapters)}</spine></package>'
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", archive.EPUB, zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/p.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", opf)
        for name, (_, markup) in zip(names, chapters, strict=True):
            z.writestr(f"OEBPS/{name}", markup)
        for name, text in more.items():
            z.writestr(name, text)
    return box.getvalue()


def _files(rows: DataFrame, mime: str, make) -> DataFrame:
    """doc_id, mime, content, made by ``make`` from each row as a dict."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, made, size = [], [], 0
        flush = lambda: pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "mime": pa.array([mime] * len(ids)), "content": pa.array(made, pa.binary())})
        for b in stream:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids.append(row["doc_id"])
                made.append(make(row))
                size += len(made[-1])
                if size >= FLUSH_BYTES:
                    yield flush()
                    ids, made, size = [], [], 0
        if ids:
            yield flush()

    return rows.mapInArrow(run, FILES)


def word_lines(documents: DataFrame) -> DataFrame:
    """doc_id, lines (array of ``LINE_WORDS`` words each) of documents with a word."""
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    rows = documents.filter("doc_id is not null and text is not null").select("doc_id", words.alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / LINE_WORDS).cast("int"))
    return rows.select("doc_id", F.transform(starts, lambda i: F.array_join(F.slice("words", i * LINE_WORDS + 1, F.lit(LINE_WORDS)), " ")).alias("lines"))


def spread(documents: DataFrame) -> DataFrame:
    """Ids and texts, dealt out to all cores: files take long to make and read, and a small table may come as one part."""
    some = documents.select("doc_id", "text")
    return some.repartition(max(some.rdd.getNumPartitions(), 3 * some.sparkSession.sparkContext.defaultParallelism), F.xxhash64("doc_id", "text"))


def pdf_files(documents: DataFrame) -> DataFrame:
    """A PDF file for each document; characters outside ASCII are question marks in it."""
    rows = word_lines(spread(documents)).select("doc_id", F.transform("lines", lambda t: F.regexp_replace(t, r"[^\x20-\x7E]", "?")).alias("lines"))
    return _files(rows, archive.PDF, lambda r: pdf_file([r["lines"][i : i + PAGE_LINES] for i in range(0, len(r["lines"]), PAGE_LINES)], r["doc_id"] % 2 == 1))


def chapters(pages: DataFrame) -> DataFrame:
    """page_id, html: pages with ids at the headings of even ones, and paragraphs of one short sentence as headings of level 3."""
    html = F.regexp_replace("html", r"<p>([^<.]{1,80})\.</p>", "<h3>$1.</h3>")
    return pages.filter("page_id is not null and html is not null").select("page_id", F.when(F.col("page_id") % 2 == 0, F.replace(html, F.lit("<h1>"), F.lit('<h1 id="top">'))).otherwise(html).alias("html"))


def epub_files(pages: DataFrame) -> DataFrame:
    """A book of each ``BOOK_PAGES`` pages; ids are negative, so that they differ from those of PDF files."""
    book = F.floor(F.col("page_id") / BOOK_PAGES)
    rows = chapters(pages).groupBy((-1 - book).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("held"))  # BOOK_PAGES at most
    return _files(rows, archive.EPUB, lambda r: epub_file(-1 - r["doc_id"], [(p["page_id"], p["html"]) for p in r["held"]]))


def written_outlines(documents: DataFrame) -> DataFrame:
    """Outlines, read back from the files they were written into, of the first lines of all pages."""
    # no document is without lines; a plain explode would ask so first, and cut the text anew for each line
    lines = word_lines(spread(documents)).select("doc_id", F.posexplode_outer("lines").alias("at", "title")).filter(F.col("at") % PAGE_LINES == 0)
    page = F.floor(F.col("at") / PAGE_LINES).cast("int")
    headings = lines.select("doc_id", "title", page.alias("page_index"), (page % 3 + 1).alias("level"), F.lit(720).alias("y"))
    made = pdf_sink.write_outlines(pdf_files(documents), headings).filter("status = 'ok'")
    return pdf_sink.existing_outlines(made)


# ---- the same in SQL
WORDS = rf"""wd as (select doc_id, list_filter(string_split_regex(text, '{BLANKS}'), lambda w: w <> '') as ws from documents where text is not null),
wl as (select doc_id, array_to_string(ws[i + 1 : i + {LINE_WORDS}], ' ') as title, (i // {LINE_WORDS})::int as k from (select doc_id, ws, unnest(range(0, len(ws), {LINE_WORDS})) as i from wd))"""
CHAPTERS = r"""ch as (select page_id, (-1 - page_id // 4)::bigint as doc_id, (page_id % 4)::int as spine_pos, 'OEBPS/c' || page_id || '.xhtml' as path, regexp_replace(html, '<p>([^<.]{1,80})\.</p>', '<h3>\1.</h3>', 'g') as html from pages where html is not null),
tg as (select *, case when page_id % 2 = 0 then replace(html, '<h1>', '<h1 id="top">') else html end as h from ch),
ta as (select *, regexp_extract_all(h, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>') as tags from tg), tu as (select doc_id, spine_pos, path, unnest(tags) as tag, (generate_subscripts(tags, 1) - 1)::int as h_pos from ta),
tv as (select doc_id, spine_pos, path, h_pos, substr(tag, 3, 1)::int as l, nullif(regexp_extract(tag, '(?is)^<h[1-6]\b[^>]*?\bid\s*=\s*"([^"]*)', 1), '') as anchor, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as t from tu),
tw as (select *, trim(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) as text from tv),
hd as (select doc_id, spine_pos, h_pos, (l - min(l) over (partition by doc_id) + 1)::int as level, text, path, anchor from tw where text <> '' and length(text) <= 300)"""
TREE = """hs as (select *, (row_number() over (partition by doc_id order by spine_pos, h_pos))::int as seq, count(*) over (partition by doc_id) as n from hd),
ht as (select *, (seq + least(0, min(level - seq) over (partition by doc_id order by seq)))::int as depth from hs where n >= 2)"""


@query(f"with {WORDS} select doc_id, (k // {PAGE_LINES})::int as page_index, (k % {PAGE_LINES})::int as frag_idx, regexp_replace(title, '[^\\x20-\\x7E]', '?', 'g') as text, 72.0::double as x, (720 - 14 * (k % {PAGE_LINES}))::double as y, 10.0::double as size from wl")
def pdf_texts(spark, sf_dir):
    """Documents as PDF files, back to text fragments with their places."""
    return pdf.fragments(pdf_files(table(spark, sf_dir, "documents"))).select("doc_id", "page_index", "frag_idx", "text", "x", "y", "size")


@query(f"with {WORDS}, n as (select doc_id, ceil(count(*) / {PAGE_LINES}.0)::int as pages from wl group by 1) select doc_id, true as readable, false as encrypted, false as has_outline, pages, doc_id % 2 = 1 as xref_stream from n")
def pdf_states(spark, sf_dir):
    return pdf.inspect(pdf_files(table(spark, sf_dir, "documents"))).drop("message")


@query(f"""with {WORDS}, h as (select doc_id, (row_number() over (partition by doc_id order by k))::int as seq, ((k // {PAGE_LINES}) % 3 + 1)::int as level, title, (k // {PAGE_LINES} + 1)::int as page, count(*) over (partition by doc_id) as n from wl where k % {PAGE_LINES} = 0)
select doc_id, seq, level, title, page from h where n >= 2""")
def pdf_outlines(spark, sf_dir):
    """Outlines written into the files of documents with two pages or more, and read from them."""
    return written_outlines(table(spark, sf_dir, "documents"))


@query(f"with {CHAPTERS} select * from hd")
def epub_chapters(spark, sf_dir):
    """Headings of books of web pages, in the order of their spines."""
    return archive.epub_headings(cut(archive.zip_entries(epub_files(table(spark, sf_dir, "pages")))))


@query(f"with {CHAPTERS}, {TREE} select doc_id, (seq - 1)::int as pos, depth, text, path, coalesce(anchor, 'toc-' || spine_pos || '-' || h_pos) as anchor from ht")
def epub_contents(spark, sf_dir):
    """Contents written into books in place of what they had, and read from them."""
    files = cut(epub_files(table(spark, sf_dir, "pages")))
    written = epub_sink.write_all(files, archive.epub_headings(cut(archive.zip_entries(files)))).filter("status = 'ok'")
    return archive.contents_links(cut(archive.zip_entries(written)))


@query(f"with {CHAPTERS}, {TREE} select doc_id, spine_pos, h_pos, level, text, path, coalesce(anchor, 'toc-' || spine_pos || '-' || h_pos) as anchor from ht")
def epub_anchors(spark, sf_dir):
    """Headings of the rewritten books: all have an anchor, and nothing else has changed."""
    files = cut(epub_files(table(spark, sf_dir, "pages")))
    written = epub_sink.write_all(files, archive.epub_headings(cut(archive.zip_entries(files)))).filter("status = 'ok'")
    return archive.epub_headings(cut(archive.zip_entries(written)))


@query(f"""with {WORDS}, b as (select distinct -1 - page_id // 4 as doc_id from pages where html is not null), k as (select doc_id, -1 - doc_id as number from b)
select distinct doc_id, 'application/pdf' as mime, null::varchar as status, null::varchar as message from wl
union all select doc_id, 'application/epub+zip', case when number % 3 < 2 and number % 8 >= 5 then 'skipped' end, case when number % 3 < 2 and number % 8 >= 5 then 'has outline' end from k""")
def gate_outcomes(spark, sf_dir):
    """Which files are let through, and why the others are not."""
    files = pdf_files(table(spark, sf_dir, "documents")).unionByName(epub_files(table(spark, sf_dir, "pages")))
    named = files.withColumn("path", F.format_string("%d", "doc_id"))
    return batch.gated(cut(named), batch.Preferences()).select("doc_id", "mime", "status", "message")


__all__ = ["ORACLE_SQL", "QUERIES", "chapters", "epub_file", "epub_files", "pdf_file", "pdf_files", "word_lines", "written_outlines"]
