"""Files made from tables, and readers of the contents that files already have."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators import fold
from folioscope.plans import files
from folioscope.sinks import epub, pdf as pdf_sink
from folioscope.sources import archive, pdf


@pytest.mark.parametrize("packed", [False, True])
def test_made_pdf_files_are_read_back(packed):
    made = [["a (b) \\ c", "(", "100% <x>"], [")", "last"], ["third"]]
    found = pdf.Pdf.open(files.pdf_file(made, packed))
    assert found.xref_stream == packed and not found.has_outline and not found.encrypted
    assert [[t[0] for t in pdf.page_fragments(found, page)] for _, page in found.pages()] == made
    rows = [{"seq": i, "parent_seq": p, "title": t, "page_index": i - 1, "y": 700} for i, p, t in ((1, None, "Été"), (2, 1, "😀"), (3, None, "c"))]
    written = pdf_sink.write_outline(files.pdf_file(made, packed), rows)
    assert pdf_sink.existing_outline(written) == [(1, "Été", 1), (2, "😀", 2), (1, "c", 3)] and pdf.Pdf.open(written).has_outline


def test_documents_as_files(spark):
    rows = [(1, "one two\x0bthree é\U0001f600 (x)"), (2, " \n\t"), (3, None), (4, ""), (None, "no id"), (5, "w " * 2050)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"content": F.lit("clash"), "lines": F.lit("clash"), "words": F.lit(1)})
    made = files.pdf_files(docs)
    got = pdf.fragments(made).collect()
    assert [(r.page_index, r.text, r.x, r.y) for r in got if r.doc_id == 1] == [(0, "one two three ?? (x)", 72.0, 720.0)]
    assert {r.doc_id for r in got} == {1, 5} and max(r.page_index for r in got) == 20 and sum(len(r.text.split()) for r in got if r.doc_id == 5) == 2050
    outlines = files.written_outlines(docs).collect()
    assert [(r.seq, r.level, r.page) for r in sorted(outlines, key=lambda r: r.seq)] == [(i + 1, i % 3 + 1, i + 1) for i in range(21)] and {r.doc_id for r in outlines} == {5}
    assert files.written_outlines(docs.limit(0)).count() == 0
    broken = made.withColumn("content", F.lit(b"junk"))
    assert pdf_sink.existing_outlines(broken).count() == 0 and not any(r.readable for r in pdf.inspect(broken).collect())


def book(more: dict, items: str) -> bytearray:
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", "<rootfile full-path='OPS/p.opf'/>")
        z.writestr("OPS/p.opf", f"<package><manifest>{items}</manifest><spine/></package>")
        for name, text in more.items():
            z.writestr(name, text)
    return bytearray(box.getvalue())


def test_contents_that_books_have(spark):
    nav = (
        "<a href='x'>before</a><nav epub:type='landmarks'><ol><li><a href='y'>no</a></li></ol></nav><nav class='c' epub:type=\"toc\"><h1>In it</h1>"
        "<ol><li><a class='k' href='../a%20b.xhtml#one'>A &amp; <i>B</i></a><ol><li><a href=\"c.xhtml\">C</a><ol><li><a href='#d'>D</a></li></ol></li></ol></li><li class='z'><span>E</span></li></ol></nav>"
    )
    ncx = "<navMap><navPoint id='1'><navLabel><text>One</text></navLabel><content src='a.xhtml#p'/><navPoint><navLabel><text>Two &#233;</text></navLabel><content src='b.xhtml'/></navPoint></navPoint><navPoint><navLabel><text>Three</text></navLabel><content src='c.xhtml#'/></navPoint></navMap>"
    both = "<item id='n' href='nav.xhtml' properties='scripted nav'/><item id='x' href='t.ncx' media-type='application/x-dtbncx+xml'/>"
    rows = [(1, book({"OPS/nav.xhtml": nav, "OPS/t.ncx": ncx}, both)), (2, book({"OPS/t.ncx": ncx}, both.split("/>")[1] + "/>")), (3, book({}, "<item id='a' href='a.xhtml'/>")), (4, bytearray(b"junk"))]
    links = archive.contents_links(archive.zip_entries(spark.createDataFrame(rows, "doc_id long, content binary"))).collect()
    found = lambda d: [tuple(r)[2:] for r in sorted(links, key=lambda r: r.pos) if r.doc_id == d]
    assert found(1) == [(1, "A & B", "a b.xhtml", "one"), (2, "C", "OPS/c.xhtml", None), (3, "D", "OPS/nav.xhtml", "d"), (1, "", None, None)]
    assert found(2) == [(1, "One", "OPS/a.xhtml", "p"), (2, "Two é", "OPS/b.xhtml", None), (1, "Three", "OPS/c.xhtml", None)]
    assert {r.doc_id for r in links} == {1, 2}


def test_pages_as_books(spark):
    rows = [(i, f"<h1>Page {i}</h1><p>Short one.</p><p>Two. Parts.</p>") for i in range(9)] + [(9, None), (None, "<h1>x</h1>"), (40, "no heading")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    made = files.epub_files(pages)
    assert sorted(r.doc_id for r in made.collect()) == [-11, -3, -2, -1]
    found = archive.epub_headings(archive.zip_entries(made))
    assert sorted((r.spine_pos, r.level, r.text, r.anchor) for r in found.filter("doc_id = -3").collect()) == [(0, 1, "Page 8", "top"), (0, 3, "Short one.", None)]
    written = epub.write_all(made, found)
    assert {r.doc_id: r.status for r in written.collect()} == {-1: "ok", -2: "ok", -3: "ok", -11: "skipped"}
    links = archive.contents_links(archive.zip_entries(written.filter("status = 'ok'")))
    assert [(r.depth, r.text, r.path, r.anchor) for r in links.filter("doc_id = -2").orderBy("pos").limit(3).collect()] == [(1, "Page 4", "OEBPS/c4.xhtml", "top"), (2, "Short one.", "OEBPS/c4.xhtml", "toc-0-1"), (1, "Page 5", "OEBPS/c5.xhtml", "toc-1-0")]


def test_file_results_are_handed_on_by_bytes(spark):
    import pyarrow as pa

    sizes = [b.num_rows for b in fold.by_bytes(((i, b"x" * 3_000_000) for i in range(7)), pa.schema([("i", pa.int64()), ("x", pa.binary())]))]
    assert sizes == [3, 3, 1]
    # one batch of small archives with large entries: before, all their bytes were one batch of results
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.html", "<p>" + "a" * 2_000_000)
    entries = archive.zip_entries(spark.createDataFrame([(i, box.getvalue()) for i in range(40)], "doc_id long, content binary").coalesce(1))
    seen = archive.each_file(entries.select("doc_id", "method", "raw"), lambda d, m, r: [(d, archive.inflate_entry(m, r))], "doc_id long, data binary")
    counted = seen.mapInArrow(lambda stream: (pa.record_batch({"n": pa.array([b.num_rows], pa.int64())}) for b in stream), "n long").collect()
    assert sum(r.n for r in counted) == 40
    assert {r.n for r in archive.entry_texts(entries).selectExpr("length(text) as n").collect()} == {2_000_003}


def test_object_streams_and_fonts_are_read_once_for_all_pages(monkeypatch):
    inflated, fonts = [], []
    inflate, font = pdf.inflate, pdf._Font.__init__
    monkeypatch.setattr(pdf, "inflate", lambda raw: inflated.append(1) or inflate(raw))
    monkeypatch.setattr(pdf._Font, "__init__", lambda self, *args: fonts.append(1) or font(self, *args))
    made = [[f"page {i}"] for i in range(40)]
    found = pdf.Pdf.open(files.pdf_file(made, True))
    assert [[t[0] for t in pdf.page_fragments(found, page)] for _, page in found.pages()] == made
    # the cross-reference stream, the object stream, and the contents of every other page
    assert len(inflated) == 2 + 20 and len(fonts) == 1


def test_texts_are_cut_once_and_by_all_cores(spark):
    docs = spark.createDataFrame([(1, "w " * 2050)], "doc_id long, text string").coalesce(1)
    assert files.pdf_files(docs).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = files.written_outlines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and not any("lambdafunction(array_join" in line for line in plan.splitlines() if "Filter" in line)
