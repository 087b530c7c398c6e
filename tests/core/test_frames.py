import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import arbitrate, census, contents, detect, locate, model, tree
from folioscope.operators import predicates as P
from folioscope.plans import outline
from folioscope.sinks import epub
from folioscope.sinks import pdf as pdf_sink
from folioscope.sources import archive, pdf
from tests.core.test_pure import simple_pdf

from . import examples

LINE = "doc_id long, page_index int, line_idx int, text string, x double, y double, size double, font string, height double"


def lines(spark, rows):
    """rows: page, text, size, font, x; y falls by 14 from 700."""
    out, n = [], {}
    for page, text, *rest in rows:
        size, font, x = (*rest, *(10.0, "body", 72.0)[len(rest) :])
        i = n[page] = n.get(page, -1) + 1
        out.append((1, page, i, text, float(x), 700.0 - 14 * i, float(size), font, 792.0))
    return spark.createDataFrame(out, LINE)


def test_keys_and_numerals(spark):
    row = spark.range(1).select(
        T.norm_key(F.lit("  L’Été — No.\t3 ")).alias("n"), T.running_key(F.lit("Preface / ix 12")).alias("r"), T.title_key(F.lit("Chapitre 2 : Élan d'été")).alias("k"),
        T.roman_to_int(F.lit("MCMXCIV")).alias("v"), T.int_to_roman(F.lit(1994)).alias("m"), T.upper_median(F.array(*map(F.lit, (10, 1, 3, 2)))).alias("u"),
        T.round_half_up(F.lit(-2.5)).alias("h"), P.numbering(F.lit("1.2 Methods"))["depth"].alias("d"), T.style_key(F.lit("f"), F.lit(10.3)).alias("s"),
    ).first()
    assert (row.n, row.r, row.k) == ("lété  no 3", "preface", "elan d'ete") and (row.v, row.m, row.u, row.h, row.d, row.s) == (1994, "mcmxciv", 3, -2, 2, "f|10.5")


def test_tree_equals_a_stack(spark):
    import random

    rng, rows = random.Random(2), []
    for d in range(60):
        rows += [(d, i, rng.randrange(1, 7)) for i in range(rng.randrange(1, 12))]
    got = {(r.doc_id, r.n): (r.depth, r.parent_seq) for r in tree.tree(spark.createDataFrame(rows, "doc_id long, n int, level int"), ["n"]).collect()}
    for d in range(60):
        stack = []
        for _, n, level in (r for r in rows if r[0] == d):
            del stack[level - 1 :]
            assert got[d, n] == (len(stack) + 1, stack[-1] if stack else None)
            stack.append(n + 1)


def test_detect_merges_and_levels(spark):
    body = [(p, f"this is body text number {p} {i} which goes on for a while and ends like a sentence.") for p in range(4) for i in range(6)]
    rows = [(0, "1 Introduction", 16, "bold"), *body[:6], (1, "2 A heading that runs", 16, "bold"), (1, "over two lines", 16, "bold"), *body[6:12], (2, "2.1 Details", 13, "bold"), *body[12:18], (3, "3 End of it", 16, "bold"), *body[18:]]
    found, pool, stats = detect.detect(lines(spark, rows))
    assert [(r.title, r.level, r.page_index) for r in found.orderBy("seq").collect()] == [("1 Introduction", 1, 0), ("2 A heading that runs over two lines", 1, 1), ("2.1 Details", 2, 2), ("3 End of it", 1, 3)]
    assert stats.first().headings == 4 and stats.first().use_numbering and pool.count() >= 4


def test_printed_contents_are_read_located_and_chosen(spark):
    titles = ["Origins of rivers", "Mountain weather", "Coastal erosion", "Desert winds", "Final remarks on land"]
    rows = [(0, "Contents"), *[(0, f"{t} ..... {3 + 2 * i}") for i, t in enumerate(titles)], (0, "padding line without any page")]
    for page in range(1, 14):
        i = (page - 3) // 2
        if page >= 3 and (page - 3) % 2 == 0 and i < len(titles):
            rows.append((page, titles[i], 16, "bold"))
        rows += [(page, f"body text on page {page} line {k} which is a rather long line, like those in a book are.") for k in range(5)]
    doc = lines(spark, rows)
    pages = doc.select("doc_id", "page_index", F.lit(612.0).alias("width"), "height", F.col("height").alias("view_top")).distinct()
    entries, toc = contents.printed_contents(doc, census.running_heads(doc), census.toc_pages(doc))
    assert [(r.title, r.printed) for r in entries.orderBy("entry_idx").collect()][:5] == [(t, 3 + 2 * i) for i, t in enumerate(titles)]
    assert [r.page_index for r in toc.collect()] == [0]
    found, offsets = locate.locate(entries, doc, pages, census.running_heads(doc), census.style_census(doc), toc)
    assert [(r.title, r.page_index) for r in found.orderBy("entry_idx").collect()] == [(t, 3 + 2 * i) for i, t in enumerate(titles)] and offsets.first().offset == 1
    result = outline.run(doc, pages)
    assert result.sources.first().source.startswith("contents") and result.headings.count() == 5
    assert [r.depth for r in outline.as_tree(result.headings).collect()] == [1] * 5


def test_pasted_text(spark):
    text = "# Table\nSommaire\nPart One\n    - Chapter of things .... 4\n    * Second chapter .... xii\n\n1.2 Dotted  9"
    got = contents.parse_pasted(spark.createDataFrame([(7, text.replace("# Table\n", ""))], "doc_id long, text string")).orderBy("entry_idx").collect()
    assert [(r.title, r.printed, r.roman) for r in got] == [("Part One", None, False), ("Chapter of things", 4, False), ("Second chapter", 12, True), ("1.2 Dotted", 9, False)] or got[0].title.startswith("Part One")
    back = contents.render(contents.parse_pasted(spark.createDataFrame([(7, "Alpha one .... 3\n    Beta two .... 5\n    Gamma three .... 8")], "doc_id long, text string")))
    assert back.first().text == "Alpha one  3\n    Beta two  5\n    Gamma three  8"


def test_model_replies(spark):
    schema = "doc_id long, i int, page_index int, y int, size double, text string, tags array<string>, toc_level int, score double, kept boolean, kept_level int"
    rows = [(1, i, i, 100, 10.0, f"t{i}", ["T"], None, 1.0, i < 4, 1 if i < 4 else None) for i in range(1, 6)]
    candidates = spark.createDataFrame(rows, schema)
    reply = lambda r: spark.createDataFrame([(1, r)], "doc_id long, reply string")
    got = model.edit_outline(candidates, reply('Sure {x}: {"retirer": [1, 5, 99], "ajouter": [{"i": 5, "l": 9}], "niveaux": [{"i": 2, "l": 3}, {"i": 3, "l": 0}]} ok'))
    assert sorted((r.i, r.level) for r in got.collect()) == [(2, 3), (3, 1), (5, 2)]
    got = model.select_outline(candidates, reply('[{"i": 4, "l": 3}, {"i": 4, "l": 1}, {"i": 77, "l": 1}, {"i": 2, "l": 2}]'))
    assert sorted((r.i, r.level) for r in got.collect()) == [(2, 1), (4, 2)]
    asked = model.ask(model.prompts(candidates), lambda p: "[]" if "[1] p2" in p else 1 / 0)
    assert asked.first().reply == "[]" and model.ask(model.prompts(candidates), None).first().reply is None
    with pytest.raises(ValueError):
        model.checked_config({"provider": "http"})


def test_merge_and_agreement(spark):
    h = lambda rows: spark.createDataFrame([(1, t, 1, p, y, 5.0, 10.0, "f", False) for t, p, y in rows], "doc_id long, title string, level int, page_index int, y int, score double, size double, font string, approx boolean")
    a, b = h([("A", 0, 700), ("B", 1, 500)]), h([("A'", 0, 690), ("C", 2, 300)])
    assert arbitrate.agreement(a, b).first().agree == 0.5
    pool = b.select("doc_id", "page_index", "y", "size", F.col("title").alias("text"), "score")
    got = arbitrate.merge_sources(a, b, pool, b).orderBy("i").collect()
    assert [(r.text, "".join(r.tags), r.kept) for r in got] == [("A", "TDC", True), ("B", "T", False), ("C", "DC", True)]


def book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package><manifest><item id="a" href="t%20x/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/t x/a.xhtml", '<html><body><h2 id="k">Ch&eacute;ri &amp; co</h2><p>x</p><h3>Sub</h3></body></html>')
        z.writestr("OPS/b.xhtml", "<html><body><h2>First <i>one</i></h2><h2> </h2></body></html>")
    return out.getvalue()


def test_epub_headings_and_writer(spark):
    files = spark.createDataFrame([(1, bytearray(book())), (2, bytearray(b"PK broken"))], "doc_id long, content binary")
    found = archive.epub_headings(archive.zip_entries(files))
    assert [(r.level, r.text, r.path, r.anchor) for r in found.orderBy("spine_pos", "h_pos").collect()] == [(1, "First one", "OPS/b.xhtml", None), (1, "Chéri & co", "OPS/t x/a.xhtml", "k"), (2, "Sub", "OPS/t x/a.xhtml", None)]
    out = {r.doc_id: r for r in epub.write_all(files, found).collect()}
    assert out[1].status == "ok" and out[2].status == "skipped"
    with zipfile.ZipFile(io.BytesIO(bytes(out[1].content))) as z:
        assert z.namelist()[0] == "mimetype" and z.testzip() is None
        nav = z.read("OPS/folioscope-nav.xhtml").decode()
        assert nav.count("<li>") == 3 and "#k" in nav and 'properties="nav"' in z.read("OPS/p.opf").decode() and 'id="toc-1-1"' in z.read("OPS/t x/a.xhtml").decode()


def test_untouched_entries_are_copied_as_they_are_stored():
    changed = epub.rebuilt(book(), {"OPS/b.xhtml": b"new text", "extra/\u00e9.txt": b"added"})
    with zipfile.ZipFile(io.BytesIO(book())) as a, zipfile.ZipFile(io.BytesIO(changed)) as b:
        assert b.testzip() is None and b.namelist() == [*a.namelist(), "extra/é.txt"] and b.read("OPS/b.xhtml") == b"new text" and b.read("extra/é.txt") == b"added"
        for name in ("mimetype", "OPS/p.opf"):
            x, y = a.getinfo(name), b.getinfo(name)
            assert (x.compress_type, x.CRC, x.compress_size, x.date_time) == (y.compress_type, y.CRC, y.compress_size, y.date_time)


@pytest.mark.parametrize("name", sorted(examples.QUERIES))
def test_examples(spark, name):
    want = duckdb.connect().execute(examples.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    show = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert show(map(tuple, examples.QUERIES[name](spark, "").select(*columns).collect())) == show(want.fetchall())


def test_a_model_corrects_outlines(spark):
    rows = [(0, f"Heading number {'abcdefgh'[i]} of the text", 16, "bold") for i in range(1)]
    for page in range(1, 7):
        rows.append((page, f"Heading number {'abcdefgh'[page]} of the text", 16, "bold"))
        rows += [(page, f"body text on page {page} line {k} which is a rather long line, like those in a book are.") for k in range(5)]
    doc = lines(spark, rows)
    found = outline.run(doc, doc.select("doc_id", "page_index", F.lit(612.0).alias("width"), "height", F.col("height").alias("view_top")).distinct())
    before = found.headings.count()
    seen = []
    after, sources = outline.refined(found, lambda p: seen.append(p) or '{"retirer": [1], "ajouter": [], "niveaux": []}')
    assert after.count() == before - 1 and sources.first().used
    unchanged, sources = outline.refined(found, lambda p: '{"retirer": [], "ajouter": [], "niveaux": []}')
    assert unchanged.count() == before and not sources.first().used
    assert outline.refined(found, None)[0].count() == before


def test_pdf_frames(spark):
    files = spark.createDataFrame([(1, bytearray(simple_pdf())), (2, bytearray(b"junk"))], "doc_id long, content binary")
    assert {(r.doc_id, r.readable, r.pages) for r in pdf.inspect(files).collect()} == {(1, True, 2), (2, False, 0)}
    assert [r.text for r in pdf.fragments(files).orderBy("frag_idx").collect()] == ["Hello (PDF)", "Wor", "ld"]
    heads = spark.createDataFrame([(1, "A", 1, 0, 700), (1, "B", 2, 1, 600)], "doc_id long, title string, level int, page_index int, y int")
    out = {r.doc_id: r for r in pdf_sink.write_outlines(files, heads).collect()}
    assert out[1].status == "ok" and pdf_sink.existing_outline(bytes(out[1].content)) == [(1, "A", 1), (2, "B", 2)] and out[2].status != "ok"


@pytest.mark.parametrize("name", ["repeated_lines", "style_census", "heading_scores", "line_predicates", "numbering_kinds", "split_page", "split_trailing", "outline_tree", "prune_levels", "text_keys", "html_text", "toc_pages", "index_signs", "page_offsets", "agreement"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "lineitem", "pages", "events", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    show = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in rows)
    key = lambda rows: sorted(map(str, show(rows)))
    assert key(map(tuple, entry.queries()[name](spark, folder).select(*columns).collect())) == key(want.fetchall())


def test_pages_that_fail_are_counted_and_files_replaced(spark, tmp_path):
    from folioscope.sinks import files as sink

    good = simple_pdf()
    assert [type(x).__name__ for _, x in pdf.read_pages(good, lambda p, page, i: 1 / 0, stalls=1)] == ["ZeroDivisionError"]
    with pytest.raises(TimeoutError):
        document = pdf.Pdf.open(good)
        pdf.page_fragments(document, document.pages()[0][1], seconds=-1)
    frame = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk"))], "doc_id long, content binary")
    assert {(r.doc_id, r.status, r.read) for r in pdf.report(frame).collect()} == {(1, "ok", 2), (2, "unreadable", 0)}
    path = tmp_path / "a b.pdf"
    path.write_bytes(b"first")
    files = spark.createDataFrame([(1, str(path)), (2, str(tmp_path / "gone.pdf")), (3, "x")], "doc_id long, path string")
    for content in (b"second", b"third"):
        rows = spark.createDataFrame([(1, "ok", None, bytearray(content)), (2, "ok", None, bytearray(content)), (3, "skipped", "why", None)], "doc_id long, status string, message string, content binary")
        assert {(r.doc_id, r.status) for r in sink.replace(files, rows).collect()} == {(1, "replaced"), (2, "error"), (3, "skipped")}
    assert path.read_bytes() == b"third" and (tmp_path / "a b.pdf.original").read_bytes() == b"first" and not list(tmp_path.glob("*.part"))


def test_truth_from_json(spark, tmp_path):
    from folioscope.operators import evaluate

    (tmp_path / "t.json").write_text('[{"file": "a", "pages": 70, "toc": [[1, "One", 3], [2, "Two", 0]]}, {"file": "b", "pages": 3, "toc": []}]')
    assert [(r.file, r.page_count, r.seq, r.level, r.title, r.page) for r in evaluate.read_truth(spark, str(tmp_path / "t.json")).orderBy("seq").collect()] == [("a", 70, 1, 1, "One", 3), ("a", 70, 2, 2, "Two", 0)]
