"""Small examples whose results were worked out by hand: the SQL of each is the list of its expected rows.

They cover compositions and folds for which the tables hold nothing suitable or SQL has no words.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import markup, text as T
from folioscope.operators import arbitrate, census, contents, detect, evaluate, layout, locate, model
from folioscope.operators import predicates as P
from folioscope.sinks import epub
from folioscope.sources import archive
from folioscope.plans import outline

# ---- a small printed book
BOOK = -7
TITLES = ["Origins of rivers", "Mountain weather", "Coastal erosion", "Desert winds", "Final remarks on land"]
PRINTED_BOOK = [(0, 9, "Contents", 10.0, "body"), *[(0, 10 + i, f"{t} ..... {3 + 2 * i}", 10.0, "body") for i, t in enumerate(TITLES)], (0, 16, "padding line without any page", 10.0, "body")]
PRINTED_BOOK += [(3 + 2 * i, 0, t, 16.0, "bold") for i, t in enumerate(TITLES)]
PRINTED_BOOK += [(p, 1 + k, f"body text on page {p} line {k} which is a rather long line, like those in a book are.", 10.0, "body") for p in range(1, 14) for k in range(5)]
PRINTED_BOOK += [(14, k, t, 10.0, "body") for k, t in enumerate(["Index", "delta, 12, 14", "erosion, 5-9", "winds, see weather", "weather, 7", "a plain row of the index"])]
def printed_book(spark) -> DataFrame:
    rows = spark.createDataFrame([(BOOK, *r) for r in PRINTED_BOOK], "doc_id long, page_index int, line_idx int, text string, size double, font string")
    return rows.select(
        "doc_id", "page_index", "line_idx", "text", F.lit(72.0).alias("x"), (F.lit(72.0) + F.length("text") * 5).alias("x_end"), (780 - 7 * F.col("line_idx")).cast("double").alias("y"), F.lit(0).alias("col"),
        "size", F.col("size").alias("max_size"), "font", F.lit(1).alias("n_frags"), F.lit(792.0).alias("height"),
    )


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def sql_value(v) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::double" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def example(columns: str, *rows):
    """columns: ``name type`` pairs as in DDL; rows: the expected ones."""
    names, types = zip(*(c.split() for c in columns.split(", ")), strict=True)
    sql_types = {"string": "varchar", "long": "bigint"}
    picked = ", ".join(f"{n}::{sql_types.get(t, t)} as {n}" for n, t in zip(names, types, strict=True))

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"select {picked} from (values {', '.join('(' + ', '.join(map(sql_value, r)) + ')' for r in rows)}) v({', '.join(names)})"
        return f

    return add


def book(spark) -> tuple[DataFrame, DataFrame]:
    rows = printed_book(spark).filter("page_index < 14")
    return rows, rows.select("doc_id", "page_index", F.lit(612.0).alias("width"), "height", F.col("height").alias("view_top")).distinct()


# ---- contents
@example("entry_idx int, title string, level int, printed int, roman boolean, toc_page int", *[(i, t, 1, 3 + 2 * i, False, 0) for i, t in enumerate(TITLES)])
def example_printed_contents(spark, sf_dir):
    rows, _ = book(spark)
    return contents.printed_contents(rows, census.running_heads(rows), census.toc_pages(rows))[0].filter("printed is not null").select("entry_idx", "title", "level", "printed", "roman", "toc_page")


@example("entry_idx int, title string, page_index int, y int, approx boolean", *[(i, t, 3 + 2 * i, 796, False) for i, t in enumerate(TITLES)])
def example_located(spark, sf_dir):
    rows, pages = book(spark)
    entries, toc = contents.printed_contents(rows, census.running_heads(rows), census.toc_pages(rows))
    found, _ = locate.locate(entries, rows, pages, census.running_heads(rows), census.style_census(rows), toc, leftovers=True)
    return found.select("entry_idx", "title", "page_index", "y", "approx")


@example("doc_id long, seq int, title string, level int, page_index int, depth int, source string", *[(BOOK, i + 1, t, 1, 3 + 2 * i, 1, "contents") for i, t in enumerate(TITLES)])
def example_outline(spark, sf_dir):
    found = outline.run(*book(spark))
    return outline.as_tree(found.headings).select("doc_id", "seq", "title", "level", "page_index", "depth", "source")


PASTED = "Sommaire\nPart I\n    - Chapter of things .... 4\n    * Second chapter .... xii\n\n1.2 Dotted  9"


@example("entry_idx int, title string, level int, printed int, roman boolean", (0, "Part I", 1, None, False), (1, "Chapter of things", 2, 4, False), (2, "Second chapter", 2, 12, True), (3, "1.2 Dotted", 2, 9, False))
def example_pasted(spark, sf_dir):
    return contents.parse_pasted(spark.createDataFrame([(1, PASTED)], "doc_id long, text string")).select("entry_idx", "title", "level", "printed", "roman")


@example("doc_id long, text string", (1, "Alpha one  3\n    Beta two  v\n    Gamma three"))
def example_rendered(spark, sf_dir):
    rows = spark.createDataFrame([(1, 0, "Alpha one", 1, 3, False), (1, 1, "Beta two", 2, 5, True), (1, 2, "Gamma three", 2, None, False)], "doc_id long, entry_idx int, title string, level int, printed int, roman boolean")
    return contents.render(rows)


@example("doc_id long, status string, placed long", (1, "ok", 3), (2, "too few", 1), (3, "no entries", 0))
def example_resolved(spark, sf_dir):
    """A supplied contents text resolved by text, by a recorded model reply, then by page numbers."""
    rows, pages = book(spark)
    one = lambda k: (rows.withColumn("doc_id", F.lit(k).cast("long")), pages.withColumn("doc_id", F.lit(k).cast("long")))
    lines, sheets = (a.unionByName(b).unionByName(c) for a, b, c in zip(one(1), one(2), one(3), strict=True))
    texts = spark.createDataFrame([(1, "Origins of rivers  3\nMountain weather  5\nA title that stands nowhere  9"), (2, "Coastal erosion  7"), (3, "....")], "doc_id long, text string")
    return outline.resolve(texts, lines, sheets)[1].select("doc_id", "status", "placed")


# ---- typography
@example("title string, line_idx int", ("A heading that runs over lines", 1), ("Another one.", 3), ("Next", 4), ("Other", 8))
def example_wrapped_headings(spark, sf_dir):
    rows = [(0, "A heading that runs", 14.0), (1, "over lines", 14.5), (3, "Another one.", 14.0), (4, "Next", 14.0), (8, "Other", 12.0), (11, "Other", 12.0)]
    schema = "doc_id long, page_index int, line_idx int, text string, y double, size double, font string, num struct<depth:int,kind:string,rest:string>, kw boolean, score double"
    frame = spark.createDataFrame([(1, 0 if i < 8 else 1, i, t, 0.0, s, "f", None, False, 5.0) for i, t, s in rows], schema)
    return detect.drop_echoes(detect.merge_wrapped(frame)).select(F.col("text").alias("title"), "line_idx")


@example("size double, level int", (18.0, 1), (17.5, 1), (14.0, 2), (13.9, 2), (12.0, 3), (10.0, 4), (8.0, 5), (6.0, 5))
def example_size_bands(spark, sf_dir):
    rows = spark.createDataFrame([([18.0, 17.5, 14.0, 13.9, 12.0, 10.0, 8.0, 6.0],)], "sizes array<double>")
    return rows.select(F.explode(detect.size_bands(F.col("sizes"))).alias("size", "level"))


@example("line_idx int, text string, col int, n_frags int", (0, "one two", 0, 2), (1, "three", 0, 1))
def example_base_lines(spark, sf_dir):
    schema = "doc_id long, page_index int, frag_idx int, text string, x double, y double, size double, width double, font string"
    rows = [(1, 0, 0, "one", 50.0, 700.0, 10.0, 15.0, "f"), (1, 0, 1, "two", 70.0, 698.0, 10.0, 15.0, "f"), (1, 0, 2, "three", 50.0, 680.0, 10.0, 25.0, "f"), (1, 0, 3, "  ", 90.0, 680.0, 10.0, 5.0, "f")]
    pages = spark.createDataFrame([(1, 0, 612.0, 792.0, 792.0)], "doc_id long, page_index int, width double, height double, view_top double")
    return layout.group_lines(spark.createDataFrame(rows, schema), pages).select("line_idx", "text", "col", "n_frags")


@example("page_index int, first string, last string, lines long", (0, "left 0", "right 29", 60))
def example_two_columns(spark, sf_dir):
    """A page of two columns is read one column after the other."""
    schema = "doc_id long, page_index int, frag_idx int, text string, x double, y double, size double, width double, font string"
    rows = [(1, 0, 2 * k + i, f"{side} {k}", 50.0 + 270 * i, 700.0 - 12 * k, 10.0, 200.0, "f") for k in range(30) for i, side in enumerate(("left", "right"))]
    pages = spark.createDataFrame([(1, 0, 612.0, 792.0, 792.0)], "doc_id long, page_index int, width double, height double, view_top double")
    lines = layout.group_lines(spark.createDataFrame(rows, schema), pages)
    return lines.groupBy("page_index").agg(F.min_by("text", "line_idx").alias("first"), F.max_by("text", "line_idx").alias("last"), F.count(F.lit(1)).alias("lines"))


@example("entry int, chosen int", (0, 0), (1, 1), (2, 0), (3, 0))
def example_monotone_chain(spark, sf_dir):
    """Of two places the better one lies before its predecessor's page, so the other is taken."""
    schema = "doc_id long, entry_idx int, cand_idx int, page_index int, score double"
    rows = [(1, 0, 0, 3, 10.0), (1, 1, 0, 1, 9.0), (1, 1, 1, 5, 8.0), (1, 2, 0, 5, 4.0), (1, 3, 0, 9, 6.0), (1, 3, 1, 2, 6.5)]
    return locate.choose_monotone(spark.createDataFrame(rows, schema)).select(F.col("entry_idx").alias("entry"), F.col("cand_idx").alias("chosen"))


# ---- arbitration
HEADING = "doc_id long, seq int, title string, level int, page_index int, y int, score double, size double, font string, approx boolean"


@example("i int, text string, tags string, kept boolean, kept_level int, toc_level int", (1, "A", "TDC", True, 1, 1), (2, "B", "T", False, None, 1), (3, "C", "DC", True, 1, None))
def example_merged(spark, sf_dir):
    h = lambda rows: spark.createDataFrame([(1, i, t, 1, p, y, 5.0, 10.0, "f", False) for i, (t, p, y) in enumerate(rows)], HEADING)
    a, b = h([("A", 0, 700), ("B", 1, 500)]), h([("A'", 0, 690), ("C", 2, 300)])
    pool = b.select("doc_id", "page_index", "y", "size", F.col("title").alias("text"), "score")
    return arbitrate.merge_sources(a, b, pool, b).select("i", "text", F.array_join("tags", "").alias("tags"), "kept", "kept_level", "toc_level")


@example("title string, level int, page_index int", ("Deeper thoughts", 2, 4))
def example_deepened(spark, sf_dir):
    """Of the typographic headings in the style of contents headings of level 2, the one that is there neither by title nor by place, nor before the first."""
    place = [("Start", 1, 2, "big", 16.0), ("Middle part", 2, 3, "mid", 13.0), ("Later part", 2, 6, "mid", 13.0), ("The end", 1, 9, "big", 16.0)]
    known = spark.createDataFrame([(1, i, t, n, p, 600, 5.0, s, f, False) for i, (t, n, p, f, s) in enumerate(place)], HEADING)
    own = [("Deeper thoughts", 4, 300, "mid", 13.0), ("Middle part", 5, 300, "mid", 13.0), ("Near the end", 9, 610, "mid", 13.0), ("Too early", 1, 300, "mid", 13.0), ("Other style", 5, 100, "x", 11.0), ("Big one", 7, 300, "big", 16.0)]
    found = spark.createDataFrame([(1, i, t, 3, p, y, 5.0, s, f, False) for i, (t, p, y, f, s) in enumerate(own)], HEADING)
    styles = spark.createDataFrame([(1, "body", 10.0)], "doc_id long, body_font string, body_size double")
    return arbitrate.deepen(known, found, styles).select("title", "level", "page_index")


@example(
    "doc_id long, source string, ask boolean, confidence string", (1, "contents", False, "good"), (2, "contents+styles", True, "good"), (3, "typography", True, "medium"), (4, "typography", True, "weak"), (5, "contents", True, "weak"),
)
def example_choice(spark, sf_dir):
    rows = [(1, 100, 20, 18, 0.97, 30, 0, 18, 0.2, 6.0), (2, 100, 20, 10, 0.8, 30, 4, 14, 0.2, 6.0), (3, 100, 20, 12, 0.5, 100, 0, 100, 1.0, 4.0), (4, 10, 6, 2, None, 20, 0, 2, 2.0, 6.0), (5, 100, 20, 12, 0.5, 700, 3, 12, 7.0, 6.0)]
    frame = spark.createDataFrame(rows, "doc_id long, pages int, entries int, placed int, agree double, typographic int, added int, headings int, density double, mean_score double")
    chosen = arbitrate.choose(frame.withColumn("added", F.when(F.col("doc_id") == 5, 0).otherwise(F.col("added"))))
    return chosen.select("doc_id", "source", arbitrate.ask_model("auto").alias("ask"), P.confidence(F.col("headings"), F.col("pages"), F.col("density"), F.col("mean_score")).alias("confidence"))


@example("n long, reason string", (1, None), (2, "type"), (3, "read-only"), (4, "missing"), (5, "encrypted"), (6, "has outline"))
def example_gate(spark, sf_dir):
    pdf = "application/pdf"
    rows = [(1, pdf, True, True, False, False), (2, "text/html", True, False, True, True), (3, pdf, False, False, True, True), (4, "application/epub+zip", False, True, True, True), (5, pdf, True, True, True, True), (6, pdf, True, True, False, True)]
    frame = spark.createDataFrame(rows, "n long, mime string, readable boolean, editable boolean, encrypted boolean, outline boolean")
    return frame.select("n", P.gate(*map(F.col, ("mime", "readable", "editable", "encrypted", "outline"))).alias("reason"))


# ---- models
CANDIDATE = "doc_id long, i int, page_index int, y int, size double, text string, tags array<string>, toc_level int, score double, kept boolean, kept_level int"


def five_candidates(spark) -> DataFrame:
    return spark.createDataFrame([(1, i, i, 100, 10.0, f"t{i}", ["T"], None, 1.0, i < 4, 1 if i < 4 else None) for i in range(1, 6)], CANDIDATE)


def reply(spark, *texts) -> DataFrame:
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, reply string")


@example("i int, title string, level int", (2, "t2", 3), (3, "t3", 1), (5, "t5", 2))
def example_edited(spark, sf_dir):
    text = 'Sure {x}: {"retirer": [1, 5, 99], "ajouter": [{"i": 5, "l": 9}], "niveaux": [{"i": 2, "l": 3}, {"i": 3, "l": 0}]} ok'
    return model.edit_outline(five_candidates(spark), reply(spark, text)).select("i", "title", "level")


@example("i int, title string, level int", (2, "t2", 1), (4, "t4", 2))
def example_selected(spark, sf_dir):
    return model.select_outline(five_candidates(spark), reply(spark, '[{"i": 4, "l": 3}, {"i": 4, "l": 1}, {"i": 77, "l": 1}, {"i": 2, "l": 2}]')).select("i", "title", "level")


@example("e int, i int, cand_idx int", (1, 2, 1), (2, 3, 0))
def example_matched(spark, sf_dir):
    asked = spark.createDataFrame([(1, 4, "x"), (1, 9, "y")], "doc_id long, entry_idx int, title string")
    places = spark.createDataFrame([(1, 4, 0), (1, 4, 1), (1, 9, 0), (1, 9, 1)], "doc_id long, entry_idx int, cand_idx int")
    options = model.match_options(asked, places)
    return model.match_titles(options, reply(spark, '[{"e": 1, "i": 2}, {"e": 1, "i": 1}, {"e": 2, "i": 3}, {"e": 7, "i": 1}]')).select("e", "i", "cand_idx")


@example("doc_id long, accepted boolean", (1, False), (2, True), (3, False), (4, True))
def example_accepted(spark, sf_dir):
    """Unchanged, changed, too short, one level changed."""
    h = lambda rows: spark.createDataFrame([(d, f"h{k}", n, k, 100) for d, k, n in rows], "doc_id long, title string, level int, page_index int, y int")
    base = h([(d, k, 1) for d in (1, 2, 3, 4) for k in range(4)])
    return model.accept(base, h([(1, k, 1) for k in range(4)] + [(2, k, 1) for k in range(3)] + [(3, 0, 1)] + [(4, k, 1 + (k == 2)) for k in range(4)]))


# ---- scores
@example("doc_id long, precision double, recall double, f1 double", (1, 0.5, 0.4, 4 / 9), (2, 0.0, 0.0, 0.0))
def example_prf(spark, sf_dir):
    """Two of four found headings are true: a page off by one and a longer title count, a page off by two and another title don't."""
    found = spark.createDataFrame([(1, 1, "1. First things", 4), (1, 2, "Second thoughts on it", 10), (1, 3, "Third", 20), (1, 4, "Unknown", 2)], "doc_id long, seq int, title string, page_index int")
    truth = [(1, 1, "First things", 6), (1, 2, "Second thoughts", 11), (1, 3, "Third", 24), (1, 4, "Fourth", 30), (1, 5, "Fifth", 31), (1, 6, "Nowhere", 0), (2, 1, "Alone", 3)]
    return evaluate.prf(found, spark.createDataFrame(truth, "doc_id long, seq int, title string, page int"))


@example("doc_id long, n long, exact long, near long, missed long, wrong_level long", (1, 4, 1, 2, 1, 1))
def example_placement_scores(spark, sf_dir):
    entries = spark.createDataFrame([(1, "a", 1, 3), (1, "b", 2, 5), (1, "c", 1, 9), (1, "d", 1, 9)], "doc_id long, title string, level int, page_index int")
    found = spark.createDataFrame([(1, 1, "a", 1, 3), (1, 2, "b", 1, 6), (1, 3, "c", 1, 2), (1, 4, "a", 4, 8)], "doc_id long, seq int, title string, level int, page_index int")
    return evaluate.placement_scores(entries, found)


@example("documents long, without_model double, with_model double", (2, 0.5, 0.75))
def example_uplift(spark, sf_dir):
    f1 = lambda rows: spark.createDataFrame(rows, "doc_id long, f1 double")
    return evaluate.uplift(f1([(1, 0.25), (2, 0.75), (3, 0.1)]), f1([(1, 0.5), (2, 1.0)]))


@example("doc_id long, book boolean", (1, True), (5, False))
def example_good_truth(spark, sf_dir):
    """A book and an article pass; page numbers beyond the end, repeated titles and too few entries don't."""
    rows = [(d, t, p) for d, n in ((1, 6), (5, 5)) for p, t in enumerate([f"title {c}" for c in "abcdef"[:n]], 1)]
    rows += [(2, f"title {c}", 900) for c in "abcdef"] + [(3, "same title", p) for p in range(1, 8)] + [(4, f"title {c}", 1) for c in "abc"]
    documents = spark.createDataFrame([(1, 80), (2, 80), (3, 80), (4, 80), (5, 20)], "doc_id long, page_count int")
    return evaluate.good_truth(spark.createDataFrame(rows, "doc_id long, title string, page int"), documents)


# ---- markup and archives
@example(
    "n long, text string, path string, back string", (1, "Chéri & cœur – «x»", "OPS/t x/a.xhtml", "t x/a.xhtml"), (2, "A€'&unknown;", "OPS/b.xhtml", "b.xhtml"), (3, "&#xD800;  ", "c.xhtml", "../c.xhtml"), (4, None, None, None),
)
def example_markup(spark, sf_dir):
    rows = [(1, "Ch&eacute;ri &amp; c&oelig;ur &ndash; &laquo;x&raquo;", "t%20x/a.xhtml#k"), (2, "&#65;&#x20AC;&apos;&unknown;", "./b.xhtml"), (3, "&#xD800; &nbsp;", "../c.xhtml"), (4, None, None)]
    frame = spark.createDataFrame(rows, "n long, text string, href string").withColumn("path", markup.resolve_path(F.lit("OPS/p.opf"), F.col("href")))
    return frame.select("n", markup.decode_entities("text").alias("text"), "path", markup.relative_path(F.lit("OPS/p.opf"), F.col("path")).alias("back"))


@example("n long, object string, items string", (1, '{"a": "} {"}', None), (2, None, "[1, 2]"), (3, None, None), (4, "{}", None))
def example_json_in_prose(spark, sf_dir):
    frame = spark.createDataFrame([(1, 'So {well}: {"a": "} {"} and {"b": 1}'), (2, "take [1, 2] or [3"), (3, "nothing"), (4, "x{}y")], "n long, t string")
    return frame.select("n", markup.json_object("t").alias("object"), markup.json_array("t").alias("items"))


@example("n long, located string, page string, letters string, truth string, style string", (1, "ete 'un roi", "ete un roi", "ete d un roi", "ete d un roi", "f|10.5"), (2, "page", "page", "page", "page 12", "|0.0"), (3, "the end", "the end", "the end", "the end", "f|11.0"))
def example_keys(spark, sf_dir):
    rows = [(1, "IV. Été d’un roi", "f", 10.3), (2, "Page 12", None, None), (3, "3.2 The End", "f", 10.8)]
    frame, t = spark.createDataFrame(rows, "n long, t string, font string, size double"), F.col("t")
    return frame.select("n", T.located_run_key(t).alias("located"), T.page_run_key(t).alias("page"), T.letters_key(t).alias("letters"), T.truth_key(t).alias("truth"), T.style_key(F.col("font"), F.col("size")).alias("style"))


def small_epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package><manifest><item id="a" href="t%20x/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/t x/a.xhtml", '<html><body><h2 id="k">Ch&eacute;ri &amp; co</h2><p>x</p><h3>Sub</h3></body></html>')
        z.writestr("OPS/b.xhtml", "<html><body><h2>First <i>one</i></h2><h2> </h2></body></html>")
    return out.getvalue()


@example("spine_pos int, level int, text string, path string, anchor string", (0, 1, "First one", "OPS/b.xhtml", None), (1, 1, "Chéri & co", "OPS/t x/a.xhtml", "k"), (1, 2, "Sub", "OPS/t x/a.xhtml", None))
def example_epub_headings(spark, sf_dir):
    files = spark.createDataFrame([(1, bytearray(small_epub())), (2, bytearray(b"PK broken"))], "doc_id long, content binary")
    return archive.epub_headings(archive.zip_entries(files)).select(F.col("spine_pos").cast("int").alias("spine_pos"), "level", "text", "path", "anchor")


@example("doc_id long, status string", (1, "ok"), (2, "skipped"))
def example_epub_written(spark, sf_dir):
    files = spark.createDataFrame([(1, bytearray(small_epub())), (2, bytearray(b"PK broken"))], "doc_id long, content binary")
    return epub.write_all(files, archive.epub_headings(archive.zip_entries(files))).select("doc_id", "status")


# ---- around the plan
@example("doc_id long, text string, pages long, entries long", (BOOK, "\n".join(f"{t}  {3 + 2 * i}" for i, t in enumerate(TITLES)), 14, 5))
def example_prepared(spark, sf_dir):
    """The draft that a user is offered: the printed contents, without the row that has no page."""
    rows = book(spark)[0].filter("text not like 'padding%'")
    return outline.prepared(rows)[0].select("doc_id", "text", F.col("pages").cast("long").alias("pages"), "entries")


@example("doc_id long, text string, headings long", (1, "One\n    Two", 3))
def example_preview(spark, sf_dir):
    rows = spark.createDataFrame([(1, 1, 1, "One"), (1, 3, 1, "Three"), (1, 2, 2, "Two")], "doc_id long, seq int, level int, title string")
    return outline.preview(rows, 2)


@example("doc_id long, step string, note string", (BOOK, "lines", "14 pages, body 10.0 pt, 1 running heads"), (BOOK, "typography", "5 candidates, 5 headings, mean score 8.5"), (BOOK, "contents", "printed pages are off by 1"), (BOOK, "choice", "printed table of contents, agreement 100 %"))
def example_report(spark, sf_dir):
    return outline.report(outline.run(*book(spark)))


@example("source string, documents long, agree double", ("contents", 2, 0.75), ("typography", 1, None))
def example_by_source(spark, sf_dir):
    return evaluate.by_source(spark.createDataFrame([(1, "contents", 0.5), (2, "contents", 1.0), (3, "typography", None)], "doc_id long, source string, agree double"))
