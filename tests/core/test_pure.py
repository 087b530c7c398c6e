import itertools
import random

from folioscope.functions import markup, rows
from folioscope.operators.contents import attach_folios, indent_levels, join_broken, pasted_levels, printed_levels, stitch
from folioscope.operators.layout import base_lines, gutters
from folioscope.operators.locate import monotone_chain
from folioscope.sinks import epub, pdf as sink
from folioscope.sources import pdf


def brute_chain(entries):
    best = 0.0
    for picks in itertools.product(*[[None, *range(len(e))] for e in entries]):
        places = [e[p] for e, p in zip(entries, picks, strict=True) if p is not None]
        if all(a[0] <= b[0] for a, b in itertools.pairwise(places)):
            best = max(best, sum(s for _, s in places))
    return best


def test_monotone_chain_is_best_on_short_lists():
    rng = random.Random(1)
    for _ in range(300):
        entries = [[(rng.randrange(5), rng.randrange(1, 12) / 2) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 6))]
        picks = monotone_chain(entries)
        places = [e[p] for e, p in zip(entries, picks, strict=True) if p is not None]
        assert all(a[0] <= b[0] for a, b in itertools.pairwise(places))
        assert sum(s for _, s in places) == brute_chain(entries)


def test_split_rows():
    assert rows.split_trailing("Introduction ..... 12") == ("Introduction", 12, False)
    assert rows.split_trailing("Partie II") is None and rows.split_trailing("The year 1999") is None
    assert rows.split_trailing("Notes xii") == ("Notes", 12, True) and rows.split_trailing("Notes XII") is None
    assert rows.split_page("Preface | ix") == ("Preface", 9, True) and rows.split_page("Year ... 1999") == ("Year", 1999, False)


def test_pasted_folds():
    r = lambda t, indent=0, md=None: {"text": t, "indent": indent, "md": md}
    assert [x["text"] for x in attach_folios([r("One"), r("7"), r("Two  8"), r("9")])] == ["One  7", "Two  8", "9"]
    joined = join_broken([r("A long title that"), r("goes on .... 5"), r("Next .... 9"), r("Last .... 12")])
    assert [x["text"] for x in joined] == ["A long title that goes on .... 5", "Next .... 9", "Last .... 12"]
    assert [x["text"] for x in join_broken([r("First:"), r("second"), r("third")])] == ["First: second", "third"]
    assert indent_levels([0, 4, 8, 1, 4]) == {0: 1, 1: 1, 4: 2, 8: 3}
    entries = [{"title": t, "indent": 0.0, "md": None} for t in ("Preface", "Part One", "Chapter A", "2.1 Section")]
    pasted_levels(entries)
    assert [e["level"] for e in entries] == [1, 1, 2, 3]


def test_printed_folds():
    r = lambda t, x=0.0: {"text": t, "x": x, "size": 10.0}
    out = stitch([r("Opening part"), r("1 Start .... 3", 20.0), r("A title that is", 20.0), r("broken .... 9", 20.0), r("The end", 200.0)])
    assert [(e["title"], e["printed"]) for e in out] == [("Opening part", None), ("1 Start", 3), ("A title that is broken", 9), ("The end", None)]
    printed_levels(out)
    assert [e["level"] for e in out] == [1, 2, 2, 3]


def test_bands_and_layout():
    place, heights = base_lines([100.0, 98.0, 80.0], [10.0] * 3)
    assert place == [0, 0, 1] and heights == [(100.0 * 2 + 98) / 3, 80.0]
    import numpy as np

    x = np.array([50.0, 320.0] * 30)
    assert gutters(x, np.full(60, 200.0), 612) == [(252.0, 320.0)]
    assert gutters(x[:30], np.full(30, 200.0), 612) == []


def test_markup_helpers():
    assert markup.decode("a&amp;b &#233;&#xE9; &eacute; &unknown;") == "a&b éé é &unknown;"
    assert markup.first_json('so {not json} {"a": "}{"} end') == '{"a": "}{"}' and markup.first_json("none") is None
    assert markup.resolve("OEBPS/text/a.xhtml", "../b%20c.xhtml#x") == "OEBPS/b c.xhtml" and markup.relative("OEBPS/nav.xhtml", "OEBPS/text/a.xhtml") == "text/a.xhtml"


def simple_pdf(stream_xref=False):
    bodies = {
        1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 612 792]>>",
        3: b"<</Type /Page /Parent 2 0 R /Contents 5 0 R /Resources <</Font <</F1 6 0 R>>>>>>", 4: b"<</Type /Page /Parent 2 0 R>>",
        5: b"<</Length 62>>\nstream\nBT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -20 Td [(Wor) -10 (ld)] TJ ET\nendstream", 6: b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>",
    }
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for n, b in bodies.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    start = len(out)
    if stream_xref:
        rows = b"\x00" + bytes(6) + b"".join(b"\x01" + at.get(n, start).to_bytes(4, "big") + bytes(2) for n in range(1, 8))
        out += b"7 0 obj\n<</Type /XRef /Size 8 /W [1 4 2] /Root 1 0 R /Length %d>>\nstream\n%s\nendstream\nendobj\n" % (len(rows), rows)
    else:
        out += b"xref\n0 7\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % at[n] for n in range(1, 7)) + b"trailer\n<</Size 7 /Root 1 0 R>>\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


HEADINGS = [
    {"seq": 1, "parent_seq": None, "title": "Été", "page_index": 0, "y": 700}, {"seq": 2, "parent_seq": 1, "title": "Sub 😀", "page_index": 1, "y": 5},
    {"seq": 3, "parent_seq": None, "title": "End", "page_index": 99, "y": None},
]


def test_pdf_round_trip():
    for data in (simple_pdf(), simple_pdf(True), simple_pdf().replace(b"startxref", b"startxxxx")):
        found = pdf.Pdf.open(data)
        assert len(found.pages()) == 2 and not found.has_outline and not found.encrypted
        texts = pdf.page_fragments(found, found.pages()[0][1])
        assert [t[0] for t in texts] == ["Hello (PDF)", "Wor", "ld"] and texts[0][1:4] == (72.0, 700.0, 12.0)
        out = sink.write_outline(data, HEADINGS)
        assert out.startswith(data.rstrip(b"\n"))
        assert sink.existing_outline(out) == [(1, "Été", 1), (2, "Sub 😀", 2), (1, "End", 2)]
        assert pdf.Pdf.open(out).has_outline and len(pdf.Pdf.open(out).pages()) == 2


def test_epub_lists():
    items = [{"depth": d, "href": f"#{i}", "text": f"t{i}", "seq": i} for i, d in enumerate([1, 2, 2, 3, 1])]
    nav = epub.nav_list(items)
    assert nav.count("<ol>") == nav.count("</ol>") == 3 and nav.count("<li>") == nav.count("</li>") == 5
    assert epub.nav_points(items).count("<navPoint") == epub.nav_points(items).count("</navPoint>") == 5
    assert epub.add_anchors('<h1>A</h1><h2 id="b">B</h2><h2>C</h2>', {0: "x", 1: "y", 2: "z"}) == '<h1 id="x">A</h1><h2 id="b">B</h2><h2 id="z">C</h2>'
