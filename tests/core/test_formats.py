"""Files as data sources and sinks, and what page contents may hold."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.sinks.replaced import FilesWriter, Written
from folioscope.sources import formats, pdf
from tests.core.test_pure import simple_pdf


def made_pdf(bodies: dict[int, bytes]) -> bytes:
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for n, b in bodies.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % at[n] for n in sorted(at)) + b"trailer\n<</Size %d /Root 1 0 R>>\n" % (len(at) + 1)
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def stream(data: bytes, more: bytes = b"") -> bytes:
    return b"<<%s /Length %d>>\nstream\n%s\nendstream" % (more, len(data), data)


def form_pdf() -> bytes:
    packed = zlib.compress(b"q 2 0 0 2 0 0 cm BT /F2 10 Tf 5 5 Td (a\\001\\002) Tj ET Q /Again Do")
    return made_pdf({
        1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792]>>",
        3: b"<</Type /Page /Parent 2 0 R /Contents 4 0 R /Resources <</Font <</F1 6 0 R>> /XObject <</Outer 5 0 R /Picture 9 0 R>>>>>>",
        4: stream(b"BT /F1 12 Tf 72 700 Td (Page) Tj ET /Picture Do q 1 0 0 1 100 200 cm /Outer Do Q BT /F1 12 Tf 72 600 Td (after) Tj ET"),
        5: stream(b"BT /F1 8 Tf 1 2 Td (outer) Tj ET /Inner Do", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 10 20] /Resources <</Font <</F1 6 0 R>> /XObject <</Inner 7 0 R>>>>"),
        6: b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>",
        7: stream(packed, b"/Type /XObject /Subtype /Form /Filter /FlateDecode /Resources <</Font <</F2 8 0 R>> /XObject <</Again 5 0 R>>>>"),
        8: b"<</Type /Font /Subtype /Type1 /BaseFont /Own /Encoding <</Type /Encoding /BaseEncoding /MacRomanEncoding /Differences [1 /eacute /uni00420043]>>>>",
        9: stream(b"(no text) Tj", b"/Type /XObject /Subtype /Image"),
    })


def test_forms_bring_their_matrix_and_fonts_and_end():
    found = pdf.Pdf.open(form_pdf())
    texts = pdf.page_fragments(found, found.pages()[0][1])
    assert [t[0] for t in texts] == ["Page", "outer", "aéBC", "after"]
    assert texts[1][1:4] == (111.0, 222.0, 8.0) and texts[2][1:4] == (120.0, 230.0, 20.0) and texts[3][1:3] == (72.0, 600.0) and texts[2][5] == "Own"


@pytest.mark.parametrize(("name", "text"), [("A", "A"), ("eacute", "é"), ("Scaron", "Š"), ("uni20AC", "€"), ("u1F600", "😀"), ("uniD800", ""), ("fi", "ﬁ"), ("a.sc", "a"), ("g123", ""), (".notdef", ""), ("hyphen", "-")])
def test_glyph_names(name, text):
    assert pdf.glyph_text(name) == text


def test_encodings():
    found = pdf.Pdf.open(form_pdf())
    assert pdf.encoded(found, pdf.Name("WinAnsiEncoding"))[0x80] == "€" and pdf.encoded(found, pdf.Name("MacRomanEncoding"))[0x8E] == "é"
    assert pdf.encoded(found, None) == {} and pdf.encoded(found, {"Differences": [65, pdf.Name("B"), 3, pdf.Name("x"), pdf.Name("nothing")]}) == {65: "B", 3: "x"}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(simple_pdf())
    (tmp_path / "in" / "form.pdf").write_bytes(form_pdf())
    (tmp_path / "in" / "broken.pdf").write_bytes(b"junk")
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.txt", "x" * 1000)
        z.writestr("y.txt", "")
    (tmp_path / "in" / "z.zip").write_bytes(box.getvalue())
    return str(tmp_path / "in")


def test_pdf_format(spark, folder):
    formats.register(spark)
    read = spark.read.format("pdf_fragments")
    rows = read.load(folder).collect()
    name = lambda r: r.path.rpartition("/")[2]
    assert sorted((name(r), r.page_index, r.frag_idx, r.text) for r in rows if r.text) == [("a.pdf", 0, 0, "Hello (PDF)"), ("a.pdf", 0, 1, "Wor"), ("a.pdf", 0, 2, "ld"), *[("form.pdf", 0, i, t) for i, t in enumerate(["Page", "outer", "aéBC", "after"])]]
    assert [name(r) for r in rows if r.message] == ["broken.pdf"]
    pages = spark.read.format("pdf_fragments").schema("path string, page_index int").load(folder)
    assert sorted((name(r), r.page_index) for r in pages.collect() if r.page_index is not None) == [("a.pdf", 0), ("a.pdf", 1), ("form.pdf", 0)]
    assert spark.read.format("pdf_fragments").load(folder).filter("page_index = 0 and frag_idx = 1").select("text").orderBy("text").collect() == [("Wor",), ("outer",)]
    assert spark.read.format("pdf_fragments").option("pattern", "no*").load(folder).count() == 0


def test_unread_columns_cost_no_decoding(folder, monkeypatch):
    from pyspark.sql.types import StructType

    monkeypatch.setattr(pdf, "page_fragments", lambda *a: 1 / 0)
    reader = formats.FragmentsReader(StructType.fromDDL("path string, page_index int"), {"path": folder, "pattern": "a.pdf"})
    assert [b.to_pylist() for p in reader.partitions() for b in reader.read(p)][0] == [{"path": f"{folder}/a.pdf", "page_index": i} for i in (0, 1)]
    reader = formats.FragmentsReader(StructType.fromDDL("page_index int, text string, message string"), {"path": folder, "pattern": "a.pdf"})
    list(reader.pushFilters([formats.LessThan(("page_index",), 1)]))
    assert [b.to_pylist() for p in reader.partitions() for b in reader.read(p)][0] == [{"page_index": 0, "text": None, "message": "division by zero"}]


def test_zip_format(spark, folder):
    formats.register(spark)
    rows = spark.read.format("zip_entries").option("pattern", "*.zip").load(folder).orderBy("ord").collect()
    assert [(r.ord, r.name, r.uncomp_size, len(r.content), r.message) for r in rows] == [(0, "x.txt", 1000, 1000, None), (1, "y.txt", 0, 0, None)]
    slim = spark.read.format("zip_entries").schema("name string, crc long").load(folder + "/z.zip").collect()
    assert {r.name: r.crc for r in slim} == {"x.txt": zlib.crc32(b"x" * 1000), "y.txt": 0}


def test_files_are_replaced_by_the_commit(spark, tmp_path):
    formats.register(spark)
    paths = [str(tmp_path / f"{i}.bin") for i in range(5)]
    for p in paths:
        open(p, "wb").write(b"first " + p.encode())
    for content in (b"second", b"third"):
        rows = spark.createDataFrame([(p, bytearray(content)) for p in paths] + [(None, bytearray(b"x")), (paths[0], None)], "path string, content binary").repartition(3)
        rows.write.format("replaced_files").mode("append").save()
        assert all(open(p, "rb").read() == content and open(p + ".original", "rb").read() == b"first " + p.encode() for p in paths)
    assert len(list(tmp_path.iterdir())) == 10
    twice = spark.createDataFrame([(paths[0], bytearray(b"x"))] * 2, "path string, content binary")
    with pytest.raises(Exception, match="several rows"):
        twice.write.format("replaced_files").mode("append").save()
    assert open(paths[0], "rb").read() == b"third" and len(list(tmp_path.iterdir())) == 10


def test_a_task_that_fails_and_runs_again_leaves_one_file_and_one_original(spark, tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "a.bin")
    open(path, "wb").write(b"first")
    batch = pa.record_batch({"path": [path], "content": pa.array([b"second"], pa.binary())})
    writer = FilesWriter()

    def breaks():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    assert [p.name for p in tmp_path.iterdir()] == ["a.bin"]
    lost, again = writer.write(iter([batch])), writer.write(iter([batch]))  # the first attempt's message never arrived
    assert isinstance(lost, Written) and open(path, "rb").read() == b"first"
    writer.commit([None, again])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "a.bin.original"] and open(path, "rb").read() == b"second" and open(path + ".original", "rb").read() == b"first"
    other = FilesWriter()
    other.abort([other.write(iter([batch]))])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "a.bin.original"]


def test_formats_in_sql(spark, folder):
    formats.register(spark)
    spark.read.format("pdf_fragments").load(folder).createOrReplaceTempView("fragments_of_test")
    assert spark.sql("select count(*) as n from fragments_of_test where text is not null").first().n == 7
    assert spark.read.format("pdf_fragments").load(folder).agg(F.count_if(F.col("message").isNotNull())).first()[0] == 1
