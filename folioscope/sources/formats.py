"""PDF and ZIP files as Spark data sources: ``spark.read.format("pdf_fragments").load(folder)``.

A scan is split by files, a few of about ``SPLIT_BYTES`` together to each task, and nothing is read before its task runs. The schema says
what is read: without ``text`` or a place no page is interpreted, without ``content`` no entry is unpacked; a condition on
``page_index`` ends the reading of a file at its last page. Each file that can't be read is a row with its ``message``.

Options: ``path`` (a file or a folder, searched below), ``pattern`` (of names, as in a shell) and ``pages`` (most pages of a file). Paths are those
that Python's file systems open; for stores that Spark alone reads, take ``binaryFile`` rows and the functions of ``sources.pdf`` and ``sources.archive``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import pdf as P

SPLIT_BYTES = 32 << 20
ROWS = 4096
FRAGMENTS = "path string, page_index int, frag_idx int, text string, x double, y double, size double, width double, font string, message string"
ENTRIES = "path string, ord int, name string, method int, crc long, comp_size long, uncomp_size long, content binary, message string"


def opened(path: str):
    """File system and path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class FilesReader(DataSourceReader):
    """Splits by files; subclasses give the rows of one."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.wanted = set(schema.fieldNames())
        self.last: int | None = None

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, at = opened(self.options["path"])
        found = store.get_file_info(at)
        infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and fnmatch(i.base_name, self.options.get("pattern", self.pattern)))
        out, held = [], SPLIT_BYTES
        for path, size in files:
            if held + size > SPLIT_BYTES:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.options["path"])
        arrow, held = to_arrow_schema(self.schema), []
        for path in partition.paths:
            try:
                with store.open_input_file(path) as f:
                    rows = self.rows(f)
                    for row in rows:
                        held.append({"path": path, **row})
                        if len(held) == ROWS:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held = []
            except Exception as e:  # a broken file is a row
                held.append({"path": path, "message": str(e)[:200] or type(e).__name__})
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)


class FragmentsReader(FilesReader):
    pattern = "*.pdf"

    def pushFilters(self, filters):
        """The last page that is asked for bounds the reading; Spark still applies every condition."""
        for f in filters:
            if getattr(f, "attribute", None) == ("page_index",):
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    last = f.value - isinstance(f, LessThan)
                elif isinstance(f, In):
                    last = max(f.value)
                else:
                    last = None
                if last is not None:
                    self.last = last if self.last is None else min(self.last, last)
            yield f

    def rows(self, file) -> Iterator[dict]:
        most = int(self.options.get("pages", P.MAX_PAGES))
        most = most if self.last is None else min(most, self.last + 1)
        data = file.read()
        if not self.wanted & {"frag_idx", "text", "x", "y", "size", "width", "font"}:
            for i in range(min(most, len(P.Pdf.open(data).pages()))) if "page_index" in self.wanted else ():
                yield {"page_index": i}
            if "page_index" not in self.wanted:
                P.Pdf.open(data)
                yield {}
            return
        for i, found in P.read_pages(data, lambda pdf, page, i: P.page_fragments(pdf, page), most):
            if isinstance(found, Exception):
                yield {"page_index": i, "message": str(found)[:200] or type(found).__name__}
                continue
            upright = [f for f in found if f[0].strip() and abs(f[6]) <= 0.01 and abs(f[7]) <= 0.01]
            for k, (text, x, y, size, width, font, _, _) in enumerate(upright):
                yield {"page_index": i, "frag_idx": k, "text": text, "x": float(x), "y": float(y), "size": float(size), "width": float(width), "font": font}


class EntriesReader(FilesReader):
    pattern = "*"

    def rows(self, file) -> Iterator[dict]:
        with zipfile.ZipFile(io.BytesIO(file.read())) as z:
            for i, e in enumerate(z.infolist()):
                row = {"ord": i, "name": e.filename, "method": e.compress_type, "crc": e.CRC, "comp_size": e.compress_size, "uncomp_size": e.file_size}
                if "content" in self.wanted:
                    try:
                        row["content"] = z.read(e)
                    except Exception as x:  # a damaged entry is a row, too
                        row["message"] = str(x)[:200]
                yield row


class PdfFragments(DataSource):
    """Upright text fragments of PDF files."""

    @classmethod
    def name(cls) -> str:
        return "pdf_fragments"

    def schema(self) -> str:
        return FRAGMENTS

    def reader(self, schema: StructType) -> FragmentsReader:
        return FragmentsReader(schema, dict(self.options))


class ZipEntries(DataSource):
    """Entries of ZIP archives, unpacked where ``content`` is asked for."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: StructType) -> EntriesReader:
        return EntriesReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    from ..sinks.replaced import ReplacedFiles

    for source in (PdfFragments, ZipEntries, ReplacedFiles):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
