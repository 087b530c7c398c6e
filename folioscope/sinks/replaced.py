"""Files replaced by one job at once: ``df.write.format("replaced_files").mode("append").save()`` with columns path and content.

Tasks write each content beside its file, under a name of the job and the attempt. Nothing is replaced before all tasks are
done: then the driver keeps a copy of every original, which a later job never overwrites, and renames the new contents into place. A
job that fails removes what its tasks have written, and so does the commit with what lost attempts left.
Rows with a null path or content are passed over; a path must stand in one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.formats import opened

KEPT = ".original"


@dataclass
class Written(WriterCommitMessage):
    """Paths and the finished files that are to take their place."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, kept: str = KEPT):
        self.job, self.kept = uuid.uuid4().hex, kept

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        attempt, done = uuid.uuid4().hex, []
        try:
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    if path is None or not content.is_valid:
                        continue
                    store, at = opened(path)
                    part = f"{at}.{self.job}-{attempt}.part"
                    done.append((path, part))
                    with store.open_output_stream(part) as out:
                        out.write(content.as_buffer())
        except BaseException:
            self._remove(done)
            raise
        return Written(done)

    @staticmethod
    def _remove(files: list[tuple[str, str]]) -> None:
        from pyarrow import fs

        for path, part in files:
            store, _ = opened(path)
            if store.get_file_info(part).type == fs.FileType.File:
                store.delete_file(part)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files = [f for m in messages if m for f in m.files]
        if len({p for p, _ in files}) < len(files):
            self._remove(files)
            raise ValueError("a path stands in several rows")
        folders = set()
        for path, part in files:
            store, at = opened(path)
            if store.get_file_info(at).type == fs.FileType.File and store.get_file_info(at + self.kept).type == fs.FileType.NotFound:
                copy = f"{at}{self.kept}.{self.job}-0.part"
                store.copy_file(at, copy)
                store.move(copy, at + self.kept)
            store.move(part, at)
            folders.add((path.rpartition("/")[0], at.rpartition("/")[0]))
        for named, folder in folders:  # what attempts left that were lost
            store, _ = opened(named)
            for info in store.get_file_info(fs.FileSelector(folder)):
                if self.job in info.base_name:
                    store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([f for m in messages if m for f in m.files])


class ReplacedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replaced_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options.get("kept", KEPT))
