"""Outlines of files as they arrive. Every operator works on one document, so no watermark or state is needed: each micro-batch
is a batch job over the files that came."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lineage import scratch
from ..operators.layout import group_lines
from ..plans.batch import Preferences, process_files
from ..plans.outline import as_tree, refined, run
from ..sources import pdf
from ..sources.archive import PDF
from ..sources.lines import with_heights


def file_stream(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id, path, content of the files that appear below ``path``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.lit(PDF).alias("mime"), "content")


def outlines_of(files: DataFrame, provider: Callable[[str], str] | None = None, mode: str = "auto") -> DataFrame:
    """Headings as trees of a batch of PDF files, corrected by a model if one is given."""
    pages = pdf.pages(files)
    lines = with_heights(group_lines(pdf.fragments(files), pages), pages)
    found = run(lines, pages)
    return as_tree(found.headings if provider is None else refined(found, provider, mode)[0])


def write_outlines(stream: DataFrame, out: str, checkpoint: str, once: bool = True, provider: Callable[[str], str] | None = None, notes: str | None = None) -> StreamingQuery:
    """Writes each micro-batch's headings as Parquet, one folder per batch, so that a batch that runs again replaces its own. With ``notes``, what was
    observed while a batch was written goes there: batch, headings, deepest, first_pages; nothing is counted again for it."""

    def batch(files: DataFrame, number: int) -> None:
        seen = Observation(f"outlines-{number}")
        with scratch(files.sparkSession):
            found = outlines_of(files, provider).observe(seen, F.count(F.lit(1)).alias("headings"), F.max("depth").alias("deepest"), F.count_if(F.col("page_index") == 0).alias("first_pages"))
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if notes:
            row = seen.get
            files.sparkSession.createDataFrame([(row["headings"], row["deepest"], row["first_pages"])], "headings long, deepest int, first_pages long").coalesce(1).write.mode("overwrite").parquet(f"{notes}/batch={number}")

    return _started(stream, batch, checkpoint, once)


def replace_files(stream: DataFrame, outcomes: str, checkpoint: str, preferences: Preferences | None = None, once: bool = True, provider: Callable[[str], str] | None = None) -> StreamingQuery:
    """Writes an outline into each file that comes, and each micro-batch's outcomes as Parquet. A batch that runs again finds the outlines that it wrote and
    skips those files."""

    def batch(files: DataFrame, number: int) -> None:
        with scratch(files.sparkSession):
            process_files(files, preferences, provider).write.mode("overwrite").parquet(f"{outcomes}/batch={number}")

    return _started(stream, batch, checkpoint, once)


def _started(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
