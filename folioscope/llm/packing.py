"""Packing by concatenate and cut: token totals of partitions become global offsets, fixed windows cut the stream.

Pass 1 writes each document's ids with its place in its partition. Prefix sums over the partitions' totals then give every
document its global offset, and pass 2 cuts it at the window borders without any shuffle of ids. Only the last window is
padded. The boundary record of a piece says where it lies in its document and in its window.

Defined results: null and empty texts are the end id alone; null ids and repeated rows are kept as they are; the order of
documents is that of the input's partitions; an empty table has no piece; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cache_of, written
from .encoding import batches, shared_encoder
from .wavelet import tokenizer_file

WINDOW = 2048
END_ID = 1


def tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """part, doc_id, place (ids before it in its part), n, ids (unsigned little-endian, 16 bits where the vocabulary allows)."""

    def encode_all(stream):
        encode = shared_encoder(tokenizer, end_id, False)
        part, place = TaskContext.get().partitionId(), 0
        for batch in stream:
            for texts, rest in batches(batch, 1 << 20):
                flat, n = encode(texts)
                ends = np.cumsum(n)
                yield pa.record_batch({
                    "part": pa.array(np.full(len(n), part)), "doc_id": rest.column("doc_id").cast(pa.int64()), "place": pa.array(place + ends - n), "n": pa.array(n),
                    "width": pa.array(np.full(len(n), flat.itemsize, np.int32)), "ids": pa.array([flat[a:b].tobytes() for a, b in zip(ends - n, ends, strict=True)], pa.binary()),
                })
                place += len(flat)

    return docs.select("doc_id", "text").mapInArrow(encode_all, "part long, doc_id long, place long, n long, width int, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    encoded = written(tokens(docs, tokenizer, end_id), "pack-ids")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("_total"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = written(totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("first")), "pack-offsets")

    placed = encoded.join(offsets, "part").select("doc_id", (F.col("first") + F.col("place")).alias("at"), "n", "width", "ids")
    return placed.mapInArrow(lambda stream: cut(stream, window), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def cut(stream, window: int = WINDOW):
    """Pieces of the documents of a stream; the encoder that the worker still holds goes first."""
    cache_of("packing")
    for batch in stream:
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "width")), batch.column("ids"), strict=True)
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
        held = 0
        for doc_id, at, n, width, blob in rows:
            ids = np.frombuffer(blob.as_buffer(), f"<u{width}").astype("<u4")
            start = 0
            while start < n:
                sequence, offset = divmod(at + start, window)
                length = min(n - start, window - offset)
                for key, value in zip(out, (doc_id, start, length, n, sequence, offset, ids[start : start + length].tobytes()), strict=True):
                    out[key].append(value)
                start += length
            held += n
            if held > 1 << 21:
                yield _record(out)
                held, out = 0, {c: [] for c in out}
        yield _record(out)


def _record(out: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: packs all ``documents``."""
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("word_bpe_49k.json")))
