"""Token ids in wavelet-matrix shards: bit planes with rank and select, read back from one compressed file per shard.

A shard holds the ids of consecutive documents. Plane k has bit k of every id; from one plane to the next the ids with bit 0
come before those with bit 1, order kept. Counting, access and occurrence lookup take one rank or select per plane.

Defined results: null and empty texts have the end id alone; documents are ordered by id, null ids first, equal ids by a
hash of their texts; repeated rows each have their place; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, open_shared, parts, replace_shared, text_bytes, written
from .encoding import batches, shared_encoder

MAGIC = b"FWM1"
END_ID = 2
BLOCK = 512  # bits for each entry of the rank directory
SHARD_BYTES = 8 << 20
SHARD_TOKENS = 1 << 22


class WaveletShard:
    """ids of ``doc_ids`` (with ``null`` marks) of ``lengths``; planes are packed bits, highest first."""

    def __init__(self, planes, n, zeros, ranks, doc_ids, null, lengths):
        self.planes, self.n, self.zeros, self.ranks = planes, n, zeros, ranks
        self.doc_ids, self.null, self.lengths = doc_ids, null, lengths

    # ---- writing
    @classmethod
    def build(cls, ids, lengths, doc_ids, null):
        ids = np.asarray(ids)
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, zeros, ranks = [], [], []
        for k in range(bits - 1, -1, -1):
            one = (ids >> k) & 1 != 0
            planes.append(np.packbits(one, bitorder="little"))
            ranks.append(cls._directory(planes[-1]))
            low = ids[~one]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[one]])
        return cls(planes, len(ids), zeros, ranks, np.asarray(doc_ids, np.int64), np.asarray(null, bool), np.asarray(lengths, np.int64))

    @staticmethod
    def _directory(plane):
        """Ones before each block."""
        step = BLOCK // 8
        padded = np.zeros(-(-max(1, len(plane)) // step) * step, np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        sections = [pack(self.doc_ids.astype("<i8").tobytes()), pack(np.packbits(self.null).tobytes()), pack(self.lengths.astype("<u8").tobytes())]
        for plane, rank in zip(self.planes, self.ranks, strict=True):
            sections += [pack(plane.tobytes()), pack(rank.astype("<u4").tobytes())]
        head = json.dumps({"n": self.n, "docs": len(self.doc_ids), "zeros": self.zeros, "sections": [len(s) for s in sections]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])

    # ---- reading
    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", data, 4)
        head = json.loads(data[8 : 8 + size])
        unpack, at, raw = zstandard.ZstdDecompressor().decompress, 8 + size, []
        for length in head["sections"]:
            raw.append(unpack(data[at : at + length]))
            at += length
        doc_ids, lengths = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[2], "<u8").astype(np.int64)
        null = np.unpackbits(np.frombuffer(raw[1], np.uint8), count=head["docs"]).astype(bool)
        return cls([np.frombuffer(x, np.uint8) for x in raw[3::2]], head["n"], head["zeros"], [np.frombuffer(x, "<u4") for x in raw[4::2]], doc_ids, null, lengths)

    def _rank1(self, level, i):
        """Ones among the first ``i`` bits."""
        block, plane = i // BLOCK, self.planes[level]
        first = block * BLOCK
        part = plane[first // 8 : (i + 7) // 8].copy()
        if i % 8:
            part[-1] &= (1 << (i % 8)) - 1
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())

    def _select(self, level, bit, k):
        """Place of the k-th (from 0) such bit."""
        rank = self.ranks[level].astype(np.int64)
        before = rank if bit else np.arange(len(rank)) * BLOCK - rank
        block = int(np.searchsorted(before, k, side="right")) - 1
        row = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(row == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][i // 8] >> (i % 8)) & 1
            ones = self._rank1(level, i)
            i = zeros + ones if bit else i - ones
            value = 2 * value + bit
        return value

    def _range(self, token: int, stop: int):
        """Where the token's occurrences among the first ``stop`` ids stand below the last plane."""
        if token >> len(self.zeros):
            return 0, 0
        low, high = 0, stop
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, low), self._rank1(level, high)
            low, high = (zeros + a, zeros + b) if token >> (len(self.zeros) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences among the first ``i`` ids."""
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids, from the last plane up."""
        values = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(values)
            above[~one] = values[: self.zeros[level]]
            above[one] = values[self.zeros[level] :] | values.dtype.type(1 << (len(self.zeros) - 1 - level))
            values = above
        return values


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards below ``folder``; the manifest: part, seq, path, n_docs, n_tokens, in order of the documents."""
    n = parts(text_bytes(docs), shard_bytes)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    rows = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), "_tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "_tie").drop("_tie")

    def write(stream):
        encode = shared_encoder(tokenizer, end_id, True)
        context = TaskContext.get()
        part, attempt, seq = context.partitionId(), context.taskAttemptId(), 0
        ids, lengths, doc_ids, held = [], [], [], 0

        def flush():
            keys = pa.concat_arrays(doc_ids)
            shard = WaveletShard.build(np.concatenate(ids), np.concatenate(lengths), keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False))
            path = f"{folder}/shard-{part:06d}-{seq:04d}.fwm"
            with open_shared(f"{path}.{attempt}", "wb") as out:
                out.write(shard.to_bytes())
            replace_shared(f"{path}.{attempt}", path)
            return pa.record_batch({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(keys)], "n_tokens": [shard.n]})

        for batch in stream:
            for texts, rest in batches(batch):
                flat, n_ids = encode(texts)
                ids.append(flat)
                lengths.append(n_ids)
                doc_ids.append(rest.column("doc_id").cast(pa.int64()))
                held += len(flat)
                if held >= shard_tokens:
                    yield flush()
                    ids, lengths, doc_ids, held, seq = [], [], [], 0, seq + 1
        if held:
            yield flush()

    return rows.mapInArrow(write, "part long, seq long, path string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, from the shard files."""
    order = Window.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = written(manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))), "wavelet-files")
    n = max(1, placed.count())

    def read(stream):
        for batch in stream:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with open_shared(path, "rb") as file:
                    shard = WaveletShard.from_bytes(file.read())
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                for i in range(0, len(ends), 2000):
                    a, b = starts[i : i + 2000], ends[i : i + 2000]
                    yield pa.record_batch({
                        "doc_id": pa.array(shard.doc_ids[i : i + 2000], mask=shard.null[i : i + 2000]), "start": pa.array(first + a), "n_tokens": pa.array(b - a),
                        "ids": pa.array([ids[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()),
                    })

    return placed.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: writes the ids of all ``documents`` and reads them back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = written(write_shards(docs, tokenizer_file("byte_bpe_50k.json"), fresh_path(spark, "wavelet")), "wavelet-manifest")
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
