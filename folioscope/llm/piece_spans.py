"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here: at each place the longest key of the model's compiled character map is replaced, other characters
stay, blanks are treated as the model says, and every byte of the result remembers the source byte that it came from. The
library then splits the normalised text into pieces, with a copy of the model that doesn't normalise again, and each piece's
bytes are projected through that alignment to a span of bytes of the original text. What a rule or the treatment of blanks
drops belongs to the piece before it. A character that the vocabulary lacks becomes one piece per byte; the last of these has the
character's span, the others are empty, at its start.

Pieces never go on across a blank that follows another character, so a text is split before such blanks and each distinct part
goes to the library once per worker.

Defined results: a null text counts as empty and has the begin and end ids alone; null ids and repeated rows are encoded like
others; an empty table gives an empty one; very long texts are encoded whole; other columns are never read. Models with
user-defined pieces, blanks as suffixes or without byte fallback are refused.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache_of
from .encoding import PieceEncoder, batches
from .wavelet import tokenizer_file

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
#: Distinct parts that a worker remembers; beyond that it forgets the rare ones.
CACHE_PARTS = 200_000
_PARTS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
NORMAL, CONTROL, USER_DEFINED, BYTE = 1, 3, 4, 6


class CharacterMap:
    """Longest-prefix replacement by a compiled map: the size of a double-array trie, its cells, and replacements that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.cells = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""
        if b"  " in self.texts:
            raise ValueError("character maps that write two blanks in a row are not supported")
        # which first bytes, and which first two, a key may have: only there the trie is walked
        self.whole = np.zeros(256, bool)
        self.pairs = np.zeros((256, 256), bool)
        for first in range(256 if self.cells else 0):
            node = self._step(self._offset(0, self.cells[0]), first)
            if node is None:
                continue
            self.whole[first] = self.cells[node] >> 8 & 1
            for second in range(256):
                self.pairs[first, second] = self._step(self._offset(node, self.cells[node]), second) is not None

    @staticmethod
    def _offset(node: int, cell: int) -> int:
        return node ^ (cell >> 10) << ((cell & 1 << 9) >> 6)

    def _step(self, base: int, label: int) -> int | None:
        """Cell of the child with that label."""
        node = base ^ label
        return node if node < len(self.cells) and self.cells[node] & 0x800000FF == label else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that stands at ``at``, and its replacement."""
        base, found = self._offset(0, self.cells[0]), None
        for i in range(at, len(data)):
            node = self._step(base, data[i])
            if node is None:
                break
            base = self._offset(node, self.cells[node])
            if self.cells[node] >> 8 & 1:
                found = i + 1 - at, self.cells[base] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def blanks(self, data: bytes) -> int:
        """Bytes at the start that are blanks, or are replaced by one each."""
        at = 0
        while at < len(data):
            hit = self.longest(data, at) if self.cells else None
            if (hit[1] if hit else data[at : at + 1]) != b" ":
                break
            at += hit[0] if hit else 1
        return at

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after replacement and the source byte of each."""
        raw = np.frombuffer(data, np.uint8)
        if not self.cells or not len(raw):
            return raw, np.arange(len(raw), dtype=np.int32)
        after = np.append(raw[1:], np.uint8(0))
        out, origin, done = [], [], 0
        for at in np.flatnonzero(self.whole[raw] | self.pairs[raw, after]).tolist():
            hit = self.longest(data, at) if at >= done else None
            if hit:
                length, text = hit
                out += [raw[done:at], np.frombuffer(text, np.uint8)]
                origin += [np.arange(done, at, dtype=np.int32), np.full(len(text), at, np.int32)]
                done = at + length
        out.append(raw[done:])
        origin.append(np.arange(done, len(raw), dtype=np.int32))
        return np.concatenate(out), np.concatenate(origin)


class PartEncoder(PieceEncoder):
    """Ids of normalised texts, with begin and end ids. Keys of parts: a word stands for itself behind a blank, other parts carry a
    zero character first; that character alone stands for the begin id."""

    def __init__(self, core, ids: tuple[int, int], cuts: bool, breaks: bool, cache_parts: int):
        self.core, self.begin_id, self.end_id, self.cuts, self.breaks, self.cache_pieces, self.dtype = core, *ids, cuts, breaks, cache_parts, np.uint16 if core.get_piece_size() <= 1 << 16 else np.int32
        self._clear()

    def _pieces(self, text: str) -> list[str]:
        out = ["\0"]
        if not text:
            return out
        if not self.cuts or "\0" in text:
            return [*out, "\0" + text]
        for i, line in enumerate(text.split("\n") if self.breaks else [text]):
            if i:
                out.append("\0\n")
            if BLANK * 2 in line or line[-1:] == BLANK:
                out += ["\0" + p for p in _PARTS.findall(line)]
            elif line:
                words = line.split(BLANK)
                words[0] = "\0" + words[0]
                out += words[1:] if words[0] == "\0" else words
        return out

    def _learn(self):
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        parts = [BLANK + k if k[:1] != "\0" else k[1:] for k in new]
        found = self.core.encode(parts, num_threads=1)
        found = [[self.begin_id] if k == "\0" else ids for k, ids in zip(new, found, strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        self._room(len(new), int(n.sum()))
        at = slice(self.known, self.known + len(new))
        self.lengths[at], self.starts[at] = n, self.used + np.cumsum(n) - n
        self.pool[self.used : self.used + int(n.sum())] = [i for ids in found for i in ids]
        self.used += int(n.sum())
        self.known += len(new)


class SpanEncoder:
    """Encodes texts to ids and byte spans, decodes ids."""

    def __init__(self, file: str, cache_parts: int = CACHE_PARTS):
        with open(file, "rb") as f:
            self._load(f.read(), cache_parts)

    @classmethod
    def from_bytes(cls, model: bytes, cache_parts: int = CACHE_PARTS) -> SpanEncoder:
        made = cls.__new__(cls)
        made._load(model, cache_parts)
        return made

    def _load(self, model: bytes, cache_parts: int):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = np.array([p.type for p in proto.pieces])
        if (kinds == USER_DEFINED).any() or proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model has user-defined pieces, blanks as suffixes or no byte fallback")
        spec = proto.normalizer_spec
        self.characters = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.whole = SentencePieceProcessor(model_proto=model)
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        core = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.widths = np.array([0 if k in (CONTROL, BYTE) else len(p.piece.encode()) for k, p in zip(kinds, proto.pieces, strict=True)], np.int64)
        self.is_byte = kinds == BYTE
        self.follows = np.array([k == BYTE and 0x80 <= int(p.piece[3:-1], 16) < 0xC0 for k, p in zip(kinds, proto.pieces, strict=True)])
        # a part may end before a blank only where no piece goes on across it, and at a line feed only where no piece holds one
        pieces = [p.piece for p in proto.pieces if p.type == NORMAL]
        cuts = BLANK in pieces and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        self.parts = PartEncoder(core, (self.whole.bos_id(), self.whole.eos_id()), cuts, not any("\n" in p for p in pieces), cache_parts)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The text that is split into pieces, and for each of its bytes, and for its end, the source byte."""
        data = text.encode()
        raw, origin = self.characters(data)
        if self.squeeze:
            blank = raw == 0x20
            keep = ~blank | ~np.concatenate([[True], blank[:-1]])[: len(raw)]
            raw, origin = raw[keep], origin[keep]
        mark = BLANK if self.escape else " "
        flat, origin = raw.tobytes().decode(), np.append(origin, np.int32(len(data)))
        if flat and self.escape:
            origin = np.repeat(origin, np.append(1 + 2 * (raw == 0x20), 1))
            flat = flat.replace(" ", BLANK)
        if data and self.prefix:
            start = self.characters.blanks(data) if self.squeeze else 0
            flat, origin = mark + flat, np.concatenate([np.full(len(mark.encode()), start, np.int32), origin])
        if self.squeeze:  # blanks at the end go, and are in no span
            flat = flat.rstrip(mark)
            origin = origin[: len(flat.encode()) + 1]
        return flat, origin

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, with begin and end ids, first and last byte of each id's span, and each text's number of ids."""
        aligned = [self.normalise(text or "") for text in texts]
        ids, n = self.parts([flat for flat, _ in aligned])
        ends = np.cumsum(n)
        width = self._width(ids)
        to = np.cumsum(width)
        begins, stops = np.empty(len(ids), np.int32), np.empty(len(ids), np.int32)
        first = 0
        for last, (_, origin) in zip(ends.tolist(), aligned, strict=True):
            here = to[first:last] - (to[first - 1] if first else 0)
            if here[-1] != len(origin) - 1:
                raise AssertionError("pieces do not cover the normalised text")
            stops[first:last] = origin[here]
            begins[first:last] = origin[here - width[first:last]]
            first = last
        return ids, begins, stops, n

    def _width(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes of each id; those of a character in byte pieces count at its last piece."""
        width = self.widths[ids]
        at = np.flatnonzero(self.is_byte[ids])
        if len(at):
            follows = self.follows[ids[at]]
            lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            last = np.append(~follows[1:] | (np.diff(at) > 1), True)
            width[at[last]] = (np.arange(len(at)) - lead + 1)[last]
        return width

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode(ids, num_threads=1) if ids else []


def _shared(file: str) -> SpanEncoder:
    held = cache_of("piece_spans")
    if file not in held:
        held[file] = SpanEncoder(file)
    return held[file]


def encode(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, begins, ends (all three little-endian unsigned 32-bit), n_bytes, covered (bytes of the text that lie in a
    span); with ``decoded`` the text of the ids too, by the same worker."""

    def run(stream):
        spans = _shared(model)
        for batch in stream:
            for texts, rest in batches(batch, 1 << 19):
                ids, begins, ends, n = spans(texts)
                last = np.cumsum(n)
                cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(last - n, last, strict=True)], pa.binary())  # noqa: B023, E731
                covered = np.concatenate([[0], np.cumsum(ends - begins, dtype=np.int64)])
                columns = {
                    "doc_id": rest.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(n), "ids": cut(ids.astype("<u4")), "begins": cut(begins.astype("<u4")), "ends": cut(ends.astype("<u4")),
                    "n_bytes": pa.array([len((t or "").encode()) for t in texts], pa.int64()), "covered": pa.array(covered[last] - covered[last - n]),
                }
                if decoded:
                    columns["decoded"] = pa.array(spans.decode([ids[i:j].tolist() for i, j in zip(last - n, last, strict=True)]), pa.string())
                yield pa.record_batch(columns)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, begins binary, ends binary, n_bytes long, covered long" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows with the text of ``ids`` as column ``decoded`` instead."""
    kept = [c for c in encoded.columns if c != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "ids") + (", " if kept else "") + "decoded string"

    def run(stream):
        spans = _shared(model)
        for batch in stream:
            ids, first, held = batch.column("ids"), 0, 0
            rest = batch.select(kept)
            sizes = [len(i.as_buffer()) if i.is_valid else 0 for i in ids]
            for i, size in enumerate(sizes):
                held += size
                if held > 4 << 20 or i + 1 == len(sizes):
                    lists = [np.frombuffer(x.as_buffer(), "<u4").tolist() if x.is_valid else [] for x in ids[first : i + 1]]
                    yield rest.slice(first, i + 1 - first).append_column("decoded", pa.array(spans.decode(lists), pa.string()))
                    first, held = i + 1, 0

    return encoded.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all ``documents``, digests of ids and of the decoded texts."""
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file(MODEL), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "n_bytes", "covered")
