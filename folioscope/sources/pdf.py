"""PDF files: objects, pages, text fragments. Plain Python per file; one file is one row."""

from __future__ import annotations

import re
import time
import unicodedata
import zlib
from contextlib import suppress
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.fold import each_file
from ..schemas import FRAGMENT, PAGE

#: Seconds for one page, and pages in a row that may fail before a file is given up.
PAGE_SECONDS, STALLS = 20.0, 3
MAX_PAGES, MAX_DEPTH = 20_000, 64


class Name(str):
    """A PDF name."""


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int


@dataclass
class Stream:
    dict: dict
    raw: bytes


class Keyword(bytes):
    """A bare word: an operator or obj, endobj, R, …"""


_TOKEN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


#: White space and comments; the rest of a reference behind its number.
_BLANKS = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REFERENCE = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
#: What most values are: a word, a string without marks within, an even number of digits.
_WORD = re.compile(rb"[\0\t\n\f\r ]*([^\0\t\n\f\r ()<>\[\]{}/%]+)")
_PLAIN = re.compile(rb"\(([^()\\]*)\)")
_HEX = re.compile(rb"<((?:[0-9a-fA-F]{2})*)>")
_RUN = re.compile(rb"[^()\\]+")
_OCTAL = re.compile(rb"[0-7]{1,3}")
#: Values of words that were met, and how many of them are remembered.
_WORDS: dict = {}
WORDS = 1 << 14


def _word(token: bytes):
    """A number, true, false, null or a keyword."""
    if not _NUMBER.match(token):
        value = {b"true": True, b"false": False, b"null": None}.get(token, Keyword(token))
    else:
        value = float(token) if b"." in token else int(token)
    if len(_WORDS) >= WORDS:
        _WORDS.clear()
    _WORDS[token] = value
    return value


class Lexer:
    """Values one after another from ``pos``."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def _skip(self):
        self.pos = _BLANKS.match(self.data, self.pos).end()

    def value(self, depth: int = 0):
        """The next value; EOFError at the end. Two numbers and R make a reference."""
        data = self.data
        m = _WORD.match(data, self.pos)
        if m and depth <= 200:
            self.pos = m.end()
            token = m[1]
            found = _WORDS[token] if token in _WORDS else _word(token)
            if type(found) is int and token.isdigit():
                ref = _REFERENCE.match(data, self.pos)
                if ref:
                    self.pos = ref.end()
                    return Ref(found, int(ref[1]))
            return found
        self._skip()
        p = self.pos
        if p >= len(data) or depth > 200:
            raise EOFError
        c = data[p : p + 1]
        if c == b"/":
            m = _TOKEN.match(data, p + 1)
            self.pos = m.end() if m else p + 1
            return Name(re.sub(rb"#([0-9a-fA-F]{2})", lambda x: bytes([int(x[1], 16)]), m[0] if m else b"").decode("latin-1"))
        if data[p : p + 2] == b"<<":
            self.pos += 2
            out = {}
            while True:
                self._skip()
                if self.data[self.pos : self.pos + 2] == b">>":
                    self.pos += 2
                    return out
                key = self.value(depth + 1)
                if not isinstance(key, Name):
                    continue
                self._skip()
                if self.data[self.pos : self.pos + 2] == b">>":
                    continue
                out[str(key)] = self.value(depth + 1)
        if c == b"[":
            self.pos += 1
            items = []
            while True:
                self._skip()
                if self.data[self.pos : self.pos + 1] == b"]":
                    self.pos += 1
                    return items
                items.append(self.value(depth + 1))
        if c == b"(":
            return self._string()
        if c == b"<":
            if m := _HEX.match(data, p):
                self.pos = m.end()
                return bytes.fromhex(m[1].decode())
            end = data.find(b">", p)
            self.pos = (end if end >= 0 else len(data)) + 1
            digits = re.sub(rb"[^0-9a-fA-F]", b"", data[p + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if _TOKEN.match(data, p):  # behind a comment
            return self.value(depth)
        self.pos += 1
        return Keyword(c)

    def _string(self):
        plain = _PLAIN.match(self.data, self.pos)
        if plain:
            self.pos = plain.end()
            return plain[1]
        out, depth, i, data = bytearray(), 1, self.pos + 1, self.data
        while i < len(data):
            if run := _RUN.match(data, i):
                out += run[0]
                i = run.end()
                continue
            c = data[i : i + 1]
            if c == b"\\":
                octal = _OCTAL.match(data, i + 1)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    i = octal.end()
                    continue
                n = data[i + 1 : i + 2]
                i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                out += b"" if n in (b"\r", b"\n") else _ESCAPES.get(n, n)
                continue
            depth += (c == b"(") - (c == b")")
            i += 1
            if not depth:
                break
            out += c
        self.pos = i
        return bytes(out)


def _predict(data: bytes, parms: dict) -> bytes:
    """Undoes TIFF and PNG predictors."""
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, colors) if bits == 8 else None
        return data if rows is None else np.cumsum(rows, 1, dtype=np.uint8).tobytes()
    out, last = bytearray(), bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        how, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width):
            a, b, c = (row[i - step] if i >= step else 0), last[i], (last[i - step] if i >= step else 0)
            if how == 1:
                row[i] = (row[i] + a) & 255
            elif how == 2:
                row[i] = (row[i] + b) & 255
            elif how == 3:
                row[i] = (row[i] + (a + b) // 2) & 255
            elif how == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[i] = (row[i] + near) & 255
        out += row
        last = row
    return bytes(out)


def inflate(raw: bytes) -> bytes:
    """Deflated data with or without a header; what can be read of damaged data."""
    for wbits in (15, -15):
        d = zlib.decompressobj(wbits)
        try:
            return d.decompress(raw) + d.flush()
        except zlib.error:
            out, d = bytearray(), zlib.decompressobj(wbits)
            try:
                for i in range(0, len(raw), 256):
                    out += d.decompress(raw[i : i + 256])
            except zlib.error:
                pass
            if out:
                return bytes(out)
    raise ValueError("stream can't be inflated")


@dataclass
class Pdf:
    data: bytes
    xref: dict = field(default_factory=dict)  # num -> ("at", offset, gen) or ("in", stream, index)
    trailer: dict = field(default_factory=dict)
    xref_stream: bool = False
    start: int = -1
    _cache: dict = field(default_factory=dict)
    _holders: dict = field(default_factory=dict)  # of object streams: data, first byte, numbers and places
    _fonts: dict = field(default_factory=dict)

    @classmethod
    def open(cls, data: bytes) -> Pdf:
        pdf = cls(data)
        at = data.rfind(b"startxref")
        try:
            pdf.start = int(re.match(rb"startxref\s+(\d+)", data[at : at + 40])[1])
            pdf._chain(pdf.start)
            if not isinstance(pdf.get(pdf.trailer.get("Root")), dict):
                raise ValueError("no catalog")
        except (EOFError, ValueError, TypeError, KeyError, IndexError, AttributeError):
            pdf._scan()
        return pdf

    def _chain(self, start: int):
        """Cross-reference parts from the newest to the oldest; an entry found first stays."""
        todo, seen = [start], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                continue
            seen.add(at)
            if re.compile(rb"\s*xref").match(self.data, at):
                trailer = self._table(at)
                todo += [trailer[k] for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]
            else:
                trailer = self._stream_table(at)
                self.xref_stream |= at == start
                todo += [trailer[k] for k in ("Prev",) if isinstance(trailer.get(k), int)]
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)

    def _table(self, at: int) -> dict:
        lex = Lexer(self.data, self.data.index(b"xref", at) + 4)
        while True:
            first = lex.value()
            if not isinstance(first, int):
                return lex.value()
            for num in range(first, first + lex.value()):
                offset, gen, kind = lex.value(), lex.value(), lex.value()
                if kind == b"n" and offset:
                    self.xref.setdefault(num, ("at", offset, gen))
                else:
                    self.xref.setdefault(num, None)

    def _stream_table(self, at: int) -> dict:
        stream = self._object_at(at)
        if not isinstance(stream, Stream):
            raise ValueError("no cross-reference stream")
        data, widths = self.decode(stream), stream.dict["W"]
        index = stream.dict.get("Index") or [0, stream.dict["Size"]]
        pos = 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for num in range(first, first + count):
                fields = []
                for w in widths:
                    fields.append(int.from_bytes(data[pos : pos + w], "big") if w else None)
                    pos += w
                kind = 1 if fields[0] is None else fields[0]
                self.xref.setdefault(num, ("at", fields[1], fields[2] or 0) if kind == 1 else ("in", fields[1], fields[2] or 0) if kind == 2 else None)
        return stream.dict

    def _scan(self):
        """A damaged file: every ``n g obj`` counts, the last of a number; the catalog is looked for."""
        self.start = -1
        self._holders, self._fonts = {}, {}
        self.xref, self._cache = {int(m[1]): ("at", m.start(), int(m[2])) for m in re.finditer(rb"(?<!\d)(\d{1,9})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj\b", self.data)}, {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                found = Lexer(self.data, m.end()).value()
                self.trailer |= found if isinstance(found, dict) else {}
            except EOFError:
                continue
        for num in list(self.xref):
            try:
                value = self.get(Ref(num, 0))
            except (EOFError, ValueError, KeyError):
                continue
            if isinstance(value, Stream) and value.dict.get("Type") == "ObjStm":
                for i, inner in enumerate(self._numbers(value)):
                    self.xref.setdefault(inner, ("in", num, i))
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            root = next((n for n in self.xref if isinstance(v := self.get(Ref(n, 0)), dict) and v.get("Type") == "Catalog"), None)
            if root is None:
                raise ValueError("no catalog")
            self.trailer["Root"] = Ref(root, 0)

    def _object_at(self, at: int):
        lex = Lexer(self.data, at)
        lex.value(), lex.value()
        if lex.value() != b"obj":
            raise ValueError(f"no object at {at}")
        value = lex.value()
        lex._skip()
        if isinstance(value, dict) and self.data[lex.pos : lex.pos + 6] == b"stream":
            begin = lex.pos + 6
            begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1
            length = value.get("Length")
            length = self.get(length) if isinstance(length, Ref) else length
            if not isinstance(length, int) or not re.compile(rb"\s*endstream").match(self.data, begin + length):
                end = self.data.find(b"endstream", begin)
                length = (end if end >= 0 else len(self.data)) - begin
            return Stream(value, self.data[begin : begin + length])
        return value

    def _numbers(self, stream: Stream) -> list[int]:
        lex = Lexer(self.decode(stream))
        return [lex.value() for _ in range(2 * stream.dict["N"])][::2]

    def get(self, value, hops: int = 32):
        """The value a reference leads to."""
        while isinstance(value, Ref):
            hops -= 1
            if hops < 0:
                raise ValueError("references go round")
            if value.num not in self._cache:
                entry = self.xref.get(value.num)
                self._cache[value.num] = None
                if entry and entry[0] == "at":
                    self._cache[value.num] = self._object_at(entry[1])
                elif entry:
                    data, first, heads = self._held(entry[1])
                    self._cache[value.num] = Lexer(data, first + heads[2 * entry[2] + 1]).value()
            value = self._cache[value.num]
        return value

    def _held(self, num: int) -> tuple[bytes, int, list[int]]:
        """An object stream, unpacked once for all of its objects."""
        if num not in self._holders:
            holder = self.get(Ref(num, 0))
            data = self.decode(holder)
            lex = Lexer(data)
            heads = [lex.value() for _ in range(2 * holder.dict["N"])]
            self._holders[num] = data, self.get(holder.dict["First"]), heads
        return self._holders[num]

    def font(self, ref, name: str) -> _Font | None:
        """The font that a resource names; one that is an object of its own is read once for all pages."""
        key = (ref, name) if isinstance(ref, Ref) else None
        if key in self._fonts:
            return self._fonts[key]
        value = self.get(ref)
        made = _Font(self, value, name) if isinstance(value, dict) else None
        if key:
            self._fonts[key] = made
        return made

    def decode(self, stream: Stream) -> bytes:
        filters, parms = self.get(stream.dict.get("Filter")), self.get(stream.dict.get("DecodeParms"))
        filters = [] if filters is None else filters if isinstance(filters, list) else [filters]
        parms = parms if isinstance(parms, list) else [parms] * len(filters)
        data = stream.raw
        for name, p in zip(filters, parms, strict=False):
            if self.get(name) in ("FlateDecode", "Fl"):
                data = _predict(inflate(data), {k: self.get(v) for k, v in (self.get(p) or {}).items()})
            elif self.get(name) in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9a-fA-F]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                raise ValueError(f"filter {name} isn't known")
        return data

    def pages(self) -> list[tuple[Ref, dict]]:
        """Pages in order, with what they inherit."""
        out, seen = [], set()

        def walk(ref, inherited, depth):
            if depth > MAX_DEPTH or len(out) >= MAX_PAGES or ref in seen:
                return
            if isinstance(ref, Ref):
                seen.add(ref)
            node = self.get(ref)
            if not isinstance(node, dict):
                return
            inherited = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            if isinstance(kids := self.get(node.get("Kids")), list) and node.get("Type") != "Page":
                for kid in kids:
                    walk(kid, inherited, depth + 1)
            else:
                out.append((ref, inherited | node))

        walk(self.get(self.trailer["Root"]).get("Pages"), {}, 0)
        return out

    @property
    def encrypted(self) -> bool:
        return self.trailer.get("Encrypt") is not None

    @property
    def has_outline(self) -> bool:
        outlines = self.get(self.get(self.trailer["Root"]).get("Outlines"))
        return isinstance(outlines, dict) and outlines.get("First") is not None


# ---- text
def _unicode_map(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "ignore")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9a-fA-F\s]+)>\s*<([0-9a-fA-F\s]*)>", block):
            out[int(a, 16)] = text(bytes.fromhex(b.decode()))
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>\s*(<[0-9a-fA-F]+>|\[[^\]]*\])", block):
            targets = [bytes.fromhex(x.decode()) for x in re.findall(rb"<([0-9a-fA-F]+)>", c)]
            for i, code in enumerate(range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1)):
                if c[:1] == b"[":
                    out[code] = text(targets[i]) if i < len(targets) else ""
                else:
                    out[code] = text(targets[0][:-2] + (int.from_bytes(targets[0][-2:], "big") + i & 0xFFFF).to_bytes(2, "big"))
    return out


class _Font:
    def __init__(self, pdf: Pdf, font: dict, name: str):
        self.name = str(pdf.get(font.get("BaseFont")) or name)
        self.wide = pdf.get(font.get("Subtype")) == "Type0"
        unicode_ = pdf.get(font.get("ToUnicode"))
        self.map = _unicode_map(pdf.decode(unicode_)) if isinstance(unicode_, Stream) else {} if self.wide else encoded(pdf, pdf.get(font.get("Encoding")))
        self.first, widths = pdf.get(font.get("FirstChar")) or 0, pdf.get(font.get("Widths")) or []
        self.widths = [pdf.get(w) for w in widths]
        self.known: dict[int, tuple[str, float]] = {}
        # of a simple font, all characters and widths by code; without a map and widths its text is decoded whole
        self.plain = not self.wide and not self.map and not self.widths
        self.glyphs = None if self.wide or self.plain else tuple(zip(*map(self.glyph, range(256)), strict=True))

    def glyph(self, code: int) -> tuple[str, float]:
        found = self.known.get(code)
        if found is None:
            text = self.map.get(code, "" if self.wide else bytes([code]).decode("cp1252", "ignore"))
            width = self.widths[code - self.first] if 0 <= code - self.first < len(self.widths) else 1000 if self.wide else 500
            found = self.known[code] = text, width
        return found

    def text(self, raw: bytes) -> tuple[str, float]:
        """Characters and width in thousandths."""
        if self.plain:
            return raw.decode("cp1252", "ignore"), 500.0 * len(raw)
        if self.glyphs:
            texts, widths = self.glyphs
            return "".join(map(texts.__getitem__, raw)), float(sum(map(widths.__getitem__, raw)))
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if self.wide else list(raw)
        glyphs = [self.glyph(c) for c in codes]
        return "".join([t for t, _ in glyphs]), float(sum([w for _, w in glyphs]))


#: Names of glyphs that are neither a letter with a mark, nor a number in their name, nor a letter themselves.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",",
    "hyphen": "-", "minus": "\u2212", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":",
    "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{",
    "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "\u2018", "quoteright": "\u2019", "quotedblleft": "\u201c", "quotedblright": "\u201d", "quotesinglbase": "\u201a", "quotedblbase": "\u201e",
    "guillemotleft": "\u00ab", "guillemotright": "\u00bb", "guilsinglleft": "\u2039", "guilsinglright": "\u203a", "endash": "\u2013", "emdash": "\u2014", "bullet": "\u2022", "ellipsis": "\u2026", "periodcentered": "\u00b7",
    "dagger": "\u2020", "daggerdbl": "\u2021", "section": "\u00a7", "paragraph": "\u00b6", "degree": "\u00b0", "copyright": "\u00a9", "registered": "\u00ae", "trademark": "\u2122", "Euro": "\u20ac", "sterling": "\u00a3",
    "yen": "\u00a5", "cent": "\u00a2", "exclamdown": "\u00a1", "questiondown": "\u00bf", "fi": "\ufb01", "fl": "\ufb02", "ff": "\ufb00", "ffi": "\ufb03", "ffl": "\ufb04", "germandbls": "\u00df", "ae": "\u00e6",
    "AE": "\u00c6", "oe": "\u0153", "OE": "\u0152", "oslash": "\u00f8", "Oslash": "\u00d8", "lslash": "\u0142", "Lslash": "\u0141", "eth": "\u00f0", "Eth": "\u00d0", "thorn": "\u00fe", "Thorn": "\u00de",
    "dotlessi": "\u0131", "mu": "\u00b5", "multiply": "\u00d7", "divide": "\u00f7", "plusminus": "\u00b1", "nbspace": " ", "softhyphen": "",
}
#: Names of marks at the end of a letter's name, and the combining characters.
MARKS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "macron": "\u0304", "breve": "\u0306", "dotaccent": "\u0307", "dieresis": "\u0308", "ring": "\u030a", "hungarumlaut": "\u030b", "caron": "\u030c", "cedilla": "\u0327", "ogonek": "\u0328"}
#: Encodings that have a name, and Python's names of them.
ENCODINGS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}


def glyph_text(name: str) -> str:
    """Characters of a glyph by its name; none for a name that says nothing."""
    name = name.split(".")[0]
    if len(name) == 1 or name in GLYPHS:
        return GLYPHS.get(name, name)
    number = re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name)
    if number:
        points = re.findall("....", number[1]) if number[1] else [number[2]]
        return "".join(chr(p) for p in (int(x, 16) for x in points) if p < 0xD800 or 0xDFFF < p < 0x110000)
    mark = MARKS.get(name[1:])
    return unicodedata.normalize("NFC", name[0] + mark) if mark else ""


def encoded(pdf: Pdf, encoding) -> dict[int, str]:
    """Characters of the codes of a simple font's encoding: a named one, and the differences from it."""
    base = encoding if isinstance(encoding, str) else pdf.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else None
    codec = ENCODINGS.get(str(base))
    out = {c: bytes([c]).decode(codec, "ignore") for c in range(256)} if codec else {}
    at = 0
    for item in (pdf.get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
        item = pdf.get(item)
        if isinstance(item, str):
            if text := glyph_text(str(item)):
                out[at] = text
            at += 1
        elif isinstance(item, (int, float)):
            at = int(item)
    return out


def _times(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


#: Forms within forms that are followed.
FORM_DEPTH = 12


def page_fragments(pdf: Pdf, page: dict, seconds: float = PAGE_SECONDS) -> list[tuple]:
    """text, x, y, size, width, font, b, c of the strings that a page and the forms on it show; y grows upwards. ``TimeoutError`` after ``seconds``."""
    contents = pdf.get(page.get("Contents"))
    parts = [pdf.get(c) for c in contents] if isinstance(contents, list) else [contents]
    data = b"\n".join(pdf.decode(p) for p in parts if isinstance(p, Stream))
    out: list[tuple] = []
    _interpret(pdf, data, pdf.get(page.get("Resources")) or {}, (1, 0, 0, 1, 0, 0), out, time.monotonic() + seconds, ())
    return out


def _interpret(pdf: Pdf, data: bytes, resources: dict, ctm: tuple, out: list[tuple], deadline: float, within: tuple) -> None:
    """Adds the strings of a content stream. A form brings its own matrix and resources (else it has those around it); none is entered from itself."""
    fonts, forms = pdf.get(resources.get("Font")) or {}, pdf.get(resources.get("XObject")) or {}
    known: dict[str, _Font] = {}
    lex, stack = Lexer(data), []
    saved: list[tuple] = []
    tm = line = (1, 0, 0, 1, 0, 0)
    font, size, leading, spacing, stretch = None, 0.0, 0.0, 0.0, 1.0

    def show(raw):
        nonlocal tm
        text, width = font.text(raw) if font else (raw.decode("cp1252", "ignore"), 500.0 * len(raw))
        advance = (width / 1000 * size + spacing * len(raw)) * stretch
        m = _times(tm, ctm)
        scale = (m[2] ** 2 + m[3] ** 2) ** 0.5
        out.append((text, m[4], m[5], abs(size) * scale, abs(advance) * (m[0] ** 2 + m[1] ** 2) ** 0.5, font.name if font else "", m[1], m[2]))
        tm = _times((1, 0, 0, 1, advance, 0), tm)

    while True:
        try:
            value = lex.value()
        except EOFError:
            return
        if not isinstance(value, Keyword):
            stack.append(value)
            continue
        op, args, stack = bytes(value), stack, []
        if time.monotonic() > deadline:
            raise TimeoutError("page takes too long")
        try:
            if op == b"q":
                saved.append((ctm, font, size, leading, spacing, stretch))
            elif op == b"Q" and saved:
                ctm, font, size, leading, spacing, stretch = saved.pop()
            elif op == b"cm":
                ctm = _times(tuple(args[-6:]), ctm)
            elif op == b"BT":
                tm = line = (1, 0, 0, 1, 0, 0)
            elif op == b"Tf":
                name, size = str(args[-2]), float(args[-1])
                if name not in known and (made := pdf.font(fonts.get(name), name)):
                    known[name] = made
                font = known.get(name)
            elif op == b"TL":
                leading = args[-1]
            elif op == b"Tc":
                spacing = args[-1]
            elif op == b"Tz":
                stretch = args[-1] / 100
            elif op in (b"Td", b"TD"):
                leading = -args[-1] if op == b"TD" else leading
                tm = line = _times((1, 0, 0, 1, args[-2], args[-1]), line)
            elif op == b"Tm":
                tm = line = tuple(args[-6:])
            elif op == b"T*":
                tm = line = _times((1, 0, 0, 1, 0, -leading), line)
            elif op in (b"Tj", b"'", b'"'):
                if op != b"Tj":
                    tm = line = _times((1, 0, 0, 1, 0, -leading), line)
                show(args[-1])
            elif op == b"TJ":
                for a in args[-1]:
                    if isinstance(a, bytes):
                        show(a)
                    else:
                        tm = _times((1, 0, 0, 1, -a / 1000 * size * stretch, 0), tm)
            elif op == b"Do" and len(within) < FORM_DEPTH:
                ref = forms.get(str(args[-1]))
                form = pdf.get(ref)
                key = ref if isinstance(ref, Ref) else id(form)
                if isinstance(form, Stream) and key not in within and pdf.get(form.dict.get("Subtype")) == "Form":
                    matrix = tuple(float(pdf.get(v)) for v in pdf.get(form.dict.get("Matrix")) or (1, 0, 0, 1, 0, 0))
                    _interpret(pdf, pdf.decode(form), pdf.get(form.dict.get("Resources")) or resources, _times(matrix, ctm), out, deadline, (*within, key))
            elif op == b"ID":
                end = re.compile(rb"\sEI\b").search(data, lex.pos)
                lex.pos = end.end() if end else len(data)
        except (IndexError, TypeError, ValueError):
            continue


def _box(pdf: Pdf, page: dict) -> tuple[float, float, float]:
    box = [pdf.get(v) for v in pdf.get(page.get("CropBox")) or pdf.get(page.get("MediaBox")) or [0, 0, 612, 792]]
    return float(abs(box[2] - box[0])), float(abs(box[3] - box[1])), float(max(box[1], box[3]))


def inspect(files: DataFrame) -> DataFrame:
    """doc_id, readable, encrypted, has_outline, pages, xref_stream, message."""

    def inspected(doc_id, content):
        try:
            pdf = Pdf.open(bytes(content))
            return [(doc_id, True, pdf.encrypted, pdf.has_outline, len(pdf.pages()), pdf.xref_stream, None)]
        except Exception as e:  # a broken file is a row
            return [(doc_id, False, False, False, 0, False, str(e)[:200])]

    return each_file(files.select("doc_id", "content"), inspected, "doc_id long, readable boolean, encrypted boolean, has_outline boolean, pages int, xref_stream boolean, message string")


def read_pages(content: bytes, one, most: int = MAX_PAGES, stalls: int = STALLS):
    """(page number, rows of ``one(pdf, page, number)`` or the error) of each page; a file that fails is opened once more, and
    reading ends after ``stalls`` pages in a row that fail."""
    try:
        pdf = Pdf.open(content)
        found = pdf.pages()[:most]
    except Exception:
        pdf = Pdf.open(content)
        found = pdf.pages()[:most]
    failed = 0
    for i, (_, page) in enumerate(found):
        try:
            rows = one(pdf, page, i)
            failed = 0
            yield i, rows
        except Exception as e:  # a page that can't be read is left out
            failed += 1
            yield i, e
            if failed >= stalls:
                return


def _read(files: DataFrame, one, schema: str, most: int) -> DataFrame:
    def read(doc_id, content):
        with suppress(Exception):  # ``report`` says why; pages that fail are no exceptions
            for _, found in read_pages(bytes(content), lambda pdf, page, i: one(pdf, page, doc_id, i), most):
                yield from () if isinstance(found, Exception) else found

    return each_file(files.select("doc_id", "content"), read, schema)


def report(files: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """doc_id, status (ok, aborted or unreadable), pages, read, skipped, message: what became of each file's pages."""

    def run(frames):
        for f in frames:
            out = []
            for doc_id, content in zip(f["doc_id"], f["content"], strict=True):
                try:
                    pages = len(Pdf.open(bytes(content)).pages())
                    found = list(read_pages(bytes(content), lambda pdf, page, i: page_fragments(pdf, page), most))
                    errors = [e for _, e in found if isinstance(e, Exception)]
                    status = "ok" if len(found) == min(pages, most) else "aborted"
                    out.append((doc_id, status, pages, len(found) - len(errors), pages - len(found) + len(errors), str(errors[0])[:200] if errors else None))
                except Exception as e:
                    out.append((doc_id, "unreadable", 0, 0, 0, str(e)[:200]))
            yield pd.DataFrame(out, columns=["doc_id", "status", "pages", "read", "skipped", "message"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, status string, pages int, read int, skipped int, message string")


def pages(files: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """Page sizes of PDF files (doc_id, content)."""
    return _read(files, lambda pdf, page, doc_id, i: [(doc_id, i, *_box(pdf, page))], PAGE, most)


def fragments(files: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """Upright text fragments of PDF files; texts of fonts without a Unicode map are read as Windows-1252."""

    def one(pdf, page, doc_id, i):
        found = [f for f in page_fragments(pdf, page) if f[0].strip() and abs(f[6]) <= 0.01 and abs(f[7]) <= 0.01]
        return [(doc_id, i, k, *f[:6]) for k, f in enumerate(found)]

    return _read(files, one, FRAGMENT, most)


def page_refs(pdf: Pdf) -> list[Ref]:
    return [ref for ref, _ in pdf.pages()]
