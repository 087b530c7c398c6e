"""Writes tables of contents into EPUB books: the navigation document, else the NCX, else a new navigation document."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import relative, resolve
from ..operators.fold import each_file
from ..operators.tree import tree
from ..sources.archive import unanchored

_HEADING = re.compile(r"(?is)<(h[1-6])\b([^>]*)>(.*?)</\1\s*>")


def add_anchors(markup: str, wanted: dict[int, str]) -> str:
    """Gives headings without an id, by their place, the anchors ``wanted``; from the back, so places stay right."""
    for place, m in reversed(list(enumerate(_HEADING.finditer(markup)))):
        if place in wanted and not re.search(r"(?is)(?:^|\s)id\s*=", m[2]):
            at = m.start(2)
            markup = f'{markup[:at]} id="{wanted[place]}"{markup[at:]}'
    return markup


def _nested(rows: list[dict], open_item, close_item, open_list: str, close_list: str) -> str:
    out, depth = [], 0
    for r in rows:
        if r["depth"] > depth:
            out.append(open_list)
        else:
            out += [close_item] + [close_list + close_item] * (depth - r["depth"])
        out.append(open_item(r))
        depth = r["depth"]
    return "".join(out) + close_item + (close_list + close_item) * (depth - 1) + close_list if rows else ""


def nav_list(rows: list[dict]) -> str:
    return _nested(rows, lambda r: f'<li><a href="{escape(r["href"])}">{escape(r["text"])}</a>', "</li>", "<ol>", "</ol>")


def nav_document(rows: list[dict], title: str = "Contents") -> str:
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">'
    return f'{head}<head><title>{escape(title)}</title></head><body><nav epub:type="toc" id="toc"><h1>{escape(title)}</h1>{nav_list(rows)}</nav></body></html>'


def nav_points(rows: list[dict]) -> str:
    def point(r):
        return f'<navPoint id="np-{r["seq"]}" playOrder="{r["seq"]}"><navLabel><text>{escape(r["text"])}</text></navLabel><content src="{escape(r["href"])}"/>'

    return _nested(rows, point, "</navPoint>", "", "")


def write_contents(content: bytes, rows: list[dict]) -> bytes:
    """The book with contents of ``rows`` (seq, depth, text, path, spine_pos, h_pos, anchor, target); other entries are kept as they are."""
    if len(rows) < 2:
        raise ValueError("fewer than two headings")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        entries = {i.filename: z.read(i) for i in z.infolist() if re.search(r"(?i)\.(?:x?html?|xml|opf|ncx)$", i.filename)}
    before = dict(entries)
    container = entries["META-INF/container.xml"].decode("utf-8", "replace")
    opf_path = re.search(r"(?is)<rootfile\b[^>]*full-path\s*=\s*[\"']([^\"']+)", container)[1]
    opf = entries[opf_path].decode("utf-8")
    items = {}
    for tag in re.findall(r"(?is)<(?:\w+:)?item\b[^>]*>", opf):
        attributes = dict(re.findall(r"([\w:-]+)\s*=\s*[\"']([^\"']*)", tag))
        items[resolve(opf_path, attributes.get("href", ""))] = attributes
    nav = next((p for p, a in items.items() if "nav" in a.get("properties", "").split()), None)
    ncx = next((p for p, a in items.items() if a.get("media-type") == "application/x-dtbncx+xml"), None)
    for path in {r["path"] for r in rows}:
        wanted = {r["h_pos"]: r["target"] for r in rows if r["path"] == path and not r["anchor"]}
        entries[path] = add_anchors(entries[path].decode("utf-8"), wanted).encode()
    home = nav or ncx or resolve(opf_path, "folioscope-nav.xhtml")
    rows = [r | {"href": relative(home, r["path"]) + "#" + r["target"]} for r in sorted(rows, key=lambda r: r["seq"])]
    if nav:
        old = entries[nav].decode("utf-8")
        m = re.search(r"(?is)(<nav\b[^>]*toc[^>]*>)(.*?)(</nav\s*>)", old)
        body = nav_list(rows)
        heading = re.match(r"(?is)\s*<h[1-6]\b.*?</h[1-6]\s*>", m[2]) if m else None
        entries[nav] = (old[: m.start(2)] + (heading[0] if heading else "") + body + old[m.end(2) :] if m else nav_document(rows)).encode()
    elif ncx:
        old = entries[ncx].decode("utf-8")
        entries[ncx] = re.sub(r"(?is)(<navMap\b[^>]*>).*?(</navMap\s*>)", lambda m: m[1] + nav_points(rows) + m[2], old, count=1).encode()
    else:
        entries[home] = nav_document(rows).encode()
        item = f'<item id="folioscope-nav" href="{relative(opf_path, home)}" media-type="application/xhtml+xml" properties="nav"/>'
        entries[opf_path] = re.sub(r"(?i)</((?:\w+:)?)manifest\s*>", lambda m: item + m[0], opf, count=1).encode()
    return rebuilt(content, {name: data for name, data in entries.items() if name not in before or before[name] != data})


def rebuilt(content: bytes, changed: dict[str, bytes]) -> bytes:
    """The archive with ``changed`` entries replaced or added; all others are copied as they are stored, without unpacking. ``mimetype`` comes first."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = sorted(z.infolist(), key=lambda e: e.filename != "mimetype")
    parts, directory, at, left = [], [], 0, dict(changed)
    for name, e in [*((e.filename, e) for e in infos), *((n, None) for n in changed if n not in {e.filename for e in infos})]:
        if name in changed and name not in left:
            continue  # a second entry of that name
        if name in left:
            data = left.pop(name)
            packer = zlib.compressobj(9, zlib.DEFLATED, -15)
            blob, method, crc, size = packer.compress(data) + packer.flush(), zipfile.ZIP_DEFLATED, zlib.crc32(data), len(data)
        else:
            start = e.header_offset + 30 + sum(struct.unpack_from("<HH", content, e.header_offset + 26))
            blob, method, crc, size = content[start : start + e.compress_size], e.compress_type, e.CRC, e.file_size
        if e is None:
            when = (0, 33)
        else:
            y, month, day, hour, minute, second = e.date_time
            when = (hour << 11 | minute << 5 | second // 2, (y - 1980) << 9 | month << 5 | day)
        raw = name.encode("utf-8")
        common = struct.pack("<HHHHHIIIHH", 20, 0 if raw.isascii() else 1 << 11, method, *when, crc, len(blob), size, len(raw), 0)
        parts += [b"PK\x03\x04", common, raw, blob]
        directory.append(b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, e.external_attr if e else 0, at) + raw)
        at += 30 + len(raw) + len(blob)
    whole = b"".join(directory)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(directory), len(directory), len(whole), at, 0)
    return b"".join([*parts, whole, end])


def write_all(files: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, status, message, content of each book (doc_id, content) with contents made of its headings."""
    placed = unanchored(tree(headings, ["spine_pos", "h_pos"]))
    rows = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "depth", "text", "path", "spine_pos", "h_pos", "anchor", "target"))).alias("rows"))

    def write(doc_id, content, own):
        try:
            return [(doc_id, "ok", None, write_contents(bytes(content), own or []))]
        except Exception as e:  # an unreadable book is skipped
            return [(doc_id, "skipped", str(e)[:200], None)]

    return each_file(files.select("doc_id", "content").join(rows, "doc_id", "left").select("doc_id", "content", "rows"), write, "doc_id long, status string, message string, content binary")
