"""Writes outlines into PDF files as an incremental update: the original bytes stay, new objects and a cross-reference part follow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tree import tree
from ..sources.pdf import Name, Pdf, Ref, Stream


def pdf_text(title: str) -> bytes:
    """A text string: UTF-16 with a mark, in hexadecimal."""
    return b"<FEFF" + title.encode("utf-16-be", "surrogatepass").hex().upper().encode() + b">"


def serialise(value) -> bytes:
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return f"{value.num} {value.gen} R".encode()
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in value.encode("latin-1", "replace"))
    if isinstance(value, (int, float)):
        return (f"{value:.6f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)).encode()
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, list):
        return b"[" + b" ".join(map(serialise, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(serialise(Name(k)) + b" " + serialise(v) for k, v in value.items()) + b">>"
    raise TypeError(type(value))


def outline_objects(rows: list[dict], pages: list[Ref], first: int) -> dict[int, bytes]:
    """Objects of an outline whose root is number ``first``; rows in preorder with seq (from 1), parent_seq, title, page_index, y.

    Items below the first level are closed: their parents' counts are negative.
    """
    children: dict[int, list[int]] = {}
    for r in rows:
        children.setdefault(r["parent_seq"] or 0, []).append(r["seq"])

    def below(seq: int) -> int:
        return sum(1 + below(c) for c in children.get(seq, ()))

    ref = lambda seq: Ref(first + seq, 0)
    top = children.get(0, [])
    place = {seq: i for peers in children.values() for i, seq in enumerate(peers)}
    out = {first: serialise({"Type": Name("Outlines"), "First": ref(top[0]), "Last": ref(top[-1]), "Count": len(top)})}
    for r in rows:
        seq, own = r["seq"], children.get(r["seq"], [])
        peers = children[r["parent_seq"] or 0]
        i = place[seq]
        page = pages[max(0, min(int(r["page_index"]), len(pages) - 1))]
        item = {"Parent": ref(r["parent_seq"] or 0), "Prev": ref(peers[i - 1]) if i else None, "Next": ref(peers[i + 1]) if i + 1 < len(peers) else None}
        item |= {"First": ref(own[0]), "Last": ref(own[-1]), "Count": -below(seq)} if own else {}
        body = serialise({k: v for k, v in item.items() if v is not None} | {"Dest": [page, Name("XYZ"), None, r["y"], None]})
        out[first + seq] = body[:-2] + b" /Title " + pdf_text(r["title"]) + b">>"
    return out


def _sections(numbers: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for n in sorted(numbers):
        if out and n == out[-1][-1] + 1:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def write_outline(data: bytes, rows: list[dict]) -> bytes:
    """The file with an outline; ValueError for encrypted files and for fewer than two headings."""
    pdf = Pdf.open(data)
    if pdf.encrypted:
        raise ValueError("the file is encrypted")
    if len(rows) < 2:
        raise ValueError("fewer than two headings")
    pages = [ref for ref, _ in pdf.pages() if isinstance(ref, Ref)]
    if not pages:
        raise ValueError("no pages")
    root = pdf.trailer["Root"]
    size = max([*pdf.xref, root.num]) + 1
    catalog = pdf.get(root) | {"Outlines": Ref(size, 0), "PageMode": Name("UseOutlines")}
    bodies = {root.num: serialise(catalog)} | outline_objects(rows, pages, size)
    out = bytearray(data if data.endswith(b"\n") else data + b"\n")
    offsets: dict[int, tuple[int, int]] = {}
    for num, body in bodies.items():
        gen = root.gen if num == root.num else 0
        offsets[num] = len(out), gen
        out += b"%d %d obj\n%s\nendobj\n" % (num, gen, body)
    if pdf.start < 0:  # a damaged file gets a whole table, since there is none to continue
        if any(e and e[0] == "in" for e in pdf.xref.values()):
            raise ValueError("a damaged file with object streams")
        offsets = {n: (e[1], e[2]) for n, e in pdf.xref.items() if e} | offsets
    at, top = len(out), max(bodies) + 1
    trailer = {k: pdf.trailer[k] for k in ("Root", "Info", "ID") if k in pdf.trailer}
    if pdf.start >= 0:
        trailer["Prev"] = pdf.start
    if pdf.xref_stream:
        offsets[top] = at, 0
        parts = _sections(list(offsets))
        table = b"".join(b"\x01" + offsets[n][0].to_bytes(4, "big") + offsets[n][1].to_bytes(2, "big") for part in parts for n in part)
        head = {"Type": Name("XRef"), "Size": top + 1, "W": [1, 4, 2], "Index": [x for p in parts for x in (p[0], len(p))], "Length": len(table)} | trailer
        out += b"%d 0 obj\n%s\nstream\n%s\nendstream\nendobj\n" % (top, serialise(head), table)
    else:
        out += b"xref\n"
        for part in _sections(list(offsets)):
            out += b"%d %d\n" % (part[0], len(part))
            for n in part:
                out += b"%010d %05d n \n" % offsets[n]
        out += b"trailer\n" + serialise({"Size": top} | trailer) + b"\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)


def write_outlines(files: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, status (ok, skipped or error), message, content: each file with its headings written into it; inputs are never changed."""
    placed = tree(headings, ["page_index", F.desc("y"), "title"])
    rows = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "parent_seq", "title", "page_index", "y"))).alias("rows"))
    joined = files.select("doc_id", "content").join(rows, "doc_id", "left")

    def run(frames):
        for f in frames:
            out = []
            for doc_id, content, own in zip(f["doc_id"], f["content"], f["rows"], strict=True):
                own = [] if own is None else [dict(r) if isinstance(r, dict) else r.asDict() for r in own]
                for r in own:
                    r["parent_seq"] = None if pd.isna(r["parent_seq"]) else int(r["parent_seq"])
                    r["y"] = None if pd.isna(r["y"]) else int(r["y"])
                try:
                    out.append((doc_id, "ok", None, write_outline(bytes(content), own)))
                except ValueError as e:
                    out.append((doc_id, "skipped", str(e), None))
                except Exception as e:
                    out.append((doc_id, "error", str(e)[:200], None))
            yield pd.DataFrame(out, columns=["doc_id", "status", "message", "content"])

    return joined.mapInPandas(run, "doc_id long, status string, message string, content binary")


def existing_outline(data: bytes) -> list[tuple[int, str, int]]:
    """(level, title, page from 1) of a file's outline; page 0 where the target isn't a page."""
    pdf = Pdf.open(data)
    number = {ref: i + 1 for i, (ref, _) in enumerate(pdf.pages())}
    out, seen = [], set()

    def walk(ref, level):
        while isinstance(ref, Ref) and ref not in seen and level <= 64:
            seen.add(ref)
            item = pdf.get(ref)
            if not isinstance(item, dict):
                return
            raw = pdf.get(item.get("Title")) or b""
            title = raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
            dest = pdf.get(item.get("Dest") or (pdf.get(item.get("A")) or {}).get("D"))
            out.append((level, title, number.get(dest[0], 0) if isinstance(dest, list) and dest else 0))
            walk(item.get("First"), level + 1)
            ref = item.get("Next")

    outlines = pdf.get(pdf.get(pdf.trailer["Root"]).get("Outlines"))
    walk(outlines.get("First") if isinstance(outlines, dict) else None, 1)
    return out


def existing_outlines(files: DataFrame) -> DataFrame:
    """doc_id, seq (from 1), level, title, page (from 1, or 0) of the outlines that PDF files (doc_id, content) have; a broken file has no rows."""

    def run(frames):
        for f in frames:
            out = []
            for doc_id, content in zip(f["doc_id"], f["content"], strict=True):
                try:
                    out += [(doc_id, i, *item) for i, item in enumerate(existing_outline(bytes(content)), 1)]
                except Exception:  # a broken file
                    continue
            yield pd.DataFrame(out, columns=["doc_id", "seq", "level", "title", "page"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, seq int, level int, title string, page int")


__all__ = ["Stream", "existing_outline", "existing_outlines", "outline_objects", "pdf_text", "serialise", "write_outline", "write_outlines"]
