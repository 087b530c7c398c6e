"""Puts written files in place of the ones they were made from."""

from __future__ import annotations

import os
import shutil
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame

KEPT = ".original"


def put(path: str, content: bytes, kept: str = KEPT) -> None:
    """Replaces a file at once; the first time, the original stays beside it and is never overwritten."""
    at = unquote(urlparse(path).path) if path.startswith("file:") else path
    if not os.path.exists(at + kept):
        shutil.copy2(at, f"{at}{kept}.part")
        os.replace(f"{at}{kept}.part", at + kept)
    with open(f"{at}.part", "wb") as out:
        out.write(content)
        out.flush()
        os.fsync(out.fileno())
    os.replace(f"{at}.part", at)


def replace(files: DataFrame, written: DataFrame) -> DataFrame:
    """doc_id, path, status, message after the ``ok`` rows of ``written`` (doc_id, status, message, content) took the place of their
    files (doc_id, path) in a folder that all executors mount; a file that can't be replaced stays as it is."""

    def run(frames):
        for f in frames:
            out = []
            for doc_id, path, status, message, content in zip(*(f[c] for c in ("doc_id", "path", "status", "message", "content")), strict=True):
                try:
                    if status == "ok":
                        put(path, bytes(content))
                        status = "replaced"
                except OSError as e:
                    status, message = "error", str(e)[:200]
                out.append((doc_id, path, status, message))
            yield pd.DataFrame(out, columns=["doc_id", "path", "status", "message"])

    rows = written.join(files.select("doc_id", "path"), "doc_id")
    return rows.select("doc_id", "path", "status", "message", "content").mapInPandas(run, "doc_id long, path string, status string, message string")
