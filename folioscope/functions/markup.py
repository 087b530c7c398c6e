"""HTML and XML helpers."""

from __future__ import annotations

import html as _html
import json
import posixpath
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entities that are decoded by name.
ENTITIES = "amp lt gt quot apos nbsp laquo raquo eacute egrave agrave ccedil ecirc ocirc ugrave icirc rsquo lsquo ldquo rdquo hellip mdash ndash oelig".split()
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|(" + "|".join(ENTITIES) + "));")


def decode(text: str) -> str:
    def one(m):
        if m[3]:
            return "'" if m[3] == "apos" else _html.unescape(m[0])
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text)


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Numeric and the common named entities."""
    return text.map(decode, na_action="ignore")


def strip_tags(markup: Column) -> Column:
    """Text between tags, white space collapsed; entities stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def escape_xml(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, in either kind of quotes; null where it is absent."""
    double, single = (F.regexp_extract(tag, rf"(?is)(?:^|[\s<]){name}\s*=\s*{q}([^{q}]*){q}", 1) for q in ('"', "'"))
    return F.coalesce(F.nullif(double, F.lit("")), F.nullif(single, F.lit("")))


def resolve(base: str, href: str) -> str:
    """Path of ``href`` seen from the folder of ``base``, percent signs decoded, fragment dropped."""
    path = unquote(href.split("#")[0])
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), path)).lstrip("/") if path else base


def relative(base: str, target: str) -> str:
    return posixpath.relpath(target, posixpath.dirname(base) or ".")


@F.pandas_udf(StringType())
def resolve_path(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else resolve(b, h) for b, h in zip(base, href, strict=True)])


@F.pandas_udf(StringType())
def relative_path(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or t is None else relative(b, t) for b, t in zip(base, target, strict=True)])


def first_json(text: str, opener: str = "{") -> str | None:
    """The first complete JSON value that starts with ``opener`` inside prose."""
    decoder = json.JSONDecoder()
    for m in re.finditer(re.escape(opener), text or ""):
        try:
            return json.dumps(decoder.raw_decode(text, m.start())[0])
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def json_object(text: pd.Series) -> pd.Series:
    return text.map(first_json, na_action="ignore")


@F.pandas_udf(StringType())
def json_array(text: pd.Series) -> pd.Series:
    return text.map(lambda t: first_json(t, "["), na_action="ignore")
