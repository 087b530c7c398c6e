"""Fill-in-middle: a text is cut into prefix, middle and suffix at ends of its units, and its parts are put in another order.

An Arrow-batched pandas UDF does the work, a text at a time. ``regex`` finds the units, whose end offsets go into an array of
four bytes each; two lookups in it give the cuts. The cuts, the form and the digests come from hashlib: a text's cuts depend on
the seed and its own id alone, so that reruns and other partitionings agree, and a retried task gives the same rows.

Defined results: a null text counts as empty, an empty text and one that holds a mark stay plain; a null id is hashed as
no digits; repeated rows are transformed alike; an empty table gives an empty one; a text may be as long as a Spark string;
other columns are never read.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Per cent of texts that are transformed, and of these the share with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80
#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_units = regex.compile(UNITS)
ROW = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """End offsets of the units, in code points."""
    return array("I", (m.end() for m in _units.finditer(text)))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that depend on the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    prefix: str
    middle: str
    suffix: str


def cut(text: str, doc_id: int | None, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> Cut:
    ends = unit_ends(text)
    n = len(ends)
    one, two, three, four = draws(seed, doc_id)
    if not text or three % 100 >= transformed or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return Cut(n, "plain", text, "", "")
    first, last = sorted((one % (n + 1), two % (n + 1)))
    at, to = (ends[k - 1] if k else 0 for k in (first, last))
    return Cut(n, "spm" if four % 100 < suffix_first else "psm", text[:at], text[at:to], text[to:])


def assembled(parts: Cut) -> str:
    if parts.form == "plain":
        return parts.prefix
    if parts.form == "psm":
        return "".join((PREFIX, parts.prefix, SUFFIX, parts.suffix, MIDDLE, parts.middle))
    return "".join((SUFFIX, parts.suffix, PREFIX, parts.prefix, MIDDLE, parts.middle))


def restored(output: str, form: str) -> str:
    """The text again. No mark stands in a transformed text, nor across the border of a mark and a part, so each is found once."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX)
    return "".join((prefix, middle, suffix))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def transform(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256 of each row: its text in the new order
    and the digests of that and of the text rebuilt from it."""

    def rows(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for doc_id, text in zip(ids, texts, strict=True):
            parts = cut(text or "", None if pd.isna(doc_id) else int(doc_id), seed, transformed, suffix_first)
            output = assembled(parts)
            lengths = (None, None) if parts.form == "plain" else (len(parts.prefix), len(parts.middle))
            out.append((parts.n, parts.form, *lengths, output, _sha256(output), _sha256(restored(output, parts.form))))
        frame = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])
        return frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    udf = F.pandas_udf(rows, ROW)
    # an id as text keeps its digits where a batch holds nulls
    cut_rows = docs.select("doc_id", udf(F.col("doc_id").cast("string"), F.col("text")).alias("_f"))
    return cut_rows.select("doc_id", "_f.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: all ``documents``, digests of the outputs."""
    return transform(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("output")


ORACLE_SQL = rf"""with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, regexp_extract_all(text, '{UNITS}') as us, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, len(us)::bigint as n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) as a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(us[1:a], '') as pre, array_to_string(us[a + 1:b], '') as mid, array_to_string(us[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(case form when 'plain' then text else pre || mid || suf end) as restored_sha256 from p"""
