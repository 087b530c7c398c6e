"""Text keys and numerals as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import LEADING_NUMBER, TRUTH_NUMBER

#: White space as the text sources use it: Unicode's, the no-break space and the byte-order mark among it.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _accents() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is an ASCII letter and marks, and those letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(m) for m in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_MARKED, _BASE = _accents()


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_line(text: Column) -> Column:
    """A line without soft hyphens and zero-width marks, white space collapsed."""
    return collapse(F.regexp_replace(text, r"[\x{00AD}\x{200B}-\x{200F}]", ""))


def strip_accents(text: Column) -> Column:
    """Canonical decomposition without its marks, for Latin letters."""
    return F.regexp_replace(F.translate(text, _MARKED, _BASE), r"[\x{0300}-\x{036F}]", "")


def norm_key(text: Column) -> Column:
    """Lower case, letters, digits and single blanks; blanks around removed marks stay."""
    lowered = F.regexp_replace(F.lower(text), f"{SPACE}+", " ")
    return F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N} ]", ""))


def _without_folios(text: Column) -> Column:
    # word borders are those of ASCII: an accented letter is none of the word
    text = F.regexp_replace(text, r"[0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?<![A-Za-z0-9_])[ivxlcdm]{1,7}(?![A-Za-z0-9_])", " "), " +", " "))


def running_key(text: Column) -> Column:
    """Key of a running head: the same whatever its folio."""
    return _without_folios(norm_key(text))


def plain(text: Column) -> Column:
    """Lower-case ASCII letters, digits and apostrophes, single blanks."""
    text = F.translate(strip_accents(F.lower(text)), "’‘", "''")
    return F.trim(F.regexp_replace(text, "[^a-z0-9']+", " "))


def title_key(text: Column) -> Column:
    """``plain`` without a number at the start."""
    return plain(F.regexp_replace(text, LEADING_NUMBER, ""))


def key_tokens(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: F.length(w) > 2)


def tokens(text: Column) -> Column:
    return key_tokens(title_key(text))


def located_run_key(text: Column) -> Column:
    """Running-head key of an index line."""
    return _without_folios(plain(text))


def page_run_key(text: Column) -> Column:
    """Running-head key of a contents row: apostrophes go as well."""
    return _without_folios(F.trim(F.regexp_replace(strip_accents(F.lower(text)), "[^a-z0-9 ]+", " ")))


def letters_key(text: Column) -> Column:
    """Letters alone, without numbers or Roman folios at the start."""
    text = F.regexp_replace(strip_accents(F.lower(text)), r"^\s*(?:[0-9ivxlcdm]+[.)]?\s+)+", "")
    return F.trim(F.regexp_replace(text, "[^a-z]+", " "))


def style_key(font: Column, size: Column) -> Column:
    """Font and size to half points."""
    return F.concat_ws("|", F.coalesce(font, F.lit("")), round_half_up(F.coalesce(size, F.lit(0.0)) * 2) / 2)


def truth_key(title: Column) -> Column:
    """Key of a title when an outline is compared with a true one."""
    text = F.lower(strip_accents(F.regexp_replace(title, TRUTH_NUMBER, "")))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def same_title(a: Column, b: Column) -> Column:
    """Two truth keys that are equal, or of which one with 8 letters or more starts the other."""
    short, long_ = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | ((F.length(short) >= 8) & F.startswith(long_, short)))


#: Fixed values of Roman numerals.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman_to_int(text: Column) -> Column:
    """Value of a numeral: a sign before a greater one is subtracted; null for other characters or an empty text."""
    values = F.transform(F.split(F.lower(text), ""), lambda c: sum((F.when(c == s, v).otherwise(0) for v, s in ROMAN if len(s) == 1), F.lit(0)))
    total = F.aggregate(
        values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda s, v: F.struct((s["sum"] + v - F.when(s["last"] < v, 2 * s["last"]).otherwise(0)).alias("sum"), v.alias("last")),
    )["sum"]
    return F.when(F.lower(text).rlike("^[ivxlcdm]+$"), total)


def int_to_roman(n: Column) -> Column:
    """Numeral of a whole number from 1; an empty text below."""
    steps = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])
    return F.aggregate(
        steps, F.struct(n.cast("int").alias("rest"), F.lit("").alias("out")),
        lambda a, r: F.struct((a["rest"] % r["v"]).cast("int").alias("rest"), F.concat(a["out"], F.repeat(r["s"], F.greatest(F.lit(0), F.floor(a["rest"] / r["v"]).cast("int")))).alias("out")),
    )["out"]


def letter_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def word_count(text: Column) -> Column:
    return F.size(F.split(text, f"{SPACE}+"))


def upper_median(values: Column) -> Column:
    """Element floor(n/2) of the sorted values; null for none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))
