"""Predicates and parsers of one line, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import BARE, LEADING_NUMBER, PRINTED_FILL, PRINTED_ROW, STRONG_GAP, SUPPLIED_FILL, SUPPLIED_ROW
from ..functions.text import letter_count, roman_to_int, word_count

# ---- fixed values: patterns in the two languages of the lexicon
_END = r"(?:[^A-Za-z0-9_]|$)"
KEYWORDS = (
    r"(?i)^(?:chapitre|chapter|partie|part|section|annexe|annexes|appendix|appendices"
    r"|introduction|conclusion|conclusions|discussion|discussions"
    r"|r[éÉe]sum[éÉe]|abstract|sommaire|table des mati[èÈe]res|contents"
    r"|bibliographie|r[éÉe]f[éÉe]rences|references|works cited"
    r"|remerciements|acknowledg(?:e)?ments|avant.propos|pr[éÉe]face|preface|foreword"
    r"|m[éÉe]thodes?|methods?|methodology|m[éÉe]thodologie"
    r"|r[éÉe]sultats?|results?|mat[éÉe]riel|materials and methods"
    r"|glossaire|glossary|index|notes?|epilogue|[éÉe]pilogue|prologue"
    r"|executive summary|synth[èÈe]se|recommandations|recommendations)" + _END
)
BOILERPLATE = (
    r"(?i)(?:https?://|www\.|doi\.org|jstor\.org|/stable/|all use subject to|this content downloaded|downloaded from"
    r"|terms (?:&|and) conditions|conditions g[éÉe]n[éÉe]rales|is collaborating with|not-for-profit|©|\(c\) 20[0-9][0-9]"
    r"|\bISSN\b|\bISBN\b|tous droits r[éÉe]serv[éÉe]s|all rights reserved|published by\b|stable url|you may need to log in)"
)
FOLIO = r"(?i)\s[/|·]\s*(?:[ivxlcdm]{1,7}|[0-9]{1,4})\s*$"
CAPTION = r"(?i)^(?:fig(?:ure)?|tab(?:le|leau)?|graphique|encadr[éÉe]|photo|source)\s*\.?\s*[0-9]"
TOC_LINE = r"(?i)(?:\.{3,}\s*|\s)(?:[ivxlcdm]{1,7}|[0-9]{1,4})\s*$"
TOC_TITLE = r"(?i)^(?:contents|table of contents|sommaire|table des mati[èÈe]res|index)$"
PRINTED_TITLE = (
    r"(?i)^(?:(?:brief|detailed|full|short)\s+)?(?:table\s+des\s+mati[eèÈ]res(?:\s+d[éÉe]taill[éÉe]e)?|sommaire(?:\s+d[éÉe]taill[éÉe])?"
    r"|contents(?:\s+in\s+brief|\s+in\s+detail)?|table\s+of\s+contents|plan(?:\s+de\s+l'ouvrage)?)$"
)
LIST_TITLE = (
    r"(?i)^(?:(?:list(?:e)?|table|index)\s+(?:of|des)\s+(?:figures?|tables?|tableaux|illustrations?|graphiques?|encadr[éÉe]s|sch[éÉe]mas"
    r"|abbreviations?|abr[éÉe]viations?|sigles))"
)
FIGURE_ENTRY = r"(?i)^(?:fig(?:ure)?|tab(?:le|leau)|graphique|encadr[éÉe]|illustration|planche|photo|sch[éÉe]ma|exhibit|box)\.?\s*[0-9IVX]"
BARE_WORD = r"(?i)^(?:chapitre|chapter|partie|part|section|livre|book|tome|annexe|appendix)\s*[0-9IVX]*\.?$"
PART_WORD = r"(?i)^(?:partie|part|livre|book|tome|volume)(?:[^A-Za-z0-9_]|$)"
HEADER_LINE = r"(?i)^(?:table\s+des\s+mati[eèÈ]res|sommaire|contents|table\s+of\s+contents|index)\s*$"
LONE_FOLIO = r"(?i)^[ivxlcdm0-9]{1,6}$"
NEXT_NUMBERED = r"^\s*(?:[0-9]+(?:\.[0-9]+)*|[IVXLC]+)[.)]?\s"


def is_keyword(text: Column) -> Column:
    return text.rlike(KEYWORDS)


def is_rejected(text: Column) -> Column:
    """Lines that are no heading whatever their style."""
    letters, n = letter_count(text), F.length(text)
    return F.coalesce(
        (n < 2) | (n > 200) | (letters < 2) | (letters / n < 0.35) | (word_count(text) > 18) | text.rlike(BOILERPLATE)
        | (text.rlike(r"@\S+\.\S+") & (n < 60)) | text.rlike(FOLIO) | text.rlike(CAPTION), F.lit(True),
    )


def is_prose(text: Column) -> Column:
    return (text.rlike(r"[.;:!?]$") & (F.length(text) > 90)) | (word_count(text) > 14)


def numbering(text: Column) -> Column:
    """Struct of depth, kind and rest; null where the line isn't numbered."""
    number = F.regexp_extract(text, r"^([0-9]+(?:[.\-][0-9]+)*)[.)]?(?:\s+|$)", 1)
    rest = F.trim(F.regexp_replace(text, r"^[0-9]+(?:[.\-][0-9]+)*[.)]?(?:\s+|$)", ""))
    depth = F.size(F.split(number, r"[.\-]"))
    year = (depth == 1) & (F.length(number) == 4) & (number.cast("int") > 1500)
    item = lambda d, kind, r: F.struct(d.cast("int").alias("depth"), F.lit(kind).alias("kind"), r.alias("rest"))
    # what a sign at the start takes with it: the sign, white space and the first character behind
    after = lambda p: F.trim(F.regexp_replace(text, p, ""))
    roman, letter = r"^[IVXLCDM]{1,7}[.)]\s+\S", r"^[A-Z][.)]\s+\S"
    return (
        F.when(number != "", F.when(~year & (depth <= 6) & (letter_count(rest) >= 2), item(depth, "num", rest)))
        .when(text.rlike(roman), item(F.lit(1), "roman", after(roman)))
        .when(text.rlike(letter), item(F.lit(2), "letter", after(letter)))
    )


def _split_result(title: Column, printed: Column, roman: Column) -> Column:
    return F.struct(title.alias("title"), printed.cast("int").alias("printed"), roman.alias("roman"))


def split_page(text: Column) -> Column:
    """Title and page of a printed contents row: struct of title, printed and roman; null where there is no reference."""
    trimmed = F.trim(text)
    number = F.regexp_extract(trimmed, PRINTED_ROW, 2)
    title = F.trim(F.regexp_replace(F.regexp_extract(trimmed, PRINTED_ROW, 1), PRINTED_FILL, ""))
    arabic = number.rlike("^[0-9]+$")
    value = F.when(arabic, number.cast("int")).otherwise(roman_to_int(number))
    year = arabic & (F.length(number) == 4) & (value > 1400) & (value < 2200) & ~text.rlike(r"\.{3,}")
    return F.when((number != "") & title.rlike(r"\p{L}") & ~year & (value.isNotNull()) & (arabic | (value > 0)), _split_result(title, value, ~arabic))


def split_trailing(text: Column) -> Column:
    """Title and page of a supplied contents row; a plain blank before the page is accepted with more care."""
    number, between = F.regexp_extract(text, SUPPLIED_ROW, 3), F.regexp_extract(text, SUPPLIED_ROW, 2)
    title = F.trim(F.regexp_replace(F.regexp_extract(text, SUPPLIED_ROW, 1), SUPPLIED_FILL, ""))
    strong = between.rlike(STRONG_GAP)
    arabic = number.rlike("^[0-9]+$")
    value = F.when(arabic, number.cast("int")).otherwise(roman_to_int(number))
    doubtful = ~strong & F.when(arabic, (F.length(number) == 4) & (value > 1400) & (value < 2200)).otherwise((number != F.lower(number)) | (F.length(number) > 4))
    return F.when((number != "") & title.rlike(r"\p{L}") & ~title.rlike(BARE) & ~doubtful & value.isNotNull() & (arabic | (value > 0)), _split_result(title, value, ~arabic))


def is_index_sign(text: Column) -> Column:
    """A line as in an index: several references, a range, a comma before the page, or a cross-reference."""
    return (
        text.rlike(r"[0-9]+\s*[,;]\s*[0-9]+") | text.rlike(r"[0-9]+\s*[\x{2013}\x{2014}-]\s*[0-9]+\s*(?:[,;]|$)")
        | text.rlike(r"(?i),\s*(?:[0-9]+|[ivxlcdm]+)\s*$") | text.rlike(r"(?i)^\s*(?:see|voir)\b")
    )


def is_wordy(text: Column) -> Column:
    return text.rlike(r"\p{L}{3}") & (letter_count(text) >= F.length(F.regexp_replace(text, r"\s", "")) * 0.6)


def relative_y(y: Column, height: Column) -> Column:
    """0 at the top of the page, 1 at its bottom."""
    return 1 - F.coalesce(y, F.lit(0.0)) / F.coalesce(F.nullif(height, F.lit(0.0)), F.lit(792.0))


def starts_numbered(text: Column) -> Column:
    return text.rlike(LEADING_NUMBER)


def confidence(headings: Column, pages: Column, density: Column, mean_score: Column) -> Column:
    """weak, medium or good."""
    return F.when((headings < 3) | (density > 6), "weak").when((mean_score < 5) | ((headings < 5) & (pages > 40)), "medium").otherwise("good")


def gate(mime: Column, readable: Column, editable: Column, encrypted: Column, outline: Column, overwrite: bool = False) -> Column:
    """Why a file is left alone: the first reason that holds, or null."""
    out = F.when(~mime.isin("application/pdf", "application/epub+zip"), "type").when(~editable, "read-only").when(~readable, "missing").when(encrypted, "encrypted")
    return out if overwrite else out.when(outline, "has outline")
