"""License scan as an exact set-similarity join between text blocks and license templates; DataFrame functions only.

A block is a run of words, each run overlapping the next by half. A template is found in a block that holds at least
``threshold`` of the template's distinct words (containment). Words are ordered by the number of documents that hold them,
rarest first; a block and a template that reach the threshold share a word within their prefixes in that order, and the
first such word leaves enough words after it on both sides (positional filter). Pairs that pass are counted exactly.
Words in no template cannot count, so the order and the block sets hold template words alone.

Defined results: null and empty texts have no words, no labels and score 0; null ids and repeated rows are kept; phrases
that overlap nothing are counted at each place; templates are found at any length, since blocks grow with the longest; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Phrases of the base scan and their labels.
PHRASES = (("mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices as they stand in texts.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9
#: Least words of a block; a block is at least twice as long as the longest template, so each notice lies whole in one.
BLOCK_WORDS = 32
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def base_places(rows: DataFrame, phrases=PHRASES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels to rows with ``_words``.

    Every word stands between blanks of its own, so a phrase's places are where the joined text splits at it.
    """
    rows = rows.withColumn("n_words", F.size("_words").cast("long")).withColumn("_line", F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" ")))
    count = lambda part: ((F.length(part) - F.length(F.replace(part, F.lit(" ")))) / 2).cast("long")
    found = []
    for i, (phrase, _) in enumerate(phrases):
        mark = " " + "  ".join(phrase.split()) + " "
        rows = rows.withColumn(f"_p{i}", F.when(F.contains("_line", F.lit(mark)), F.split("_line", mark)))
        found.append((F.col(f"_p{i}"), len(phrase.split())))
    n = sum((F.coalesce(F.size(p) - 1, F.lit(0)).cast("long") for p, _ in found), F.lit(0).cast("long"))
    many = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    first = many(F.least, [count(F.element_at(p, 1)) for p, _ in found])
    last = many(F.greatest, [F.col("n_words") - count(F.element_at(p, -1)) - k for p, k in found])
    labels = F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(label)) for (p, _), (_, label) in zip(found, phrases, strict=True)]))
    return rows.withColumns({"n_base": n, "first_word": first, "last_word": last, "_base": F.array_sort(F.array_distinct(labels))}).drop("_line", *[f"_p{i}" for i in range(len(phrases))])


def block_length(templates) -> int:
    return max([BLOCK_WORDS, *(2 * len(name.split()) for _, name in templates)])


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, block_words: int | None = None, phrases=PHRASES) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; and the matching blocks:
    doc_id, block_start, label, template, containment. Blocks of ``block_words`` must be twice as long as the longest template; unset, they are as ``block_length`` says."""
    block_words = block_length(templates) if block_words is None else block_words
    if block_words < 2 or block_words // 2 < max((len(name.split()) for _, name in templates), default=0):
        raise ValueError(f"blocks of {block_words} words are too short for the templates")
    sets = [(label, name, sorted(set(name.split()))) for label, name in templates]
    need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for _, _, s in sets]
    vocabulary = sorted({w for _, _, s in sets for w in s})
    spark, text = docs.sparkSession, words(F.col("text"))
    # one row per template word at most comes back
    held = docs.select(F.explode(F.array_intersect(text, _strings(vocabulary))).alias("w")).groupBy("w").count()
    frequency = {r.w: r["count"] for r in held.collect()}
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for k, ((label, name, s), a) in enumerate(zip(sets, need, strict=True)):
        ranked = sorted(s, key=rank.get)
        index += [(w, k, j, len(s), a, label, name, ranked) for j, w in enumerate(ranked[: len(s) - a + 1])]
    rare = sorted({row[0] for row in index}, key=rank.get)
    index = spark.createDataFrame(index, "w string, template_no int, j int, t_size int, need int, label string, template string, t_words array<string>")

    step, least = block_words // 2, min(need)
    n_blocks = F.greatest(F.lit(1), F.ceil((F.size("_words") - block_words) / F.lit(float(step))) + 1).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.struct((b * step).cast("long").alias("block_start"), F.array_intersect(_strings(order), F.slice("_words", b * step + 1, F.lit(block_words))).alias("b_words")))
    blocks = F.filter(blocks, lambda b: F.size(b["b_words"]) >= least)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_tie"), text.alias("_words"))
    rows = base_places(rows, phrases).withColumn("_blocks", F.when(F.arrays_overlap("_words", _strings(rare)), blocks))
    rows = written(rows.drop("_words"), "license-rows")
    # equal rows have equal blocks, so the join works on one of them
    each = rows.filter(F.size("_blocks") > 0).dropDuplicates(["doc_id", "_tie"]).select("doc_id", "_tie", F.explode("_blocks").alias("b")).select("doc_id", "_tie", "b.*")
    each = each.withColumn("b_size", F.size("b_words"))
    prefix = each.select("*", F.posexplode(F.slice("b_words", F.lit(1), F.col("b_size") - least + 1)).alias("i", "w"))
    pairs = prefix.join(F.broadcast(index), "w")  # as many rows as the templates' prefixes have words
    pairs = pairs.filter((F.col("b_size") >= F.col("need")) & (F.least(F.col("b_size") - F.col("i"), F.col("t_size") - F.col("j")) >= F.col("need")))
    shared = F.size(F.array_intersect("t_words", "b_words"))
    matches = pairs.withColumn("_shared", shared).filter(F.col("_shared") >= F.col("need")).select("doc_id", "_tie", "block_start", "label", "template", (F.col("_shared") / F.col("t_size")).alias("containment")).distinct()
    summed = matches.groupBy(F.col("doc_id").alias("_id"), F.col("_tie").alias("_hash")).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    joined = rows.join(summed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_hash")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_more", _strings([]))))
    score = F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    result = joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
    return result, matches.drop("_tie")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: scans all ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


def _base_sql(i: int, phrase: str) -> str:
    mark = " " + "  ".join(phrase.split()) + " "
    return f"case when contains(line_, '{mark}') then string_split(line_, '{mark}') end as p{i}"


_COUNT = "((length({0}) - length(replace({0}, ' ', ''))) // 2)"
_N = len(PHRASES)
ORACLE_SQL = f"""
with tpl(label, t_words) as (values {", ".join(f"('{label}', list_distinct(string_split('{name}', ' ')))" for label, name in TEMPLATES)}),
w as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') as ws from documents),
l as (select *, ' ' || coalesce(array_to_string(ws, '  '), '') || ' ' as line_ from w),
p as (select *, {", ".join(_base_sql(i, p) for i, (p, _) in enumerate(PHRASES))} from l),
b as (select r, unnest(range(0, greatest(1, ceil((len(ws) - {BLOCK_WORDS}) / {BLOCK_WORDS / 2}) + 1)::bigint)) as k, ws from w),
s as (select r, ws[k * {BLOCK_WORDS // 2} + 1 : k * {BLOCK_WORDS // 2} + {BLOCK_WORDS}] as bw from b),
c as (select r, label, len(list_intersect(t_words, bw))::double / len(t_words) as share, len(list_intersect(t_words, bw)) >= ceil({THRESHOLD} * len(t_words) - 1e-9) as found from s, tpl),
m as (select r, list(distinct label) as more, max(share) as best from c where found group by r),
o as (select doc_id, len(ws)::bigint as n_words, ({" + ".join(f"coalesce(len(p{i}) - 1, 0)" for i in range(_N))})::bigint as n_base,
  least({", ".join(_COUNT.format(f"p{i}[1]") for i in range(_N))})::bigint as first_word,
  greatest({", ".join(f"len(ws) - {_COUNT.format(f'p{i}[-1]')} - {len(p.split())}" for i, (p, _) in enumerate(PHRASES))})::bigint as last_word,
  list_sort(list_distinct(list_filter([{", ".join(f"case when p{i} is not null then '{label}' end" for i, (_, label) in enumerate(PHRASES))}], lambda x: x is not null))) as base_, coalesce(more, []) as more, best
  from p left join m using (r))
select doc_id, n_words, n_base, first_word, last_word, coalesce(array_to_string(base_, ','), '') as base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base_, more))), ','), '') as labels,
  case when len(base_) > 0 then 1.0::double else coalesce(best, 0.0::double) end as score from o"""
