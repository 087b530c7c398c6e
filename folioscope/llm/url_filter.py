"""URL filter by the ratio of two character models; DataFrame functions only.

Rules decide the URLs they fit. Accepted and rejected URLs train a Markov model each: the estimate of a symbol after a
context of ``ORDER`` symbols is drawn towards that of the next shorter context, so it has the longest context that was seen.
A URL's score is the mean difference of the two log-likelihoods over its symbols, in thousandths of a nat; the threshold is
midway between the score that best parts the rules' own decisions (greatest difference of the two rates of URLs at or above it)
and the next lower one, on URLs that trained no model: those whose MD5 begins with one of ``HELD``. Where these or the others aren't of both verdicts, all decided URLs do both.

The model has 32 ** (ORDER + 1) cells whatever the input, which bounds what is sent to the driver and to the tasks.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is judged by its symbols (a null
or empty one scores 0); where the rules decide no URL, scores are 0 and the rest is blocked, as nothing speaks for it; where they
decide all one way, the other model is uniform and the threshold is the least score of a decided URL; repeated rows and null ids are kept; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rules as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 2
STRENGTH = 8
SYMBOLS = 32
#: First hexadecimal digits of the MD5 of decided URLs that set the threshold.
HELD = "012"
#: 26 letters, then a digit, slash, full stop, hyphen, other marks of a URL, anything else.
_FROM = "abcdefghijklmnopqrstuvwxyz0123456789/.-?&=#_%:+@~"
_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "[" * 10 + "\\]^" + "_" * 10
_OTHER = "[^a-z0-9/.?&=#_%:+@~-]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, start = text.split("/", 1)
        fits = ((h == own) | F.endswith(h, F.lit("." + own))) & F.startswith(p, F.lit("/" + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def grams(url: Column, order: int = ORDER) -> tuple[Column, Column]:
    """Codes of the symbols (to be named ``_codes``) and numbers of the runs of order + 1 codes, one for each symbol; before
    the first stand symbols of the last kind."""
    text = F.coalesce(F.regexp_replace(url, r"(?s)^.*?://", ""), F.lit(""))
    text = F.translate(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _OTHER, "`"), _FROM, _TO)
    codes = F.transform(F.split(F.concat(F.lit("`" * order), text), ""), lambda c: F.ascii(c) - 65)
    codes = F.filter(codes, lambda c: c >= 0)
    n = F.greatest(F.size("_codes") - order, F.lit(0))
    # slices side by side: a lambda that names the array of codes would make it anew for every symbol
    runs = F.slice("_codes", F.lit(1), n)
    for k in range(1, order + 1):
        runs = F.zip_with(runs, F.slice("_codes", F.lit(1 + k), n), lambda a, b: a * SYMBOLS + b)
    return codes, runs


def train(labelled: DataFrame, order: int = ORDER, strength: int = STRENGTH) -> DataFrame:
    """cell, weight: the difference of the two models' logarithms in millionths, for each cell with a context that was seen."""
    spark = labelled.sparkSession
    counts = labelled.select("verdict", F.explode("_grams").alias("cell")).groupBy("cell").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))
    cells = spark.range(SYMBOLS ** (order + 1)).withColumnRenamed("id", "cell").join(counts, "cell", "left").fillna(0, ["a", "r"])
    estimate = {c: F.lit(1.0 / SYMBOLS) for c in "ar"}
    for k in range(order + 1):
        size = SYMBOLS ** (k + 1)
        cells = cells.withColumns({"_run": F.col("cell") % size, "_context": F.floor(F.col("cell") % size / SYMBOLS)})
        run, context = Window.partitionBy("_run"), Window.partitionBy("_context")
        cells = cells.withColumns({f"_{c}{k}": F.sum(c).over(run) for c in "ar"} | {f"_{c}{k}c": F.sum(c).over(context) for c in "ar"})
        for c in "ar":
            estimate[c] = (F.col(f"_{c}{k}") + strength * estimate[c]) / (F.col(f"_{c}{k}c") + F.lit(float(strength)))
    return cells.select("cell", F.floor(F.log(estimate["a"] / estimate["r"]) * 1e6 + 0.5).cast("long").alias("weight"))


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, strength: int = STRENGTH) -> DataFrame:
    """page_id, host, path, rule, verdict, score (thousandths of a nat per symbol)."""
    rows = pages.select("page_id", F.col("url"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_ruled": verdict})
    codes, runs = grams(F.col("url"), order)
    rows = rows.withColumn("_codes", codes).withColumn("_grams", runs)
    ruled = rows.filter(F.col("_ruled").isNotNull()).withColumn("_held", F.substring(F.md5("url"), 1, 1).isin(list(HELD)))
    kinds = {(r[0], r[1]): r[2] for r in ruled.groupBy("_ruled", "_held").count().collect()}  # four rows at most
    if kinds:
        fitted = judged = ruled
        if len(kinds) == 4:
            fitted, judged = ruled.filter("not _held"), ruled.filter("_held")
        else:
            kinds = {(k, True): sum(n for (v, _), n in kinds.items() if v == k) for k in ("allow", "block")}
        weights = [0] * SYMBOLS ** (order + 1)
        for r in train(fitted.select(F.col("_ruled").alias("verdict"), "_grams"), order, strength).filter("weight <> 0").collect():  # at most 32 ** (order + 1) rows
            weights[r.cell] = r.weight
        table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<long>")
        total = F.aggregate("_grams", F.lit(0).cast("long"), lambda s, g: s + F.element_at(table, g + 1))
        n = F.greatest(F.size("_grams"), F.lit(1))
        score = F.floor(total / (n * F.lit(1000.0))).cast("long")
        bins = judged.withColumn("score", score).groupBy("score").agg(F.count_if(F.col("_ruled") == "allow").alias("a"), F.count_if(F.col("_ruled") == "block").alias("r"))
        above = Window.partitionBy(F.lit(0)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # one row per score
        gain = F.sum("a").over(above).cast("double") * kinds["block", True] - F.sum("r").over(above).cast("double") * kinds["allow", True]
        below = F.coalesce(F.lead("score").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))), F.col("score"))
        midway = F.floor((F.col("score") + below) / F.lit(2.0)).cast("long")
        threshold = F.lit(bins.select("score", gain.alias("gain"), midway.alias("midway")).orderBy(F.desc("gain"), "score").first().midway)
    else:
        score, threshold = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = rows.withColumn("score", score)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: judges every url of ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _rule_sql(what: int) -> str:
    out = []
    for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        own, start = rule[1].split("/", 1)
        out.append(f"when (host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '/{start}') then '{rule[what]}'")
    return "case " + " ".join(out) + " end"


def _estimate_sql(c: str) -> str:
    out = f"{1.0 / SYMBOLS}::double"
    for k in range(ORDER + 1):
        out = f"((sum({c}) over (partition by cell % {SYMBOLS ** (k + 1)}) + {STRENGTH} * {out}) / (sum({c}) over (partition by (cell % {SYMBOLS ** (k + 1)}) // {SYMBOLS}) + {float(STRENGTH)}::double))"
    return out


ORACLE_SQL = f"""
with a as (select row_number() over () as n_, page_id, md5(url)[1] in ({", ".join(f"'{d}'" for d in HELD)}) as held, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
  '{"`" * ORDER}' || translate(regexp_replace(translate(regexp_replace(coalesce(url, ''), '(?s)^.*?://', ''), '{_UPPER}', '{_LOWER}'), '{_OTHER}', '`', 'g'), '{_FROM}', '{_TO}') as t from pages),
b as (select *, {_rule_sql(1)} as rule, {_rule_sql(0)} as ruled,
  list_transform(range(1, length(t) - {ORDER} + 1), lambda i: {" + ".join(f"(ascii(t[i + {k}]) - 65) * {SYMBOLS ** (ORDER - k)}" for k in range(ORDER + 1))}) as grams from a),
e as (select count(distinct ruled) filter (where held) = 2 and count(distinct ruled) filter (where not held) = 2 as parted from b where ruled is not null),
g as (select ruled, unnest(grams) as cell from b, e where ruled is not null and not (parted and held)),
k as (select r.cell, count(*) filter (where ruled = 'allow')::double as a, count(*) filter (where ruled = 'block')::double as r from range({SYMBOLS ** (ORDER + 1)}) r(cell) left join g using (cell) group by 1),
w as (select cell, floor(ln({_estimate_sql("a")} / {_estimate_sql("r")}) * 1e6 + 0.5)::bigint as weight from k),
s as (select n_, sum(weight) as total from (select n_, unnest(grams) as cell from b) join w using (cell) group by 1),
c as (select b.*, floor(coalesce(total, 0)::double / (greatest(len(grams), 1) * 1000.0::double))::bigint as score from b left join s using (n_)),
j as (select c.* from c, e where ruled is not null and (held or not parted)),
h as (select score, count(*) filter (where ruled = 'allow') as a, count(*) filter (where ruled = 'block') as r from j group by 1),
t as (select score, sum(a) over (order by score desc)::double * (select count(*) from j where ruled = 'block') - sum(r) over (order by score desc)::double * (select count(*) from j where ruled = 'allow') as gain,
  floor((score + coalesce(lead(score) over (order by score desc), score)) / 2.0::double)::bigint as midway from h),
v as (select midway as threshold from t order by gain desc, score limit 1)
select page_id, host, path, rule, coalesce(ruled, case when score >= (select threshold from v) then 'allow' else 'block' end) as verdict, score from c"""
