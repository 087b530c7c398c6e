"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame functions only.

Words of all documents are shared among the sources by weight, no source above ``max_repeat`` times its own size. The
targets become blocks of equal length, allocated to the sources by highest quotients; a source's blocks are allocated to
its shards in the same way, and each shard takes its quota from its documents in a seeded order. A block is an eighth of the
smallest positive target, of ``BLOCK_WORDS`` words at most and one at least, so that small sources come near their targets too.

Defined results: null text has size 0; null source is a source of its own, last in order; null ids keep their row; rows
are never merged, so repeated rows each have their share; documents of size 0 take 0; an empty table gives an empty one;
other columns of the input are ignored. Ties in a quotient go to the source first in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
MAX_REPEAT = 3
SHARD_BASE = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_key(doc_id: Column, seed: str) -> Column:
    """60 bits of md5 of the seed and the id."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8")), 1, 15), 16, 10).cast("long")


def sainte_lague(df: DataFrame, keys: list[str], value: str, seats: str, order: list[str]) -> DataFrame:
    """Adds ``won``: the seats that each row of a key group wins of the group's ``seats``, by highest quotients value/(2s+1).

    With n rows and S seats every divisor that deals out S seats lies between T/(S+n/2) and T/(S-n/2). So a row surely has
    the seats of the second, and only those up to the first are ranked: some 5n rows for n rows, however many seats.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n, total = F.count(F.lit(1)).over(group), F.sum(value).over(group)
    share = F.when(total > 0, F.col(value).cast("double") / total).otherwise(0.0)
    sized = df.withColumns({"_n": n, "_share": share}).withColumns({
        "_lo": F.greatest(F.lit(0), F.floor(F.col("_share") * (F.col(seats) - F.col("_n") / 2.0) + 0.5) - 1).cast("long"),
        "_hi": F.ceil(F.col("_share") * (F.col(seats) + F.col("_n") / 2.0) + 1.5).cast("long"),
    })
    sized = sized.withColumn("_open", F.col(seats) - F.sum("_lo").over(group))
    tried = sized.withColumn("_s", F.explode(F.sequence("_lo", F.greatest("_lo", "_hi"))))
    tried = tried.withColumn("_q", F.col(value).cast("double") / (2 * F.col("_s") + 1))
    ranked = tried.withColumn("_r", F.row_number().over(group.orderBy(F.desc("_q"), *order, "_s")))
    back = [c for c in df.columns]
    return ranked.groupBy(*back, "_lo").agg(F.count_if((F.col("_r") <= F.col("_open")) & (F.col("_q") > 0)).alias("_won")).withColumn("won", F.col("_lo") + F.col("_won")).drop("_lo", "_won")


def targets(sources: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``ord``, ``weight`` and ``target`` to one row per source (columns ``no_source``, ``src``, ``source_size``).

    In order of cap over weight, a source is at its cap as long as the level that the rest would get is not below it; the
    first level below the next cap over weight is the final one.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("ord") - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = Window.partitionBy(F.lit(0))
    s = sources.withColumn("ord", F.row_number().over(whole.orderBy("no_source", "src"))).withColumn("weight", w)
    s = s.withColumns({"cap": F.col("source_size") * max_repeat, "_total": F.sum("source_size").over(whole)}).withColumn("_ratio", F.col("cap").cast("double") / F.col("weight"))
    by = whole.orderBy("_ratio", "ord")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest))
    s = s.withColumn("_final", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "ord", "_level"))).over(whole)["_level"])
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("_final") * F.col("weight"), F.col("cap").cast("double")))).drop("_ratio", "_level", "_final", "cap")


def quotas(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, shard_base: int = SHARD_BASE, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and keys (doc_id, size, source_size, target, no_source, src, shard, _key); per shard shard_size and quota."""
    sized = written(docs.select("doc_id", *_source(), word_count(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), seed).alias("_key")), "mix-sizes")
    sources = targets(sized.groupBy(*KEY).agg(F.sum("size").alias("source_size")), weights, max_repeat)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy(F.lit(0)))
    sources = sources.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(least / 8))), F.lit(block_words)).cast("long"))
    sources = sources.withColumn("_seats", F.ceil(F.col("_total") / F.col("block").cast("double")).cast("long"))
    sources = sainte_lague(sources, [], "target", "_seats", ["ord"]).withColumnRenamed("won", "blocks")
    # about the square root of the words: neither a shard nor a source's list of shards becomes a long group
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / F.lit(float(shard_base))))).cast("long"))
    sources = written(sources.select(*KEY, "source_size", "target", "block", "blocks", "shards"), "mix-sources")
    placed = sized.join(sources, KEY).withColumn("shard", F.pmod("_key", "shards"))
    shards = placed.groupBy(*KEY, "shard", "shards", "block", "blocks").agg(F.sum("size").alias("shard_size"))
    won = sainte_lague(shards, KEY, "shard_size", "blocks", ["shard"])
    quota = F.least(F.col("won") * F.col("block"), F.col("shard_size") * max_repeat)
    passes = F.when(F.col("shard_size") > 0, F.floor(quota / F.col("shard_size"))).otherwise(0).cast("long")
    won = won.select(*KEY, "shard", "shards", passes.alias("passes"), (quota - passes * F.col("shard_size")).alias("rest"))
    return placed, written(won, "mix-quotas")


KEY = ["no_source", "src"]


def _source() -> list[Column]:
    return [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src")]


def _lined(placed: DataFrame, shards: DataFrame) -> DataFrame:
    """With the words that stand before each document in its shard's order."""
    own = Window.partitionBy(*KEY, "shard").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return placed.drop("shards").join(shards, [*KEY, "shard"]).withColumn("_from", F.sum("size").over(own) - F.col("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_from")))
    return _lined(*quotas(docs, **options)).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def materialised(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken whole, then once cut after the words that remain.

    Texts are not shuffled: a row of a shard's table says up to which place in the seeded order documents are taken. Rows that are
    alike at that place (same id and size) share what is left of the quota evenly.
    """
    placed, shards = quotas(docs, seed=seed, **options)
    place = F.struct("_key", F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size")
    lined = _lined(placed, shards).withColumn("_at", place)
    alike = lined.filter("size > 0").groupBy(*KEY, "shard", "_at", "rest").agg(F.min("_from").alias("_from"), F.count(F.lit(1)).alias("_n"))
    first = alike.filter(F.col("_from") + F.col("_n") * F.col("_at.size") > F.col("rest")).groupBy(*KEY, "shard").agg(F.min(F.struct("_at", "_from", "_n")).alias("_cut"))
    cuts = shards.join(first, [*KEY, "shard"], "left").select(*KEY, "shard", "shards", "passes", F.col("_cut._at").alias("_last"), F.floor((F.col("rest") - F.col("_cut._from")) / F.col("_cut._n")).cast("long").alias("_share"))
    cuts = written(cuts, "mix-cuts")
    sizes = cuts.groupBy(*KEY).agg(F.first("shards").alias("shards"))  # a row for each source
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], "doc_id", *_source(), word_count(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), seed).alias("_key"))
    rows = rows.join(sizes, KEY).withColumn("shard", F.pmod("_key", "shards")).drop("shards").join(cuts.drop("shards"), [*KEY, "shard"]).withColumn("_at", place)
    once = F.when(F.col("_last").isNull() | (F.col("_at") < F.col("_last")), F.col("size")).when(F.col("_at") == F.col("_last"), F.col("_share")).otherwise(0)
    rows = rows.withColumn("taken", F.col("passes") * F.col("size") + once)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    text = F.col(names[docs.columns.index("text")])
    # pieces of white space and one word; white space at the end belongs to no word
    pieces = F.filter(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), lambda w: w.rlike(r"[^\x20\x09-\x0D]"))
    cut = F.when(rest > 0, F.array(F.struct(F.array_join(F.slice(pieces, F.lit(1), rest), "").alias("t"), F.lit(True).alias("cut"))))
    copies = F.concat(F.array_repeat(F.struct(text.alias("t"), F.lit(False).alias("cut")), whole), F.coalesce(cut, F.array().cast("array<struct<t:string,cut:boolean>>")))
    rows = rows.withColumn("_copy", F.explode(copies))
    new = {"text": F.col("_copy.t")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_copy.cut"), F.length("_copy.t")).otherwise(F.col(names[docs.columns.index("n_chars")])).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the mix of all ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _seats_sql(name: str, source: str, keys: str, value: str, seats: str, order: str, cols: str) -> str:
    part = f"partition by {keys}" if keys else ""
    return f"""
{name}_0 as (select *, count(*) over ({part}) as n_, case when sum({value}) over ({part}) > 0 then {value}::double / sum({value}) over ({part}) else 0 end as share_ from {source}),
{name}_1 as (select *, greatest(0, floor(share_ * ({seats} - n_ / 2.0::double) + 0.5::double) - 1)::bigint as lo_, ceil(share_ * ({seats} + n_ / 2.0::double) + 1.5::double)::bigint as hi_ from {name}_0),
{name}_2 as (select *, {seats} - sum(lo_) over ({part}) as open_ from {name}_1),
{name}_3 as (select *, unnest(range(lo_, greatest(lo_, hi_) + 1)) as s_ from {name}_2),
{name}_4 as (select *, {value}::double / (2 * s_ + 1) as q_ from {name}_3),
{name}_5 as (select *, row_number() over ({part} order by q_ desc, {order}, s_) as r_ from {name}_4),
{name} as (select {cols}, (lo_ + count(*) filter (where r_ <= open_ and q_ > 0))::bigint as won from {name}_5 group by {cols}, lo_)"""


ORACLE_SQL = f"""
with sized as (
  select doc_id, source is null as no_source, coalesce(source, '') as src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key_
  from documents),
src_0 as (select no_source, src, sum(size)::bigint as source_size from sized group by 1, 2),
src_1 as (select *, row_number() over (order by no_source, src) as ord, sum(source_size) over () as total_ from src_0),
src_2 as (select *, [{", ".join(map(str, WEIGHTS))}][((ord - 1) % {len(WEIGHTS)}) + 1] as weight, source_size * {MAX_REPEAT} as cap from src_1),
src_3 as (select *, cap::double / weight as ratio from src_2),
src_4 as (select *, (total_ - coalesce(sum(cap) over (order by ratio, ord rows between unbounded preceding and 1 preceding), 0))::double
  / sum(weight) over (order by ratio, ord rows between current row and unbounded following) as level_ from src_3),
src_5 as (select *, (select level_ from src_4 where ratio > level_ order by ratio, ord limit 1) as final_ from src_4),
src_6 as (select *, least(cap::double, coalesce(final_ * weight, cap::double)) as target from src_5),
src_7 as (select *, coalesce(greatest(1, least({BLOCK_WORDS}, floor(min(target) filter (where target > 0) over () / 8))), {BLOCK_WORDS})::bigint as block from src_6),
src_8 as (select no_source, src, ord, source_size, target, block, ceil(total_ / block::double)::bigint as seats_ from src_7),
{_seats_sql("won_s", "src_8", "", "target", "seats_", "ord", "no_source, src, ord, source_size, target, block")},
placed as (select sized.*, source_size, target, block, won as blocks, (key_ % greatest(1, ceil(sqrt(source_size / {float(SHARD_BASE)}::double)))::bigint) as shard
  from sized join won_s using (no_source, src)),
sh_0 as (select no_source, src, shard, block, blocks, sum(size)::bigint as shard_size from placed group by 1, 2, 3, 4, 5),
{_seats_sql("won_h", "sh_0", "no_source, src", "shard_size", "blocks", "shard", "no_source, src, shard, shard_size, block")},
quotas as (select *, least(won * block, shard_size * {MAX_REPEAT}) as quota from won_h),
lined as (select placed.*, shard_size, quota, sum(size) over (partition by no_source, src, shard order by key_, doc_id nulls first, size rows unbounded preceding) - size as from_
  from placed join quotas using (no_source, src, shard))
select doc_id, size, source_size, target,
  (case when shard_size > 0 then quota // shard_size * size + greatest(0, least(size, quota % shard_size - from_)) else 0 end)::bigint as taken
from lined"""
