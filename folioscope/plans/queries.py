"""Queries over the test tables, one or more per operator, and the same in DuckDB SQL where SQL can say it.

``lines`` is the line table of ``sources.lines.from_documents``; operators for which the tables hold nothing suitable work on
levels from ``lineitem``, numbers from ``events``, or on lines to which rules add numbers, references, contents pages and heads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import markup, text as T
from ..functions.lineage import cut
from ..operators import arbitrate, census, contents, detect, evaluate, layout, locate, model, ranks, tree
from ..operators import predicates as P
from ..sources import archive, lines as L
from . import outline

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_lines(spark, sf_dir: str) -> DataFrame:
    return L.from_documents(table(spark, sf_dir, "documents"))


# ---- the line table in SQL
LINES = """
pg_ as (select case when source is null then -1 else ('0x' || substr(md5(source), 1, 15))::bigint end as doc_id, (dense_rank() over (partition by source order by doc_id) - 1)::int as page_index, coalesce(doc_id, 0) as n, string_split(text, chr(10)) as ls
  from documents where text is not null),
ln_ as (select doc_id, page_index, n, unnest(ls) as text, (generate_subscripts(ls, 1) - 1)::int as line_idx from pg_),
lines as (select *, (780 - 7 * line_idx)::double as y, case (n * 7 + line_idx * 13) % 11 when 0 then 18.0::double when 1 then 14.0::double when 2 then 12.0::double else 10.0::double end as size,
  case when (n * 7 + line_idx * 13) % 11 <= 1 then 'bold' else 'body' end as font from ln_)"""


def sql_norm(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({t}), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}} ]', '', 'g'))"


def sql_folios(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({t}, '[0-9]+', ' ', 'g'), '\\b[ivxlcdm]{{1,7}}\\b', ' ', 'g'), ' +', ' ', 'g'))"


def sql_plain(t: str) -> str:
    return f"trim(regexp_replace(translate(strip_accents(lower({t})), '’‘', ''''''), '[^a-z0-9'']+', ' ', 'g'))"


def sql_letters(t: str) -> str:
    return f"len(regexp_extract_all({t}, '\\p{{L}}'))"


def sql_words(t: str) -> str:
    return f"len(regexp_split_to_array({t}, '\\s+'))"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def matches(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {quoted(pattern)})"


KEY = T.LEADING_NUMBER.replace("'", "''")


# ---- books made from the line table, in which contents pages, index pages and running heads occur
HEAD = "Annals of the society"
MADE_LINES = LINES.replace("lines as (", "tables_ as (") + rf""", lines as (select doc_id, page_index, n, line_idx, y, size, font, case when page_index % 25 = 0 and line_idx = 0 then 'Contents'
  when page_index % 25 = 0 then regexp_replace(text, '[^\p{{L}} ]', '', 'g') || ' .... ' || (page_index + line_idx + 2) when page_index % 25 = 24 then regexp_replace(text, '[^\p{{L}} ]', '', 'g') || ', ' || (line_idx + 1) || ', ' || (line_idx + 9)
  when line_idx = 0 and page_index % 2 = 1 then '{HEAD}' else text end as text from tables_)"""


def made_lines(spark, sf_dir: str) -> DataFrame:
    """The line table with every 25th page of a book as a contents page of the words on it, the one before that as a page of an index, and a
    running head on odd pages."""
    p, i = F.col("page_index"), F.col("line_idx")
    words = F.regexp_replace("text", r"[^\p{L} ]", "")
    number = lambda n: n.cast("string")
    text = (
        F.when((p % 25 == 0) & (i == 0), "Contents").when(p % 25 == 0, F.concat(words, F.lit(" .... "), number(p + i + 2)))
        .when(p % 25 == 24, F.concat(words, F.lit(", "), number(i + 1), F.lit(", "), number(i + 9))).when((i == 0) & (p % 2 == 1), HEAD).otherwise(F.col("text"))
    )
    return book_lines(spark, sf_dir).withColumn("text", text)


# ---- recurrence and styles
@query(f"with {LINES}, k as (select distinct doc_id, page_index, {sql_norm('text')} as key from lines) select doc_id, key, count(*) as pages from k where length(key) >= 4 group by 1, 2 having count(*) >= 3")
def repeated_lines(spark, sf_dir):
    return census.repeated_lines(book_lines(spark, sf_dir))


@query(f"""with {LINES}, k as (select doc_id, page_index, {sql_folios(sql_norm('text'))} as key, (1 - y / 792.0::double <= 0.18 or 1 - y / 792.0::double >= 0.82) as edge from lines),
s as (select doc_id, key, page_index, max(edge) as edge from k where length(key) >= 3 group by 1, 2, 3), p as (select doc_id, count(distinct page_index) as pages from lines group by 1),
c as (select doc_id, key, count(*) filter (where edge) as edges, count(*) as n from s group by 1, 2)
select doc_id, key from c join p using (doc_id) where edges >= greatest(3, ceil(pages * 0.05)) or n >= greatest(4, ceil(pages * 0.08))""")
def running_heads(spark, sf_dir):
    return census.running_heads(book_lines(spark, sf_dir), share=0.05, anywhere_share=0.08)


HEADS = f"""hk as (select doc_id, page_index, {sql_folios(sql_norm('text'))} as key, (1 - y / 792.0::double <= 0.18 or 1 - y / 792.0::double >= 0.82) as edge from lines),
hs as (select doc_id, key, page_index, max(edge) as edge from hk where length(key) >= 3 group by 1, 2, 3), hp as (select doc_id, count(distinct page_index) as pages from lines group by 1),
hc as (select doc_id, key, count(*) filter (where edge) as edges, count(*) as n from hs group by 1, 2),
heads as (select doc_id, key from hc join hp using (doc_id) where edges >= greatest(3, ceil(pages * 0.3)) or n >= greatest(4, ceil(pages * 0.5)))"""


@query(f"with {MADE_LINES}, {HEADS} select doc_id, key from heads")
def running_heads_of_books(spark, sf_dir):
    """At the usual shares."""
    return census.running_heads(made_lines(spark, sf_dir))


STYLES = f"""{LINES}, st as (select doc_id, font, floor(size * 10 + 0.5) / 10 as size, sum(length(text)) as chars, count(*) as n, min(page_index * 1000000 + line_idx) as first from lines group by 1, 2, 3),
bd as (select *, row_number() over (partition by doc_id order by chars desc, first) as r, sum(chars) over (partition by doc_id) as total_chars from st),
fo as (select doc_id, font, sum(chars) as chars, sum(n) as n from st group by 1, 2),
bf as (select b.doc_id, b.font as body_font, b.size as body_size, total_chars, f.chars as body_chars from bd b join fo f on f.doc_id = b.doc_id and f.font = b.font where r = 1),
cs as (select doc_id, body_font, body_size, total_chars::bigint as total_chars, coalesce((select list(font order by font) from fo where fo.doc_id = bf.doc_id and font <> body_font and chars < body_chars * 0.2 and n >= 2 and chars / n < 100), []) as heading_fonts from bf)"""


@query(f"with {STYLES} select doc_id, body_font, body_size, total_chars, array_to_string(heading_fonts, ',') as heading_fonts from cs")
def style_census(spark, sf_dir):
    return census.style_census(book_lines(spark, sf_dir)).withColumn("heading_fonts", F.array_join("heading_fonts", ","))


@query(f"""with {MADE_LINES}, c as (select doc_id, page_index, count(*) filter (where length(text) > 4) as n, count(*) filter (where length(text) > 4 and {matches('text', P.TOC_LINE)}) as refs, max({matches('trim(text)', P.TOC_TITLE)}) as titled from lines group by 1, 2)
select doc_id, page_index from c where titled or (n >= 4 and refs >= greatest(3, n * 0.3))""")
def toc_pages(spark, sf_dir):
    return census.toc_pages(made_lines(spark, sf_dir))


INDEX = " or ".join([r"regexp_matches(text, '[0-9]+\s*[,;]\s*[0-9]+')", r"regexp_matches(text, '[0-9]+\s*[\x{2013}\x{2014}-]\s*[0-9]+\s*(?:[,;]|$)')", r"regexp_matches(text, '(?i),\s*(?:[0-9]+|[ivxlcdm]+)\s*$')", r"regexp_matches(text, '(?i)^\s*(?:see|voir)\b')"])


@query(f"with {MADE_LINES}, c as (select doc_id, page_index, count(*) filter (where {INDEX}) as signs, count(*) as n from lines where length(text) > 3 group by 1, 2) select doc_id, page_index, signs, n from c where signs >= 1")
def index_signs(spark, sf_dir):
    rows = made_lines(spark, sf_dir).filter(F.length("text") > 3)
    return rows.groupBy("doc_id", "page_index").agg(F.count_if(P.is_index_sign(F.col("text"))).alias("signs"), F.count(F.lit(1)).alias("n")).filter("signs >= 1")


@query(f"""with {LINES}, b as (select doc_id, page_index, line_idx, text, floor(unnest(range(18, 18 + greatest(1, ceil((72 + length(text) * 5) / 4.0)::int - 18)))) as bin from lines)
select bin::int as bin, count(*) as n from b group by 1""")
def bin_occupancy(spark, sf_dir):
    rows = book_lines(spark, sf_dir).withColumns({"frag_idx": F.col("line_idx"), "width": F.col("x_end") - F.col("x")})
    return census.bin_occupancy(rows, []).select("bin", "n")


# ---- predicates and scores
REJECT = f"""coalesce(length(text) < 2 or length(text) > 200 or {sql_letters('text')} < 2 or {sql_letters('text')} / nullif(length(text), 0)::double < 0.35 or {sql_words('text')} > 18 or {matches('text', P.BOILERPLATE)}
  or (regexp_matches(text, '@\\S+\\.\\S+') and length(text) < 60) or {matches('text', P.FOLIO)} or {matches('text', P.CAPTION)}, true)"""
PROSE = f"((regexp_matches(text, '[.;:!?]$') and length(text) > 90) or {sql_words('text')} > 14)"


@query(f"with {LINES} select doc_id, page_index, line_idx, {REJECT} as rejected, {PROSE} as prose, {matches('text', P.KEYWORDS)} as keyword from lines")
def line_predicates(spark, sf_dir):
    t = F.col("text")
    return book_lines(spark, sf_dir).select("doc_id", "page_index", "line_idx", P.is_rejected(t).alias("rejected"), P.is_prose(t).alias("prose"), P.is_keyword(t).alias("keyword"))


NUM = r"^([0-9]+(?:[.\-][0-9]+)*)[.)]?(?:\s+|$)"
NUMBERED = f"""case when regexp_matches(text, '{NUM}') then
  (case when not (len(string_split(replace(regexp_extract(text, '{NUM}', 1), '-', '.'), '.')) = 1 and length(regexp_extract(text, '{NUM}', 1)) = 4 and try_cast(regexp_extract(text, '{NUM}', 1) as bigint) > 1500)
    and len(string_split(replace(regexp_extract(text, '{NUM}', 1), '-', '.'), '.')) <= 6 and {sql_letters(f"regexp_replace(text, '{NUM}', '')")} >= 2 then 'num' end)
  when regexp_matches(text, '^[IVXLCDM]{{1,7}}[.)]\\s+\\S') then 'roman' when regexp_matches(text, '^[A-Z][.)]\\s+\\S') then 'letter' end"""
SCORE = f"""
  case when size / body_size >= 1.6 then 5 when size / body_size >= 1.3 then 4 when size / body_size >= 1.15 then 3 when size / body_size >= 1.06 then 2 when size / body_size >= 0.97 then 0 else -3 end
  + case when list_contains(heading_fonts, font) then 2 when font <> body_font then 0.5 else 0 end + case when ({NUMBERED}) is not null then 2.5 else 0 end
  + case when {matches('text', P.KEYWORDS)} then 2 else 0 end + case when text = upper(text) and {sql_letters('text')} > 3 and length(text) < 80 then 1 else 0 end
  + case when gap_above > size * 1.6 then 1 else 0 end + case when length(text) < 70 then 0.5 else 0 end + case when {PROSE} then -3 else 0 end
  + case when regexp_matches(text, '[,;]$') then -2 else 0 end + case when regexp_matches(text, '^[a-zà-öø-ÿ]') and ({NUMBERED}) is null then -1.5 else 0 end"""
SCORED = f"{STYLES}, gp as (select *, coalesce(lag(y) over (partition by doc_id, page_index order by line_idx) - y, 999.0::double) as gap_above from lines), sc as (select gp.*, ({SCORE})::double as score from gp join cs using (doc_id))"


@query(f"with {SCORED} select doc_id, page_index, line_idx, gap_above, score from sc")
def heading_scores(spark, sf_dir):
    rows = book_lines(spark, sf_dir)
    return detect.score_lines(rows, census.style_census(rows)).select("doc_id", "page_index", "line_idx", "gap_above", "score")


#: What the lines are marked with, in turn: numbers before them, references behind them, or nothing.
BEFORE = ["", "1 ", "1.2.3 ", "2024 ", "1.2.3.4.5.6.7 ", "IV. ", "B) ", "", "", "", "", "", "", "", ""]
BEHIND = ["", "", "", "", "", "", "", " ..... 12", " / ix", " 1999", " ... 1999", "\t45", " xii", " XII", " | 120"]
MARKED = f"""{LINES}, mk as (select doc_id, page_index, line_idx, text, ((n + line_idx * 3) % {len(BEFORE)})::int as m from lines),
v as (select doc_id, page_index, line_idx, [{', '.join(f"'{t}'" for t in BEFORE)}][m + 1] || text || [{', '.join("'" + t.replace(chr(9), "' || chr(9) || '") + "'" for t in BEHIND)}][m + 1] as text from mk)"""


def marked_lines(spark, sf_dir) -> DataFrame:
    turn = F.pmod(F.col("n") + F.col("line_idx") * 3, F.lit(len(BEFORE))).cast("int")
    pick = lambda marks: F.get(F.array(*map(F.lit, marks)), turn)
    documents = table(spark, sf_dir, "documents").filter("text is not null")
    numbered = documents.select(L.book_number(F.col("source")).alias("book"), F.col("doc_id").alias("n")).join(L.page_numbers(documents), ["book", "n"])
    rows = book_lines(spark, sf_dir).join(numbered.select(F.col("book").alias("doc_id"), "page_index", "n").distinct(), ["doc_id", "page_index"])
    return rows.select("doc_id", "page_index", "line_idx", F.concat(pick(BEFORE), "text", pick(BEHIND)).alias("text"))


@query(f"with {MARKED} select doc_id, page_index, line_idx, {NUMBERED} as kind from v")
def numbering_kinds(spark, sf_dir):
    return marked_lines(spark, sf_dir).select("doc_id", "page_index", "line_idx", P.numbering(F.col("text"))["kind"].alias("kind"))


def sql_roman(t: str) -> str:
    digit = lambda c: f"case {c} when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 when 'c' then 100 when 'd' then 500 when 'm' then 1000 else 0 end"
    low = f"lower({t})"
    return f"list_sum(list_transform(range(1, length({t}) + 1), lambda p: ({digit(f'substr({low}, p, 1)')}) * (case when ({digit(f'substr({low}, p, 1)')}) < ({digit(f'substr({low}, p + 1, 1)')}) then -1 else 1 end)))"


PAGE_PATTERN = r"(?i)^(.*?\S)[\s.·…_]*\s([0-9]{1,4}|[ivxlcdm]{1,7})$"


@query(rf"""with {MARKED}, m as (select doc_id, page_index, line_idx, text, regexp_extract(trim(text), '{PAGE_PATTERN}', 2) as num, trim(regexp_replace(regexp_extract(trim(text), '{PAGE_PATTERN}', 1), '[\s.·…_/|:–—-]+$', '')) as title from v),
n as (select *, regexp_matches(num, '^[0-9]+$') as arabic, case when regexp_matches(num, '^[0-9]+$') then num::int else {sql_roman('num')} end as value from m where num <> '')
select doc_id, page_index, line_idx, title, value::int as printed, not arabic as roman from n where regexp_matches(title, '\p{{L}}') and not (arabic and length(num) = 4 and value > 1400 and value < 2200 and not regexp_matches(text, '\.{{3,}}')) and (arabic or value > 0)""")
def split_page(spark, sf_dir):
    return marked_lines(spark, sf_dir).select("doc_id", "page_index", "line_idx", P.split_page(F.col("text")).alias("s")).filter("s is not null").select("doc_id", "page_index", "line_idx", "s.*")


TRAILING_PATTERN = r"(?i)^(.*?\S)(\s*(?:\.{2,}|…+|[·_]{2,}|\t+|\s{2,}|\s*[/|]\s*)\s*|\s+)([0-9]{1,4}|[ivxlcdm]{1,7})\s*$"


@query(rf"""with {MARKED}, m as (select doc_id, page_index, line_idx, text, regexp_extract(text, '{TRAILING_PATTERN}', 3) as num, regexp_extract(text, '{TRAILING_PATTERN}', 2) as sep, trim(regexp_replace(regexp_extract(text, '{TRAILING_PATTERN}', 1), '[\s.·…_/|:,;–—-]+$', '')) as title from v),
n as (select *, regexp_matches(num, '^[0-9]+$') as arabic, regexp_matches(sep, '\.{{2,}}|…|[·_]{{2,}}|\t|\s{{2,}}|[/|]') as strong, case when regexp_matches(num, '^[0-9]+$') then num::int else {sql_roman('num')} end as value from m where num <> '')
select doc_id, page_index, line_idx, title, value::int as printed, not arabic as roman from n where regexp_matches(title, '\p{{L}}') and not {matches('title', P.BARE)}
  and (strong or case when arabic then not (length(num) = 4 and value > 1400 and value < 2200) else num = lower(num) and length(num) <= 4 end) and (arabic or value > 0)""")
def split_trailing(spark, sf_dir):
    return marked_lines(spark, sf_dir).select("doc_id", "page_index", "line_idx", P.split_trailing(F.col("text")).alias("s")).filter("s is not null").select("doc_id", "page_index", "line_idx", "s.*")


@query("select distinct l_orderkey % 3999 + 1 as n, (l_orderkey % 3999 + 1)::int as back from lineitem")
def roman_round_trip(spark, sf_dir):
    n = (F.col("l_orderkey") % 3999 + 1).alias("n")
    rows = table(spark, sf_dir, "lineitem").select(n).distinct()
    return rows.withColumn("back", T.roman_to_int(T.int_to_roman(F.col("n"))).cast("int"))


@query(f"with {LINES} select doc_id, page_index, line_idx, {sql_norm('text')} as norm, {sql_folios(sql_norm('text'))} as running, {sql_plain(f'''regexp_replace(text, '{KEY}', '')''')} as title from lines")
def text_keys(spark, sf_dir):
    t = F.col("text")
    return book_lines(spark, sf_dir).select("doc_id", "page_index", "line_idx", T.norm_key(t).alias("norm"), T.running_key(t).alias("running"), T.title_key(t).alias("title"))


# ---- levels and trees
LEVELS = """lv as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)::int as seq, least(6, l_linenumber)::int as level from lineitem)"""


def level_rows(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))
    return rows.select(F.col("l_orderkey").alias("doc_id"), "n", F.least(F.lit(6), "l_linenumber").alias("level"))


@query(f"""with {LEVELS}, d as (select *, (seq + least(0, min(level - seq) over (partition by doc_id order by seq)))::int as depth from lv)
select doc_id, seq, level, depth, (select max(seq) from d p where p.doc_id = d.doc_id and p.seq < d.seq and p.depth = d.depth - 1) as parent_seq from d""")
def outline_tree(spark, sf_dir):
    return tree.tree(level_rows(spark, sf_dir), ["n"]).select("doc_id", "seq", "level", "depth", "parent_seq")


@query(f"with {LEVELS} select doc_id, seq as n, (level - min(level) over (partition by doc_id) + 1)::int as rebased, dense_rank() over (partition by doc_id order by level)::int as dense from lv")
def level_shifts(spark, sf_dir):
    rows = level_rows(spark, sf_dir).withColumns({"rebased": F.col("level"), "dense": F.col("level")})
    return tree.densify_levels(tree.rebase_levels(rows, level="rebased"), level="dense").select("doc_id", "n", "rebased", "dense")


@query(f"""with {LEVELS}, b as (select doc_id % 7 as doc_id, level, count(*) as n from lv group by 1, 2), p as (select doc_id, (sum(n) / 2)::bigint as pages from (select doc_id, floor(sum(n) / 1.0) as n from b group by 1) group by 1),
c as (select b.*, greatest(12, floor(pages * 1.2 + 0.5)) as cap, sum(n) over (partition by doc_id order by level) as upto from b join p using (doc_id)),
l as (select doc_id, greatest(1, coalesce(max(case when upto <= cap then level end), 1)) as deepest from c group by 1)
select doc_id, level, n from b join l using (doc_id) where level <= deepest""")
def prune_levels(spark, sf_dir):
    rows = level_rows(spark, sf_dir).withColumn("doc_id", F.col("doc_id") % 7)
    pages = rows.groupBy("doc_id").agg(F.round(F.count(F.lit(1)) / 2).cast("long").alias("pages"))
    return tree.prune_levels(rows, pages).groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select distinct user_id as doc_id, floor(epoch(ts) / 3600)::bigint as page_index from events), g as (select *, case when page_index - lag(page_index) over (partition by doc_id order by page_index) <= 24 then 0 else 1 end as s from e)
select doc_id, page_index, sum(s) over (partition by doc_id order by page_index)::int as block from g""")
def page_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.floor(F.unix_timestamp("ts") / 3600).alias("page_index")).distinct()
    return tree.blocks(rows, step=24)


@query(f"with {SCORED}, r as (select *, row_number() over (partition by doc_id order by score desc, page_index, line_idx) as r from sc) select doc_id, page_index, line_idx, score from r where r <= 40")
def top_pool(spark, sf_dir):
    rows = book_lines(spark, sf_dir)
    best = tree.top_per_group(detect.score_lines(rows, census.style_census(rows)), ["doc_id"], [F.desc("score"), "page_index", "line_idx"], 40)
    return best.select("doc_id", "page_index", "line_idx", "score")


@query(f"""with {SCORED}, r as (select *, row_number() over (partition by doc_id order by score desc, page_index, line_idx) as r from sc)
select doc_id, (row_number() over (partition by doc_id order by page_index, y desc, line_idx))::int as i, page_index, floor(y + size + 0.5)::int as y, size, text, score from r where r <= 350""")
def heading_pool(spark, sf_dir):
    """The usual number of lines for a model, in document order."""
    rows = book_lines(spark, sf_dir)
    return detect.cap_pool(detect.score_lines(rows, census.style_census(rows)))


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) as r from documents) where (r - 1) % 7 = 0")
def systematic_sample(spark, sf_dir):
    return tree.systematic_sample(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 7)


@query("with n as (select l_suppkey as doc_id, l_returnflag as style, l_linenumber as level, count(*) as n from lineitem group by 1, 2, 3) select doc_id, style, level from (select *, row_number() over (partition by doc_id, style order by n desc, level) as r from n) where r = 1")
def style_votes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("style"), F.col("l_linenumber").alias("level"))
    return tree.style_votes(rows)


@query("select l_suppkey as doc_id, list_sort(list(l_quantity))[(count(*) // 2 + 1)::int] as median from lineitem group by 1")
def upper_median(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "doc_id")
    return ranks.upper_medians(rows, ["doc_id"], F.col("l_quantity"))


# ---- markup
@query("""with h as (select page_id as doc_id, unnest(regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]\\s*>')) as tag from pages) select doc_id, substr(tag, 3, 1)::int as level, count(*) as n from h group by 1, 2""")
def html_heading_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("pos"), F.lit("").alias("path"), F.col("html").alias("text"))
    return archive.headings(rows, rebase=False).groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query(r"""with t as (select page_id as doc_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>') as tags from pages), u as (select doc_id, unnest(tags) as tag, (generate_subscripts(tags, 1) - 1)::int as h_pos from t),
v as (select doc_id, h_pos, substr(tag, 3, 1)::int as level, nullif(regexp_extract(tag, '(?is)^<h[1-6]\b[^>]*?\bid\s*=\s*"([^"]*)', 1), '') as anchor, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as text from u),
w as (select doc_id, h_pos, level, anchor, trim(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) as text from v)
select doc_id, 0 as spine_pos, h_pos, (level - min(level) over (partition by doc_id) + 1)::int as level, text, '' as path, anchor from w where text <> '' and length(text) <= 300""")
def html_headings(spark, sf_dir):
    return archive.pages_headings(table(spark, sf_dir, "pages"))


@query("""select page_id, len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref'))::bigint as links, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as text,
  replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as url from pages""")
def html_text(spark, sf_dir):
    links = F.regexp_count("html", F.lit(r"(?i)<a\b[^>]*\bhref")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", links.alias("links"), markup.strip_tags(F.col("html")).alias("text"), markup.escape_xml(F.col("url")).alias("url"))


@query("""with p as (select page_id, html, regexp_extract(html, '(?is)<nav\\b[^>]*toc[^>]*>(.*?)</nav\\s*>', 1) as nav from pages) select page_id, len(regexp_extract_all(case when nav <> '' then nav else html end, '(?i)<a\\b[^>]*\\bhref'))::bigint as n from p""")
def html_toc_count(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", archive.toc_count(F.col("html")).alias("n"))


# ---- locating titles
def book_entries(spark, sf_dir) -> DataFrame:
    """A contents list for every book: how the first line of each page begins, with a printed page that is off by the book's front matter; and
    the benchmark texts, each in the book of the document that has its number."""
    rows = book_lines(spark, sf_dir)
    front = rows.groupBy("doc_id").agg((F.countDistinct("page_index") % 7).alias("front"))
    page = (F.col("page_index") + 1 - F.col("front")).cast("int")
    pages = rows.filter("line_idx = 0").join(front, "doc_id").select("doc_id", F.col("page_index").alias("entry_idx"), F.trim(F.regexp_extract("text", "^[^.!?]*", 0)).alias("title"), F.when(page > 0, page).alias("printed"))
    documents = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", L.book_number(F.col("source")).alias("book"))
    items = table(spark, sf_dir, "benchmark").join(documents, F.col("item_id") == F.col("doc_id")).select(F.col("book").alias("doc_id"), (F.col("item_id") + 1_000_000).cast("int").alias("entry_idx"), F.col("text").alias("title"), (F.col("item_id") % 40 + 1).cast("int").alias("printed"))
    return pages.unionByName(items).select("doc_id", "entry_idx", "title", F.lit(1).alias("level"), "printed", F.lit(False).alias("roman"))


def title_index(spark, sf_dir) -> DataFrame:
    rows = cut(made_lines(spark, sf_dir).select("doc_id", "page_index", "line_idx", "text", "y", "size", "font", "height"))
    return cut(locate.line_index(rows, census.running_heads(rows)).select("doc_id", "page_index", "line_idx", "part", "k", "size", "running"))


SIM = f"""{MADE_LINES}, {HEADS}, nx as (select *, lead(text) over w as t2, lead(size) over w as s2 from lines window w as (partition by doc_id, page_index order by line_idx)),
ix as (select doc_id, page_index, line_idx, 0 as part, text, size, y from nx where length(text) >= 2 union all select doc_id, page_index, line_idx, 1, text || ' ' || t2, size, y from nx where length(text) >= 2 and t2 <> '' and abs(s2 - size) / greatest(s2, size) < 0.2 and length(text) + length(t2) < 200),
ik as (select *, {sql_plain(f"regexp_replace(text, '{KEY}', '')")} as k from ix), it as (select *, list_filter(string_split(k, ' '), lambda w: length(w) > 2) as toks from ik where k <> ''),
fr as (select doc_id, count(distinct page_index) % 7 as front from tables_ group by 1),
en as (select t.doc_id, page_index as entry_idx, trim(regexp_extract(text, '^[^.!?]*', 0)) as title, case when page_index + 1 - front > 0 then (page_index + 1 - front)::int end as printed from tables_ t join fr using (doc_id) where line_idx = 0
  union all select case when source is null then -1 else ('0x' || substr(md5(source), 1, 15))::bigint end, (item_id + 1000000)::int, b.text, (item_id % 40 + 1)::int from benchmark b join documents d on d.doc_id = b.item_id where d.text is not null),
ek as (select *, {sql_plain(f"regexp_replace(title, '{KEY}', '')")} as e_k from en), et as (select *, list_filter(string_split(e_k, ' '), lambda w: length(w) > 2) as e_toks from ek where e_k <> ''),
pr as (select et.*, it.page_index, it.line_idx, it.part, it.text as raw, it.k, it.toks, it.size, it.y from et join it using (doc_id)),
ps as (select *, case when e_k = k then 1.0 when starts_with(k, e_k) and length(e_k) >= 8 then 0.94 when starts_with(e_k, k) and length(k) >= 8 then 0.9 when contains(k, e_k) and length(e_k) >= 10 then 0.85
  when len(e_toks) = 0 then 0 when len(list_filter(e_toks, lambda t: list_contains(toks, t))) / len(e_toks)::double < 0.6 then 0 else 0.5::double + 0.3::double * (len(list_filter(e_toks, lambda t: list_contains(toks, t))) / len(e_toks)::double)
  + 0.15::double * (len(list_filter(e_toks, lambda t: list_contains(toks, t))) / greatest(1, len(toks))::double) end::double as sim from pr),
sm as (select *, exists (select 1 from heads h where h.doc_id = ps.doc_id and h.key = {sql_folios(sql_plain('raw'))}) as running from ps where sim >= 0.6)"""


@query(f"with {SIM} select doc_id, entry_idx, page_index, line_idx, part, sim, running from sm")
def title_similarity(spark, sf_dir):
    pairs = locate.similar_pairs(book_entries(spark, sf_dir), title_index(spark, sf_dir))
    return pairs.select("doc_id", "entry_idx", "page_index", "line_idx", "part", "sim", "running")


@query(f"""with {SIM}, b as (select *, row_number() over (partition by doc_id, entry_idx order by sim desc, page_index, line_idx, part) as r from sm where sim >= 0.9 and not running and printed is not null), d as (select doc_id, list_sort(list(page_index - printed + 1)) as d from b where r = 1 and size >= 9.8 group by 1)
select doc_id, d[len(d) // 2 + 1]::int as "offset" from d where len(d) >= 2""")
def page_offsets(spark, sf_dir):
    styles = made_lines(spark, sf_dir).select("doc_id").distinct().withColumn("body_size", F.lit(10.0))
    keyed = locate.entry_keys(book_entries(spark, sf_dir))
    return locate.estimate_offset(locate.similar_keys(keyed, title_index(spark, sf_dir), least=locate.SUREST), keyed, styles)


@query()
def located_headings(spark, sf_dir):
    rows = book_lines(spark, sf_dir)
    found, _ = locate.locate(book_entries(spark, sf_dir), rows, L.pages_of(rows), census.running_heads(rows), census.style_census(rows), census.toc_pages(rows), leftovers=True)
    return found.drop("matched")


# ---- arbitration and evaluation
def two_outlines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two overlapping sets of headings made of order lines."""
    rows = cut(level_rows(spark, sf_dir)).withColumns({"page_index": F.col("n"), "y": (F.col("doc_id") * 37 % 700).cast("int"), "size": F.lit(10.0), "title": F.concat(F.lit("Heading number "), F.col("n")), "score": F.lit(4.0), "font": F.lit("bold"), "seq": F.col("n")})
    a = rows.withColumns({"approx": (F.col("doc_id") + F.col("n")) % 5 == 0, "entry_idx": F.col("n")})
    b = rows.filter((F.col("doc_id") + F.col("n")) % 3 > 0).withColumn("y", F.col("y") + (F.col("n") % 2 * 40).cast("int"))
    return a, b


OUTLINES = f"""{LEVELS}, oa as (select doc_id, seq, level, (doc_id * 37 % 700) as y, (doc_id + seq) % 5 = 0 as approx from lv), ob as (select doc_id, seq, y + seq % 2 * 40 as y from oa where (doc_id + seq) % 3 > 0)"""


@query(f"with {OUTLINES} select a.doc_id, count(b.seq)::double / count(*) as agree from oa a left join ob b on a.doc_id = b.doc_id and a.seq = b.seq and abs(a.y - b.y) < 30 where not approx group by 1")
def agreement(spark, sf_dir):
    return arbitrate.agreement(*two_outlines(spark, sf_dir))


# titles that start alike or are the same stand on neighbouring pages, so what a heading may take depends on what others took
PRF = f"""{OUTLINES}, fo as (select doc_id, seq, case when (doc_id + seq) % 4 = 0 then 'stray heading' when seq % 2 = 1 then 'heading of an order continued' else 'heading of an order' end as k from ob),
pp as (select f.doc_id, f.seq as f, a.seq as t, row_number() over (partition by f.doc_id order by f.seq, a.seq) as i from fo f join oa a on a.doc_id = f.doc_id and abs(a.seq - f.seq) <= 1 and starts_with(f.k, 'heading of an order')),
gr as (select doc_id, 0::bigint as i, []::int[] as fs, []::int[] as ts from (select distinct doc_id from pp) union all select g.doc_id, p.i, case when free then list_append(fs, f) else fs end, case when free then list_append(ts, t) else ts end
  from gr g join pp p on p.doc_id = g.doc_id and p.i = g.i + 1, lateral (select not list_contains(g.fs, p.f) and not list_contains(g.ts, p.t) as free)),
tp as (select doc_id, max(len(fs)) as tp from gr group by 1), nt as (select doc_id, count(*) as t from oa group by 1), nf as (select doc_id, count(*) as f from ob group by 1),
pq as (select doc_id, case when coalesce(f, 0) > 0 then coalesce(tp, 0) / f::double else 0 end as precision, coalesce(tp, 0) / t::double as recall from nt left join nf using (doc_id) left join tp using (doc_id)),
prf as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from pq)"""


@query(f"with recursive {PRF} select doc_id, precision, recall, f1 from prf")
def outline_prf(spark, sf_dir):
    a, b = two_outlines(spark, sf_dir)
    truth = a.select("doc_id", F.col("n").alias("seq"), "level", F.lit("Heading of an order").alias("title"), (F.col("page_index") + 1).alias("page"))
    stray = (F.col("doc_id") + F.col("n")) % 4 == 0
    return evaluate.prf(b.withColumn("title", F.when(stray, "Stray heading").when(F.col("n") % 2 == 1, "Heading of an order, continued").otherwise("Heading of an order")), truth)


@query(f"with recursive {PRF} select count(*) as documents, round(avg(precision), 9) as precision, round(avg(recall), 9) as recall, round(avg(f1), 9) as mean_f1, list_sort(list(f1))[(count(*) // 2 + 1)::int] as median_f1 from prf")
def macro_summary(spark, sf_dir):
    out = evaluate.summary(cut(outline_prf(spark, sf_dir)))
    return out.select("documents", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "mean_f1")], "median_f1")


@query("select o_orderstatus as status, count(*) as n from orders group by 1")
def outcomes(spark, sf_dir):
    return evaluate.outcomes(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"))


# one heading of each outline stands on a page: level with the other where its number is even, else 40 points above it
MERGED = f"""{OUTLINES}, cd as (select a.doc_id, a.seq as page_index, a.y, 10.0::double as size, 'Heading number ' || a.seq as text, case when b.seq is not null and a.seq % 2 = 0 then 'TDC' else 'TC' end as tags, a.level as toc_level,
  4.0::double as score, b.seq is not null and a.seq % 2 = 0 as kept, case when b.seq is not null and a.seq % 2 = 0 then a.level end as kept_level from oa a left join ob b using (doc_id, seq)
  union all select b.doc_id, b.seq, b.y, 10.0::double, 'Heading number ' || b.seq, 'D', null, 4.0::double, true, a.level from ob b join oa a using (doc_id, seq) where b.seq % 2 = 1),
mg as (select doc_id, (row_number() over (partition by doc_id order by page_index, y desc))::int as i, page_index::int as page_index, y::int as y, size, text, tags, toc_level::int as toc_level, score, kept, kept_level::int as kept_level from cd)"""


@query(f"with {MERGED} select * from mg")
def merged_sources(spark, sf_dir):
    a, b = two_outlines(spark, sf_dir)
    pool = a.select("doc_id", "page_index", "y", "size", F.col("title").alias("text"), "score")
    return arbitrate.merge_sources(a, b, pool, b).withColumn("tags", F.array_join("tags", ""))


# ---- folds
# sizes of neighbouring lines differ, so no heading goes on over two lines; each of the four sizes is a band of its own
DETECTED = f"""{SCORED}, {HEADS}, rk as (select doc_id, key from (select distinct doc_id, page_index, {sql_norm('text')} as key from lines) where length(key) >= 4 group by 1, 2 having count(*) >= 3),
cd as (select *, {sql_norm('text')} as norm from sc where not {REJECT} and score >= 4), ck as (select cd.* from cd left join rk on rk.doc_id = cd.doc_id and rk.key = cd.norm
  where (rk.key is null or {matches('text', P.KEYWORDS)}) and not exists (select 1 from heads h where h.doc_id = cd.doc_id and h.key = {sql_folios(sql_norm('text'))})),
cl as (select *, dense_rank() over (partition by doc_id order by size desc)::int as level, lag(norm) over w as n0, lag(page_index) over w as p0 from ck window w as (partition by doc_id order by page_index, line_idx)),
hd as (select doc_id, (row_number() over (partition by doc_id order by page_index, line_idx))::int as seq, trim(text) as title, level, page_index, floor(y + size + 0.5)::int as y, floor(score * 10 + 0.5) / 10 as score, size, font from cl where n0 is null or n0 <> norm or page_index - p0 > 1)"""


@query(f"with {DETECTED} select * from hd")
def typographic_headings(spark, sf_dir):
    return detect.detect(book_lines(spark, sf_dir))[0]


@query(f"""with {DETECTED}, hn as (select doc_id, count(*) as headings, avg(score) as mean_score from hd group by 1), cn as (select doc_id, count(*) as candidates from ck group by 1), hh as (select doc_id, count(*) as running_heads from heads group by 1)
select hp.doc_id, pages, body_size, body_font, coalesce(candidates, 0) as candidates, coalesce(running_heads, 0) as running_heads, null::varchar as toc_pages, coalesce(headings, 0) as headings, floor(coalesce(mean_score, 0) * 10 + 0.5) / 10 as mean_score,
  false as use_numbering, floor(coalesce(headings, 0) / greatest(pages, 1)::double * 100 + 0.5) / 100 as density from hp join cs on cs.doc_id = hp.doc_id left join hn on hn.doc_id = hp.doc_id left join cn on cn.doc_id = hp.doc_id left join hh on hh.doc_id = hp.doc_id""")
def detect_statistics(spark, sf_dir):
    return detect.detect(book_lines(spark, sf_dir))[2].withColumn("toc_pages", F.array_join("toc_pages", ","))


# on these pages each row starts at one place and names a page, which is read as a reference if it has one to four digits (``split_page``); numbers rise
# down a page, so a row without a reference is never followed by one with it, and stands for itself. Edges and running heads are no rows
CONTENTS = rf"""{MADE_LINES}, {HEADS}, cr as (select doc_id, page_index, line_idx, trim(text) as t, 1 - y / 792.0::double as rel, page_index + line_idx + 2 < 10000 as paged from lines where page_index % 25 = 0),
ct as (select *, trim(regexp_replace(case when paged then trim(regexp_replace(t, '\.{{4}} [0-9]+$', '')) else t end, ' +', ' ', 'g')) as title from cr where t <> 'Contents' and not regexp_matches(t, '(?i)^[ivxlcdm0-9]{{1,6}}$') and not ((rel < 0.07 or rel > 0.93) and length(t) < 60)
  and not exists (select 1 from heads h where h.doc_id = cr.doc_id and h.key = {sql_folios("trim(regexp_replace(strip_accents(lower(t)), '[^a-z0-9 ]+', ' ', 'g'))")})),
ce as (select doc_id, page_index, paged, (row_number() over (partition by doc_id, page_index order by line_idx) - 1)::int as entry_idx, title, case when paged then (page_index + line_idx + 2)::int end as printed from ct
  where regexp_matches(title, '\p{{L}}{{3}}') and (paged or length(title) < 120 and {sql_letters('title')} * 10 >= length(replace(title, ' ', '')) * 6)
  and not regexp_matches(title, '(?i)^(fig|figure|table|tableau|graphique|encadr[ée]|illustration|planche|photo|sch[ée]ma|exhibit|box) *[ivx]') and not regexp_matches(title, '(?i)^(chapitre|chapter|partie|part|section|livre|book|tome|annexe|appendix) *[ivx]*$')),
cb as (select doc_id, page_index, count(*) filter (where paged) as refs, count(*) as n from ce group by 1, 2),
cx as (select *, row_number() over (partition by doc_id order by case when refs >= 3 then refs else n * 0.5 end desc, page_index) as r from cb where refs >= 3 or n >= 4)"""


@query(f"with {CONTENTS} select ce.doc_id, entry_idx, title, 1 as level, printed, false as roman, 1.0::double as indent, page_index as toc_page from ce join cx using (doc_id, page_index) where r = 1")
def printed_contents(spark, sf_dir):
    """The contents page with most references of each book; a page with fewer than three counts half of its entries."""
    rows = made_lines(spark, sf_dir)
    return contents.printed_contents(rows, census.running_heads(rows), census.toc_pages(rows))[0]


@query()
def pasted_contents(spark, sf_dir):
    """The lines of every document as a supplied contents list."""
    return contents.parse_pasted(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text"))


# a full page has a gap between its columns and is read column by column; on a page of few words two stand on a line
@query(r"""with wd as (select doc_id, string_split_regex(text, '[ \t\n\x0B\f\r]+') as ws from documents where text is not null), wu as (select doc_id, unnest(ws) as w, (generate_subscripts(ws, 1) - 1)::int as i from wd),
wp as (select doc_id, (i // 200)::int as page_index, i % 200 as k, w, count(*) over (partition by doc_id, i // 200) as n from wu where w <> ''),
wl as (select doc_id, page_index, (k % 2)::int as col, k as place, w as text, 1 as n_frags from wp where n >= 40 union all select doc_id, page_index, 0, k // 2, string_agg(w, ' ' order by k), count(*)::int from wp where n < 40 group by doc_id, page_index, k // 2),
wn as (select doc_id, page_index, (row_number() over (partition by doc_id, page_index order by col, place) - 1)::int as line_idx, col, n_frags, text from wl),
wc as (select * replace (trim(regexp_replace(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200F}]', '', 'g'), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) as text) from wn)
select doc_id, page_index, line_idx, text, col, n_frags from wc where text <> ''""")
def reading_order(spark, sf_dir):
    """Pages set in two columns of words, back to lines."""
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    words = rows.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("frag_idx", "text")).filter("text <> ''")
    k = F.col("frag_idx") % 200
    fragments = words.select("doc_id", F.floor(F.col("frag_idx") / 200).cast("int").alias("page_index"), "frag_idx", "text", ((k % 2) * 300 + 50).cast("double").alias("x"), (700 - F.floor(k / 2) * 6).cast("double").alias("y"), F.lit(10.0).alias("size"), F.lit(200.0).alias("width"), F.lit("body").alias("font"))
    pages = fragments.select("doc_id", "page_index").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0), "view_top": F.lit(792.0)})
    return layout.group_lines(fragments, pages).select("doc_id", "page_index", "line_idx", "text", "col", "n_frags")


@query(f"""with {MERGED} select doc_id, i, text as title, case when not kept then 2 when i = 3 then 2 else kept_level end as level, page_index, y, size from mg where (kept and i <> 1) or (not kept and i = 2)""")
def edited_outlines(spark, sf_dir):
    """A recorded reply applied to the candidates of every order."""
    a, b = two_outlines(spark, sf_dir)
    candidates = arbitrate.merge_sources(a, b, a.select("doc_id", "page_index", "y", "size", F.col("title").alias("text"), "score"), b)
    reply = 'Here it is: {"retirer": [1], "ajouter": [{"i": 2, "l": 9}], "niveaux": [{"i": 3, "l": 2}]} as asked {for}.'
    replies = a.select("doc_id").distinct().withColumn("reply", F.lit(reply))
    return model.edit_outline(candidates, replies)


@query()
def document_outlines(spark, sf_dir):
    """The whole plan over all books: headings of the chosen source as trees."""
    rows = book_lines(spark, sf_dir)
    return outline.as_tree(outline.run(rows, L.pages_of(rows)).headings)
