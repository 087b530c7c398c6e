"""Asking a model about candidates, and reading its replies. The provider is any ``Callable[[str], str]``; none is called by default."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.markup import json_array, json_object
from ..schemas import EDIT_REPLY, MATCH_REPLY, SELECT_REPLY
from .tree import rebase_levels, top_per_group

CLIP = 120


SELECT_TASK = (
    "You are given lines of a document that may be headings. Answer with a JSON list of the real headings, in reading order, and nothing else: "
    '[{"i": number of the line, "l": level from 1 to 6}]. Leave out body text, captions, running heads and names of authors.'
)
EDIT_TASK = (
    "You are given a proposed table of contents and other lines of the document. Lines marked as kept stand in the proposal. Each line says which sources propose it: T printed contents, "
    "D typography, C candidate. Answer with one JSON object and nothing else: "
    '{"retirer": [numbers of kept lines that are no headings], "ajouter": [{"i": number of a missing heading, "l": level}], "niveaux": [{"i": number of a kept line, "l": right level}]}. Change only what is wrong.'
)
MATCH_TASK = (
    "Titles of a table of contents are given, and for each some lines of the document where it may stand. Answer with a JSON list and nothing else: "
    '[{"e": number of the title, "i": number of the line, or null if none fits}].'
)


def header(about: DataFrame) -> DataFrame:
    """doc_id, head: what the model is told of a document (title, pages, body_size, has_toc; any may be absent or null)."""
    part = lambda name, value: F.when(F.col(name).isNotNull(), value) if name in about.columns else F.lit(None).cast("string")
    facts = [
        part("title", F.concat(F.lit("Title: "), F.col("title") if "title" in about.columns else F.lit(""))),
        part("pages", F.format_string("Pages: %d", F.col("pages").cast("long")) if "pages" in about.columns else None),
        part("body_size", F.format_string("Size of the body text: %.1f pt", F.col("body_size")) if "body_size" in about.columns else None),
        part("has_toc", F.when(F.col("has_toc"), "A printed table of contents was found").otherwise("No printed table of contents was found") if "has_toc" in about.columns else None),
    ]
    return about.select("doc_id", F.concat_ws("\n", *facts).alias("head"))


def _prompt(rows: DataFrame, line, order: str, task: str, about: DataFrame | None) -> DataFrame:
    """doc_id, prompt: the task, what is known of the document, and a line for each row in order."""
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("rows"))
    if about is not None:
        lines = lines.join(header(about), "doc_id", "left")
    head = F.nullif("head", F.lit("")) if about is not None else F.lit(None).cast("string")
    return lines.select("doc_id", F.concat_ws("\n\n", F.lit(task), head, F.array_join("rows.line", "\n")).alias("prompt"))


def _line(tags: bool):
    kept = F.when(F.col("kept"), F.concat(F.lit(" [kept level "), F.col("kept_level").cast("string"), F.lit("]"))).otherwise("") if tags else F.lit("")
    sources = F.concat(F.lit(" "), F.array_join("tags", "")) if tags else F.lit("")
    return F.format_string("[%d] p%d %.1fpt%s%s: %s", "i", F.col("page_index") + 1, F.coalesce("size", F.lit(0.0)), sources, kept, F.substring("text", 1, CLIP))


def prompts(candidates: DataFrame, about: DataFrame | None = None, task: str = EDIT_TASK) -> DataFrame:
    """doc_id, prompt: one line per candidate with its number, page, size, sources, kept level and text."""
    return _prompt(candidates, _line(True), "i", task, about)


def plain_prompts(pool: DataFrame, about: DataFrame | None = None, task: str = SELECT_TASK) -> DataFrame:
    """doc_id, prompt of lines alone, without sources."""
    return _prompt(pool, _line(False), "i", task, about)


def match_prompts(options: DataFrame, about: DataFrame | None = None, task: str = MATCH_TASK) -> DataFrame:
    """doc_id, prompt: titles that were not found, each followed by the lines where it may stand."""
    line = F.format_string("  [%d] p%d: %s", "i", F.col("page_index") + 1, F.substring("text", 1, CLIP))
    title = F.when(F.col("_first"), F.concat(F.format_string("Title %d: %s", "e", F.col("title")), F.lit("\n"))).otherwise("")
    first = F.row_number().over(Window.partitionBy("doc_id", "e").orderBy("i")) == 1
    return _prompt(options.withColumn("_first", first), F.concat(title, line), "i", task, about)


def ask(asked: DataFrame, provider: Callable[[str], str] | None) -> DataFrame:
    """doc_id, reply: null without a provider or where it fails."""
    if provider is None:
        return asked.select("doc_id", F.lit(None).cast("string").alias("reply"))

    def one(prompt):
        try:
            return provider(prompt)
        except Exception:  # a model's failure leaves the proposal as it is
            return None

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "reply": [one(p) for p in f["prompt"]]})

    return asked.select("doc_id", "prompt").mapInPandas(run, "doc_id long, reply string")


def _level(column, default=None):
    return F.when(column.between(1, 6), column).otherwise(default)


def select_outline(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Headings that a reply ``[{"i": n, "l": level}, …]`` names: known numbers, each once, levels within 1 to 6 and from 1 up."""
    items = replies.select("doc_id", F.posexplode(F.from_json(json_array("reply"), SELECT_REPLY)).alias("p", "r")).select("doc_id", "p", "r.i", F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("r.l", F.lit(1)))).alias("level"))
    items = top_per_group(items, ["doc_id", "i"], ["p"], 1).drop("p")
    return rebase_levels(candidates.join(items, ["doc_id", "i"]).select("doc_id", "i", F.col("text").alias("title"), "level", "page_index", "y", "size"))


def edit_outline(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """The kept headings as a reply corrects them: removals and levels of kept ones, additions of others (level 2 if none is valid)."""
    reply = replies.select("doc_id", F.from_json(json_object("reply"), EDIT_REPLY).alias("r"))
    # candidates meet their document's reply once and look into its lists; the last answer to a number counts
    lists = reply.groupBy("doc_id").agg(*[F.flatten(F.collect_list(f"r.{name}")).alias(f"_{name}") for name in ("retirer", "ajouter", "niveaux")])
    named = lambda name, fits=None: F.filter(f"_{name}", lambda x: (x["i"] == F.col("i")) & (F.lit(True) if fits is None else fits(x)))
    last = lambda found: F.try_element_at(found, F.lit(-1))["l"]
    rows = candidates.join(lists, "doc_id", "left")
    rows = rows.withColumns({
        "_removed": F.coalesce(F.array_contains("_retirer", F.col("i")), F.lit(False)), "_level": last(named("niveaux", lambda x: x["l"].between(1, 6))),
        "_added": F.when(F.size(named("ajouter")) > 0, _level(last(named("ajouter")), 2)),
    })
    rows = rows.filter("(kept and not _removed) or (not kept and _added is not null)")
    return rows.select("doc_id", "i", F.col("text").alias("title"), F.when(F.col("kept"), F.coalesce("_level", "kept_level")).otherwise(F.col("_added")).alias("level"), "page_index", "y", "size")


def proposal(candidates: DataFrame) -> DataFrame:
    """The headings that stand in the proposal which a model is shown."""
    return candidates.filter("kept").select("doc_id", "i", F.col("text").alias("title"), F.col("kept_level").alias("level"), "page_index", "y", "size")


def accept(base: DataFrame, revised: DataFrame, contract: str = "edit") -> DataFrame:
    """doc_id, accepted: three headings at least; an edit must have changed a heading or its level; a selection needs 30 % of the
    base, unless that has fewer than three."""
    side = lambda df, name: df.select("doc_id", "page_index", "title", "level", F.lit(1).alias(name))
    both = side(base, "b").unionByName(side(revised, "r"), allowMissingColumns=True).fillna(0, ["b", "r"])
    places = both.groupBy("doc_id", "page_index", "title", "level").agg(F.sum("b").alias("b"), F.sum("r").alias("r"))
    n = places.groupBy("doc_id").agg(F.sum("b").alias("b"), F.sum("r").alias("r"), F.max(F.col("b") != F.col("r")).alias("changed"))
    enough = F.col("r") >= 3
    return n.select("doc_id", (enough & ((F.col("b") < 3) | (F.col("r") >= F.col("b") * 0.3)) if contract == "select" else enough & F.col("changed")).alias("accepted"))


def match_options(unmatched: DataFrame, places: DataFrame, questions: int = 25, options: int = 6) -> DataFrame:
    """doc_id, e, i: up to ``questions`` entries per document and ``options`` lines for each, both numbered from 1."""
    asked = unmatched.withColumn("e", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry_idx"))).filter(F.col("e") <= questions)
    rows = top_per_group(places.join(asked.select("doc_id", "entry_idx", "e", "title"), ["doc_id", "entry_idx"]), ["doc_id", "entry_idx"], ["cand_idx"], options)
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("e", "cand_idx")))


def match_titles(options: DataFrame, replies: DataFrame) -> DataFrame:
    """The offered options that a reply ``[{"e": entry, "i": line}, …]`` picks; the first answer to an entry counts, null is none."""
    items = replies.select("doc_id", F.posexplode(F.from_json(json_array("reply"), MATCH_REPLY)).alias("p", "r")).select("doc_id", "p", "r.e", "r.i")
    return options.join(top_per_group(items, ["doc_id", "e"], ["p"], 1).drop("p"), ["doc_id", "e", "i"])


def checked_config(config: dict) -> dict:
    """Provider options: ``provider`` off, http or command; http needs ``url`` and ``model``, command needs ``command``."""
    kind = config.get("provider", "off")
    needed = {"off": (), "http": ("url", "model"), "command": ("command",)}
    if kind not in needed:
        raise ValueError(f"unknown provider {kind!r}")
    missing = [k for k in needed[kind] if not config.get(k)]
    if missing:
        raise ValueError(f"provider {kind} needs {', '.join(missing)}")
    return {"provider": kind, "temperature": 0, "timeout": 300, **config}


def http_provider(config: dict) -> Callable[[str], str]:
    """An OpenAI-compatible endpoint, temperature 0."""
    config = checked_config({**config, "provider": "http"})

    def call(prompt: str) -> str:
        import json
        import urllib.request

        body = {"model": config["model"], "temperature": config["temperature"], "messages": [{"role": "system", "content": config.get("system", "")}, {"role": "user", "content": prompt}]}
        request = urllib.request.Request(config["url"], json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {config.get('key', '')}"})
        with urllib.request.urlopen(request, timeout=config["timeout"]) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    return call


def command_provider(config: dict) -> Callable[[str], str]:
    """A local command that reads the prompt and prints the reply."""
    config = checked_config({**config, "provider": "command"})

    def call(prompt: str) -> str:
        import subprocess

        return subprocess.run(config["command"], input=prompt, capture_output=True, text=True, timeout=config["timeout"], check=True).stdout

    return call
