"""Toxicity by compression distance: windows of a text are compressed with a dictionary of toxic text and one of ordinary text.

A window is one word with a blank on both sides, in lower case and without marks around it; the same padding stands behind
every window, since the compressor doesn't look for matches near an end. The dictionaries are raw-content zstandard
dictionaries of training windows: those more frequent in toxic documents (log-likelihood ratio) and the most frequent rest.
A window's cell is its length, its length under the ordinary dictionary and the bytes that the toxic one saves; each cell has
its own calibrated log-odds of standing in a toxic document. A logistic curve of a document's two highest log-odds and its
number of windows gives the score. Cells are counted crosswise: dictionaries of one half of the sample, documents of the other.

The classifier is fitted on a bounded sample of labelled rows: ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` documents, those with
the smallest md5 of their ids. Their texts stay on the executors: words are counted there, and only the dictionaries' words,
counts by cell and four numbers for each sampled document come to the driver. Scoring covers every window of every document.

Defined results: null and empty texts have no window and the score of that; null ids are scored and count as not held out
(their remainder is null); repeated rows are scored alike; without labels of both kinds all scores are 0; an empty table
gives an empty one; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache_of, crc_bucket, discard, written
from .encoding import batches

SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 3000
DICT_WORDS = 4000
MARKS = " \t\n.,;:!?\"'()[]%$#&*"
TAIL = b"~carrier~0123456789~abcd"
LEVEL = 6
CACHE_WINDOWS = 400_000
_NONE = -9.0


def windows(text: str | None) -> set[str]:
    return set((text or "").lower().split())


class Compressors:
    """Cell of a window under two dictionaries."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)

    @staticmethod
    def _compressor(words: list[str]):
        content = (" " + " ".join(words) + " ").encode("utf-8", "surrogatepass") + TAIL
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=80, dict_size=len(content), min_match=4, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0
        )
        return zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress

    def cell(self, word: str) -> tuple[int, int, int]:
        raw = word.strip(MARKS).encode("utf-8", "surrogatepass")
        window = b" " + raw + b" " + TAIL
        plain = len(self.ordinary(window))
        return min(len(raw), 24), min(plain, 40), max(-4, min(9, plain - len(self.toxic(window))))


@dataclass
class Model:
    toxic: list[str] = field(default_factory=list)
    ordinary: list[str] = field(default_factory=list)
    cells: dict[tuple[int, int, int], float] = field(default_factory=dict)
    curve: list[float] | None = None

    def score(self, values: list[float]) -> float:
        """values: log-odds of the document's distinct windows."""
        if not self.curve:
            return 0.0
        z = float(np.dot(self.curve, features(values)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(values) -> list[float]:
    top = sorted(values, reverse=True)[:2] if len(values) < 3 else np.partition(values, len(values) - 2)[-2:][::-1].tolist()
    top += [_NONE] * (2 - len(top))
    return [1.0, top[0], top[1], math.log1p(len(values))]


def _ratio(a, n: int, b, m: int):
    """Log-likelihood ratio of a in n against b in m, as an expression."""
    p = (a + b) / F.lit(float(n + m))
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    part = lambda k, t: term(k, t * p) + term(t - k, t * (1 - p))
    return 2 * (part(a, float(n)) + part(b, float(m)))


def dictionaries(counts: DataFrame, n: dict[int, int]) -> tuple[list[str], list[str]]:
    """Words of the two dictionaries, the strongest last, where they are cheapest to point to. counts: word, a (toxic documents), b (ordinary ones)."""
    if not n.get(0) or not n.get(1):
        return [], []
    telling = (F.col("a") >= 3) & (F.col("a") / n[1] > 4 * F.col("b") / n[0]) & (_ratio(F.col("a"), n[1], F.col("b"), n[0]) >= 20)
    rows = counts.withColumns({"telling": telling, "strength": F.round(_ratio(F.col("a"), n[1], F.col("b"), n[0]), 9)})
    toxic = rows.filter("telling").orderBy(F.desc("strength"), F.desc("word")).limit(DICT_WORDS).select("word").collect()
    ordinary = rows.filter("not telling and b > 0").orderBy(F.desc("b"), F.desc("word")).limit(DICT_WORDS).select("word").collect()
    return [r.word for r in toxic[::-1]], [r.word for r in ordinary[::-1]]


def word_counts(sample: DataFrame) -> DataFrame:
    """word, half, a, b: toxic and ordinary documents of each half of the sample that hold it."""

    def run(stream):
        for batch in stream:
            for half, toxic, text in zip(batch.column("half").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                words = sorted({w.strip(MARKS) for w in windows(text.as_py())} - {""})
                for first in range(0, len(words), 100_000):
                    some = words[first : first + 100_000]
                    yield pa.record_batch({"word": pa.array(some, pa.string()), "half": pa.array([half] * len(some), pa.int32()), "toxic": pa.array([toxic] * len(some), pa.int32())})

    found = sample.select("half", "toxic", "text").mapInArrow(run, "word string, half int, toxic int")
    return found.groupBy("word", "half").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_ordinary: int = SAMPLE_ORDINARY) -> Model:
    """Learns from labelled documents whose crc32(doc_id as text) mod 5 is not 0; a document labelled twice is toxic if any label says so.
    Of rows with one id, the least text counts; labels other than 0 and 1 are none."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(crc_bucket(F.col("doc_id"), 5) != 0)
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.md5(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    picked = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, sample_toxic), (0, sample_ordinary))]
    ids = F.broadcast(picked[0].union(picked[1]))  # as many rows as the sample has at most
    half = F.pmod(F.conv(F.substring(order, 9, 4), 16, 10).cast("int"), F.lit(2))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"), F.min(half).alias("half"))
    sample = written(rows.groupBy("toxic", "text").agg(F.min("half").alias("half")), "toxicity-sample")
    n = {(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    both = {y: n.get((0, y), 0) + n.get((1, y), 0) for y in (0, 1)}
    if not both[0] or not both[1]:
        return Model()
    words = written(word_counts(sample), "toxicity-words")
    whole = dictionaries(words.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), both)
    # a half without one of the kinds gives no dictionaries; those of the whole sample stand in
    halves = [dictionaries(words.filter(F.col("half") == h), {y: n.get((h, y), 0) for y in (0, 1)}) if n.get((h, 0)) and n.get((h, 1)) else whole for h in (0, 1)]

    def cells_of(stream, odds):
        known = [{}, {}]
        find = [Compressors(*d).cell for d in halves]
        for batch in stream:
            for half, toxic, text in zip(batch.column("half").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                own, cell = known[1 - half], find[1 - half]
                if len(own) > CACHE_WINDOWS:
                    own.clear()
                at = [own[w] if w in own else own.setdefault(w, cell(w)) for w in windows(text.as_py())]
                if odds is None:
                    a, b, c = np.array(sorted(set(at)), np.int32).reshape(-1, 3).T
                    yield pa.record_batch({"toxic": pa.array([toxic] * len(a), pa.int32()), "a": pa.array(a), "b": pa.array(b), "c": pa.array(c)})
                else:
                    yield pa.record_batch({"toxic": [float(toxic)], "x": pa.array([features([odds[c] for c in at])], pa.list_(pa.float64()))})

    columns = sample.select("half", "toxic", "text")
    seen = columns.mapInArrow(lambda s: cells_of(s, None), "toxic int, a int, b int, c int").groupBy("toxic", "a", "b", "c").count().collect()  # as many as there are cells
    times: tuple[dict, dict] = {}, {}
    for r in seen:
        times[r.toxic][(r.a, r.b, r.c)] = r["count"]
    odds = {c: math.log((times[1].get(c, 0) + 0.3) / (both[1] + 1)) - math.log((times[0].get(c, 0) + 0.9) / (both[0] + 1)) for c in {*times[0], *times[1]}}
    placed = columns.mapInArrow(lambda s: cells_of(s, odds), "toxic double, x array<double>").collect()  # four numbers for each document of the sample
    discard(sample, words)
    placed.sort(key=lambda r: (r.toxic, r.x))
    return Model(*whole, odds, curve(np.array([r.x for r in placed]), np.array([r.toxic for r in placed]), counts[1] / sum(counts.values())))


def curve(x: np.ndarray, y: np.ndarray, share_toxic: float) -> list[float]:
    """Weights of a penalised logistic regression, by Newton steps; the classes weigh as in all labels."""
    weight = np.where(y == 1, share_toxic / (y == 1).sum(), (1 - share_toxic) / (y == 0).sum()) * len(y)
    out = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 0.1 * out
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(x.shape[1]), gradient)
        out += step
        if np.abs(step).max() < 1e-8:
            break
    return out.tolist()


def score(docs: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """The ``keep`` columns, then score and predicted, a row per document; ``keep`` may hold ``text``."""
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col("text"))
    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + ["score double", "predicted int"])
    key = hash((tuple(model.toxic), tuple(model.ordinary), tuple(model.curve or ())))

    def run(stream):
        held = cache_of("toxicity")
        if held.get("key") != key:
            held.clear()
            held.update(key=key, compressors=Compressors(model.toxic, model.ordinary), odds={})
        find, odds = held["compressors"].cell, held["odds"]
        worst = math.log(0.3) - math.log(0.9)  # a cell that no sampled document had
        for batch in stream:
            for texts, rest in batches(batch):
                scores = []
                for text in texts:
                    values = []
                    for w in windows(text):
                        v = odds.get(w)
                        if v is None:
                            if len(odds) >= CACHE_WINDOWS:
                                odds.clear()
                            v = odds[w] = model.cells.get(find(w), worst)
                        values.append(v)
                    scores.append(model.score(values))
                out = np.array(scores)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.float64()), pa.array((out >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: scores all ``documents``."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
