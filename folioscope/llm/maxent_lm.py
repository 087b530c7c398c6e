"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The probability of a token after its history is P(class) * P(member | class) * P(word | leaf). Class and member are softmaxes
over hashed features of the history: a constant, the last word, the last two, and two skip features (the word before the last,
the word before that). A leaf is a (class, member) pair: the ``HEADS`` most frequent training words have one each, the others
share the rest by a hash of their ends. Words within a leaf follow their training counts with 0.1 added, once more for words
not seen; so the probabilities of all words seen and of one unseen word add up to 1 after any history.

Training is distributed: a pass over the training tokens counts features with classes, which gives the first weights (log-odds
against the plain shares, drawn to 0 for rare features). ``ROUNDS`` gradient updates follow, each over the training documents of
one part (a hash of the document), so each training token is used once: every task sums the gradient of its tokens, the sums
are added in a shuffle block by block, and a step is divided by the curvature that the counts give. Sums don't depend on the order of
rows, so neither do the scores, but for rounding. The number of hashed rows grows with the training tokens, see ``feature_bits``.

Documents are encoded once: a chunk is a table row with its documents' token codes and the hashes of its distinct words.
Counts travel per chunk and word, packed by bucket, first to be summed and then back to the chunk; so nothing that grows with
the vocabulary is broadcast, and a frequent word adds one number per chunk. Words are 64-bit hashes.

Defined results: null and empty texts are the end token alone; a null id has no remainder and so counts as training text
that is not held out; repeated rows count each time; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, parts, text_bytes, unpack, written
from .encoding import batches

CLASSES, MEMBERS, HEADS = 16, 16, 128
#: Bits of a feature's hash: one row for so many training tokens up to ``WHOLE_BITS``; from ``WIDE_TOKENS`` on the rows grow with the root of
#: the tokens, since each task adds up a whole table. The last number bounds a table by memory: 84 MB a factor, at a million times ``WIDE_TOKENS``.
LEAST_BITS, WHOLE_BITS, MOST_BITS, ROW_TOKENS, WIDE_TOKENS = 8, 14, 18, 256, 1 << 27
#: Characters of a task that adds up tables of ``WHOLE_BITS``; larger tables come with larger tasks, so they stay a fixed share of the input.
TASK_CHARS = 72 << 20
ROUNDS = 3
#: Tokens' worth of the plain shares in a feature's first weights, share of its log-odds taken, length of a step, curvature added.
DRAW, TRUST, RATE, DAMP = 30.0, 0.4, 0.35, 10.0
BATCH = 16384
CHUNK_CHARS = 8 << 20
BUCKET_BYTES = 16 << 20
HELD_OUT = 10
ADD = 0.1
_U = np.uint64
END = 0x0E4D0E4D0E4D0E4D


class _Words(dict):
    """word -> number in the chunk; hash and leaf of its ending by number."""

    def __init__(self):
        self.hashes, self.ends = [END], [0]  # number 0 is the end token, which no word can name

    def __missing__(self, word):
        self[word] = n = len(self.hashes)
        h = xxhash.xxh3_64_intdigest(word)
        self.hashes.append(h if h != END else END + 1)
        self.ends.append(xxhash.xxh32_intdigest(word[-2:]) & 0xFFFF)
        return n


CHUNK = "chunk long, doc_ids binary, nulls binary, held binary, part binary, sizes binary, codes binary, words binary, ends binary, counts binary"


def encode(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of documents: token codes (0: the end), distinct words, and their counts in training documents."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 15)).cast("short")
    rows = docs.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), HELD_OUT) == 0, F.lit(False)).alias("held"), part.alias("part"), "text")

    def run(stream):
        part, made = TaskContext.get().partitionId(), 0
        state = _Words(), [], [], [], [], []
        held_chars = 0

        def flush():
            words, ids, held, parts_, sizes, codes = state
            ids, held, sizes = pa.concat_arrays(ids), np.concatenate(held), np.array(sizes, np.int64)
            codes = np.concatenate(codes)
            counts = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(words.hashes))
            row = [[part << 32 | made], *([x.tobytes()] for x in (
                ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), held, np.concatenate(parts_), sizes, codes,
                np.array(words.hashes, _U), np.array(words.ends, np.uint16), counts.astype(np.int32)))]
            return pa.record_batch([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], names=[c.split()[0] for c in CHUNK.split(", ")])

        for batch in stream:
            for texts, rest in batches(batch, 1 << 20):
                words, ids, held, parts_, sizes, codes = state
                for text in texts:
                    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                    codes.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                    codes.append(np.zeros(1, np.uint32))
                    sizes.append(len(found) + 1)
                    held_chars += len(text or "")
                ids.append(rest.column("doc_id").cast(pa.int64()))
                held.append(rest.column("held").to_numpy(zero_copy_only=False).astype(bool))
                parts_.append(rest.column("part").to_numpy(zero_copy_only=False).astype(np.int16))
                if held_chars >= chunk_chars:
                    yield flush()
                    state, held_chars, made = (_Words(), [], [], [], [], []), 0, made + 1
        if state[4]:
            yield flush()

    return rows.mapInArrow(run, CHUNK)


def exchange(chunks: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds per bucket: for a chunk, the totals of its words in this bucket; for the bucket itself (chunk null),
    tokens and distinct words by leaf of ending, the most frequent words, and the tokens of each."""

    def send(stream):
        for batch in stream:
            for chunk, words, ends, counts in zip(batch.column("chunk").to_pylist(), *(batch.column(c) for c in ("words", "ends", "counts")), strict=True):
                words, ends, counts = unpack(words.as_buffer(), _U), unpack(ends.as_buffer(), np.uint16), unpack(counts.as_buffer(), np.int32)
                bucket = ((words >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                cut = [order[edges[b] : edges[b + 1]] for b in full]
                yield pa.record_batch({
                    "bucket": pa.array(full), "chunk": pa.array(np.full(len(full), chunk)), "places": pa.array([x.astype(np.int32).tobytes() for x in cut], pa.binary()),
                    "words": pa.array([words[x].tobytes() for x in cut], pa.binary()), "ends": pa.array([ends[x].tobytes() for x in cut], pa.binary()), "counts": pa.array([counts[x].tobytes() for x in cut], pa.binary()),
                })

    sent = chunks.select("chunk", "words", "ends", "counts").mapInArrow(send, "bucket long, chunk long, places binary, words binary, ends binary, counts binary")

    def add(key, table):
        words = [unpack(x.as_buffer(), _U) for x in table.column("words")]
        flat = np.concatenate(words)
        ends = np.concatenate([unpack(x.as_buffer(), np.uint16) for x in table.column("ends")])
        counts = np.concatenate([unpack(x.as_buffer(), np.int32) for x in table.column("counts")])
        distinct, first, at = np.unique(flat, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)
        back = total[at]
        stops = np.cumsum([len(w) for w in words])
        own = ends[first]
        seen = total > 0
        top = np.lexsort((distinct, -total))[:HEADS]
        top = top[seen[top]]
        summary = np.concatenate([np.bincount(own[seen] % (CLASSES * MEMBERS - HEADS), weights=total[seen], minlength=CLASSES * MEMBERS - HEADS), np.bincount(own[seen] % (CLASSES * MEMBERS - HEADS), minlength=CLASSES * MEMBERS - HEADS)]).astype(np.int64)
        n = len(words)
        return pa.table({
            "bucket": pa.array([table.column("bucket")[0].as_py()] * (n + 1), pa.int64()), "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
            "places": pa.concat_arrays([*table.column("places").chunks, pa.array([summary.tobytes()], pa.binary())]),
            "totals": pa.array([*(x.tobytes() for x in np.split(back, stops[:-1])), total[top].tobytes()], pa.binary()),
            "heads": pa.array([None] * n + [distinct[top].tobytes()], pa.binary()), "head_ends": pa.array([None] * n + [own[top].tobytes()], pa.binary()),
        })

    return sent.groupBy("bucket").applyInArrow(add, "bucket long, chunk long, places binary, totals binary, heads binary, head_ends binary")


def summarise(summaries: DataFrame, buckets: int) -> dict:
    """Tokens N, distinct words V, the head words and the sizes of the leaves; summed by groups of buckets first."""
    rest = CLASSES * MEMBERS - HEADS

    def fold(key, table):
        total, heads = np.zeros(2 * rest, np.int64), {}
        for s, h, t, e in zip(*(table.column(c) for c in ("places", "heads", "totals", "head_ends")), strict=True):
            total += unpack(s.as_buffer(), np.int64)
            heads |= dict(zip(unpack(h.as_buffer(), _U).tolist(), zip(unpack(t.as_buffer(), np.int64).tolist(), unpack(e.as_buffer(), np.uint16).tolist(), strict=True), strict=True))
            heads = dict(sorted(heads.items(), key=lambda x: (-x[1][0], x[0]))[:HEADS])
        k = list(heads)
        blobs = {"places": total, "heads": np.array(k, _U), "totals": np.array([heads[x][0] for x in k], np.int64), "head_ends": np.array([heads[x][1] for x in k], np.uint16)}
        return pa.table({"g": pa.array([0], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in blobs.items()}})

    groups = max(1, math.isqrt(buckets))
    summaries = summaries.select(F.pmod("bucket", F.lit(groups)).alias("g"), "places", "heads", "totals", "head_ends")
    for _ in range(2):  # groups of buckets, then one row for all
        summaries = summaries.groupBy("g").applyInArrow(fold, "g long, places binary, heads binary, totals binary, head_ends binary")
    row = summaries.first()
    total = unpack(row.places, np.int64) if row else np.zeros(2 * rest, np.int64)
    heads, counts, ends = (unpack(row.heads, _U), unpack(row.totals, np.int64), unpack(row.head_ends, np.uint16)) if row else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.uint16))
    tokens, kinds = total[:rest].copy(), total[rest:].copy()
    n, v = int(tokens.sum()), int(kinds.sum())
    np.subtract.at(tokens, ends % rest, counts)
    np.subtract.at(kinds, ends % rest, 1)
    # heads by falling count fill the leaves first; a leaf of its own needs no estimate within
    leaf_mass = np.concatenate([np.zeros(HEADS), tokens + ADD * (kinds + 1)])
    order = np.argsort(heads)
    return {"n": n, "v": v, "heads": heads[order], "leaf": np.arange(HEADS)[order], "mass": leaf_mass}


def leaves(words: np.ndarray, ends: np.ndarray, known: dict) -> np.ndarray:
    out = HEADS + ends.astype(np.int64) % (CLASSES * MEMBERS - HEADS)
    if len(known["heads"]):
        at = np.minimum(np.searchsorted(known["heads"], words), len(known["heads"]) - 1)
        own = known["heads"][at] == words
        out[own] = known["leaf"][at[own]]
    return out


def _features(words: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """Hashed features of each token's history, five a token; words: hash of each token, starts: first token of each document."""
    n = len(words)
    before = []
    for k in (1, 2, 3):
        w = np.full(n, 0x5BD1E995, _U)
        if n > k:
            w[k:] = words[:-k]
        for j in range(k):
            at = starts + j
            w[at[at < np.append(starts[1:], n)]] = 0x5BD1E995
        before.append(w * _U(0x9E3779B97F4A7C15) + _U(k))
    spread = lambda x: ((x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - bits)).astype(np.int64)
    out = np.zeros((5, n), np.int64)
    out[1], out[2] = spread(before[0]), spread(before[0] * _U(31) + before[1])
    out[3], out[4] = spread(before[1] + _U(77)), spread(before[2] + _U(99))
    for i in range(5):
        out[i] += i << bits
    return out


def _softmax(z):
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _member_rows(features, classes, rows):
    """Rows of the members' weights: the constant by class, the others hashed with the class."""
    out = (features * 31 + classes * 7919) % (rows - CLASSES) + CLASSES
    out[0] = classes
    return out


def _logits(w, rows):
    z = w[rows[0]]
    for r in rows[1:]:
        z += w[r]
    return z


def steps(features, leaf_of, rows: int, every=BATCH):
    """For slices of tokens and both factors: number of the factor, rows of the features, right answers."""
    for a in range(0, len(leaf_of), every):
        f, leaf = features[:, a : a + every], leaf_of[a : a + every]
        c, m = leaf // MEMBERS, leaf % MEMBERS
        yield a, 0, f, c
        yield a, 1, _member_rows(f, c, rows), m


def add_counts(total, features, leaf_of):
    """Adds how often each feature's row is met with each answer."""
    n = total[0].shape[0]
    for _, i, rows, right in steps(features, leaf_of, n, 1 << 18):
        total[i] += np.bincount((rows * CLASSES + right).ravel(), minlength=n * CLASSES).reshape(n, CLASSES)


def add_gradient(total, weights, features, leaf_of):
    """Adds the gradient of the negative log-likelihood."""
    n = total[0].shape[0]
    sums = [np.zeros((CLASSES, n)) for _ in total]  # a class is a row here, so that adding to it goes through memory in order
    for _, i, rows, right in steps(features, leaf_of, n, 4 * BATCH):
        p = np.empty((len(right), CLASSES), np.float32)
        for a in range(0, len(right), BATCH):
            own = slice(a, a + BATCH)
            part = _softmax(_logits(weights[i], rows[:, own]))
            part[np.arange(len(part)), right[own]] -= 1
            first = int(rows[0, own].max()) + 1  # the constants' rows come first: a product
            total[i][:first] += (rows[0, own] == np.arange(first)[:, None]).astype(np.float32) @ part
            p[own] = part
        flat = rows[1:].ravel()
        for k in range(CLASSES):
            sums[i][k] += np.bincount(flat, weights=np.tile(p[:, k], len(rows) - 1), minlength=n)
    for t, s in zip(total, sums, strict=True):
        t += s.T


def first_weights(counts):
    """The constants' rows hold log shares, the others log-odds against them, drawn to 0 where a feature is rare."""
    out = []
    for i, c in enumerate(counts):
        constant = np.zeros(len(c), bool)
        constant[: 1 if i == 0 else CLASSES] = True
        share = (c[constant].sum(0) + 0.5) / (c[constant].sum() + 0.5 * c.shape[1])
        n = c.sum(1, keepdims=True)
        w = TRUST * np.log((c + DRAW * share) / ((n + DRAW) * share))
        own = (c[constant] + 0.5) / (c[constant].sum(1, keepdims=True) + 0.5 * c.shape[1])
        w[constant] = np.log(own)
        out.append(w.astype(np.float32))
    return out


def updated(weights, gradient, counts, share: float):
    """A gradient step from a ``share`` of the tokens; curvature of a weight: tokens of its row times p (1 - p)."""
    out = []
    for w, g, c in zip(weights, gradient, counts, strict=True):
        n = c.sum(1, keepdims=True)
        p = (c + 0.5) / (n + 0.5 * c.shape[1])
        out.append((w - RATE * g / (share * n * p * (1 - p) + DAMP)).astype(np.float32))
    return out


def log_likelihood(weights, tokens, starts, leaf_of, bits: int):
    """Natural logarithm of P(class) P(member | class) for each token."""
    features, out = _features(tokens, starts, bits), np.zeros(len(tokens))
    for a, i, rows, right in steps(features, leaf_of, len(weights[0])):
        z = _logits(weights[i], rows)
        z -= z.max(1, keepdims=True)
        out[a : a + len(right)] += z[np.arange(len(right)), right] - np.log(np.exp(z).sum(1))
    return out


def _chunk(row):
    """Arrays of a chunk, of the columns that it has."""
    dtypes = {"doc_ids": np.int64, "nulls": bool, "held": bool, "part": np.int16, "sizes": np.int64, "codes": np.uint32, "words": _U, "ends": np.uint16}
    return {k: unpack(row[k], d) for k, d in dtypes.items() if k in row}


BLOCK = 1024  # rows that travel together


def summed(chunks: DataFrame, known: dict, bits: int, part: int | None = None, rounds: int = 1, weights=None) -> list[np.ndarray]:
    """Over the training documents (of one part): counts of rows with answers, or with ``weights`` the gradient."""
    sent = chunks.sparkSession.sparkContext.broadcast((known, weights))  # bounded by the model's size
    rows = 5 << bits

    def run(stream):
        known, weights = sent.value
        total, touched = [np.zeros((rows, CLASSES)), np.zeros((rows, MEMBERS))], False
        with np.errstate(over="ignore"):
            for batch in stream:
                for row in batch.to_pylist():
                    c = _chunk(row)
                    mine = ~c["held"] if part is None else ~c["held"] & (c["part"] % rounds == part)
                    codes, sizes = c["codes"][np.repeat(mine, c["sizes"])], c["sizes"][mine]
                    if len(codes):
                        features = _features(c["words"][codes], np.cumsum(sizes) - sizes, bits)
                        leaf = leaves(c["words"], c["ends"], known)[codes]
                        add_counts(total, features, leaf) if weights is None else add_gradient(total, weights, features, leaf)
                        touched = True
        for i, w in enumerate(total if touched else ()):
            for b in range(0, len(w), BLOCK):
                yield pa.record_batch({"i": [i], "b": [b], "w": pa.array([w[b : b + BLOCK].astype(np.float32 if weights else np.uint32).tobytes()], pa.binary())})

    kind = np.float32 if weights else np.uint32

    def add(key, table):
        w = sum(unpack(x.as_buffer(), kind).astype(np.float64) for x in table.column("w"))
        return pa.table({"i": table.column("i")[:1], "b": table.column("b")[:1], "w": pa.array([w.tobytes()], pa.binary())})

    columns = ["held", "part", "sizes", "codes", "words", "ends"]
    parted = chunks.select(*columns).mapInArrow(run, "i long, b long, w binary")
    out = [np.zeros((rows, CLASSES)), np.zeros((rows, MEMBERS))]
    for r in parted.groupBy("i", "b").applyInArrow(add, "i long, b long, w binary").collect():
        w = unpack(r.w, np.float64).reshape(-1, out[r.i].shape[1])
        out[r.i][r.b : r.b + len(w)] = w
    sent.unpersist()
    return out


def feature_bits(tokens: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, min(WHOLE_BITS, (tokens // ROW_TOKENS).bit_length())) + (tokens // WIDE_TOKENS).bit_length() // 2)


def train(chunks: DataFrame, known: dict, rounds: int = ROUNDS, chars: int = 0) -> tuple[int, list[np.ndarray]]:
    """Bits of a feature's hash, and the weights (class rows, member rows)."""
    bits = feature_bits(known["n"])
    chunks = chunks.coalesce(max(chunks.sparkSession.sparkContext.defaultParallelism, parts(chars, TASK_CHARS << max(0, bits - WHOLE_BITS))))
    counts = summed(chunks, known, bits)
    weights = first_weights(counts)
    for part in range(rounds if known["n"] else 0):
        weights = updated(weights, summed(chunks, known, bits, part, rounds, weights), counts, 1 / rounds)
    return bits, weights


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    size = text_bytes(docs)
    chunks = written(encode(docs), "lm-chunks")
    buckets = parts(size, BUCKET_BYTES)
    replies = written(exchange(chunks, buckets), "lm-counts")
    known = summarise(replies.filter("chunk is null"), buckets)
    bits, weights = train(chunks, known, rounds, size)
    sent = docs.sparkSession.sparkContext.broadcast((known, weights))

    def run(key, left, right):
        known, weights = sent.value
        c = _chunk(left.to_pylist()[0])
        total = np.zeros(len(c["words"]), np.int64)
        for places, totals in zip(right.column("places"), right.column("totals"), strict=True):
            total[unpack(places.as_buffer(), np.int32)] = unpack(totals.as_buffer(), np.int64)
        codes, sizes = c["codes"], c["sizes"]
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has its end
        n, v = known["n"], known["v"]
        base = np.log10((total + ADD) / (n + ADD * (v + 1)))
        leaf = leaves(c["words"], c["ends"], known)
        within = np.where(leaf < HEADS, 0.0, np.log10((total + ADD) / np.maximum(known["mass"][leaf], ADD)))
        with np.errstate(over="ignore"):
            model = log_likelihood(weights, c["words"][codes], starts, leaf[codes], bits) / math.log(10) + within[codes]
        ids = pa.array(c["doc_ids"], mask=c["nulls"])
        return pa.table({
            "doc_id": ids, "held_out": pa.array(c["held"]), "n_tokens": pa.array(sizes), "n_known": pa.array(add((total > 0)[codes].astype(np.int64))),
            "train_tokens": pa.array(np.full(len(ids), n)), "base_score": pa.array(add(base[codes])), "score": pa.array(add(model)),
        })

    own = chunks.drop("counts").groupBy("chunk").cogroup(replies.filter("chunk is not null").select("chunk", "places", "totals").groupBy("chunk"))
    return own.applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: scores all ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
