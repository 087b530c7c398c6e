"""The distributed language model against one plain process that goes through the tokens one by one."""

import collections
import math
import random
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import maxent_lm as lm

M64 = (1 << 64) - 1


def features(history, bits):
    before = [(w * 0x9E3779B97F4A7C15 + k) & M64 for k, w in enumerate(history, 1)]
    spread = lambda x: (((x & M64) ^ ((x & M64) >> 29)) * 0xBF58476D1CE4E5B9 & M64) >> (64 - bits)
    hashed = [0, spread(before[0]), spread(before[0] * 31 + before[1]), spread(before[1] + 77), spread(before[2] + 99)]
    return [i << bits | h for i, h in enumerate(hashed)]


def plain_scores(docs, bits):
    """docs: id, text, number of the part. Scores by the description of the module."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    texts = [[*(t or "").encode().lower().split(), None] for _, t, _ in docs]
    code = lambda w: lm.END if w is None else xxhash.xxh3_64_intdigest(w)
    counts = collections.Counter(w for (d, _, _), t in zip(docs, texts, strict=True) if not held(d) for w in t)
    heads = sorted(counts, key=lambda w: (-counts[w], code(w)))[: lm.HEADS]
    rest = lm.CLASSES * lm.MEMBERS - lm.HEADS
    ending = lambda w: 0 if w is None else xxhash.xxh32_intdigest(w[-2:]) & 0xFFFF
    leaf = lambda w: heads.index(w) if w in heads else lm.HEADS + ending(w) % rest
    mass = collections.defaultdict(lambda: lm.ADD)
    for w in counts:
        if w not in heads:
            mass[leaf(w)] += counts[w] + lm.ADD
    n_rows = 5 << bits
    seen = []  # per document: for each token its rows in both factors, answers
    for t in texts:
        codes, out = [code(w) for w in t], []
        for i, w in enumerate(t):
            f = features([codes[i - k] if i >= k else 0x5BD1E995 for k in (1, 2, 3)], bits)
            c, m = divmod(leaf(w), lm.MEMBERS)
            out.append(((f, c), ([c] + [(x * 31 + c * 7919) % (n_rows - lm.CLASSES) + lm.CLASSES for x in f[1:]], m)))
        seen.append(out)
    table = [np.zeros((n_rows, 16)) for _ in (0, 1)]
    training = [(s, p) for (d, _, p), s in zip(docs, seen, strict=True) if not held(d)]
    for s, _ in training:
        for token in s:
            for i, (rows, right) in enumerate(token):
                for r in rows:
                    table[i][r, right] += 1
    weights = []
    for i, c in enumerate(table):
        constant = range(1 if i == 0 else 16)
        share = (c[constant].sum(0) + 0.5) / (c[constant].sum() + 8)
        w = np.array([np.log((row[None] + 0.5) / (row.sum() + 8))[0] if r in constant else lm.TRUST * np.log((row + lm.DRAW * share) / ((row.sum() + lm.DRAW) * share)) for r, row in enumerate(c)])
        weights.append(w)

    def chances(token):
        for i, (rows, right) in enumerate(token):
            z = np.exp(sum(weights[i][r] for r in rows))
            yield i, rows, right, z / z.sum()

    for part in range(lm.ROUNDS):
        gradient = [np.zeros((n_rows, 16)) for _ in (0, 1)]
        for s, p in training:
            for token in s if p % lm.ROUNDS == part else ():
                for i, rows, right, z in chances(token):
                    for r in rows:
                        gradient[i][r] += z
                        gradient[i][r, right] -= 1
        for i, c in enumerate(table):
            n = c.sum(1, keepdims=True)
            p = (c + 0.5) / (n + 8)
            weights[i] = weights[i] - lm.RATE * gradient[i] / (n * p * (1 - p) / lm.ROUNDS + lm.DAMP)
    within = lambda w: 0.0 if w in heads else math.log10((counts[w] + lm.ADD) / mass[leaf(w)])
    return [sum(math.log10(z[right]) for token in s for _, _, right, z in chances(token)) + sum(map(within, t)) for s, t in zip(seen, texts, strict=True)]


def test_scores_equal_those_of_one_plain_process(spark, docs):
    r = random.Random(3)
    usual = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choice(usual[: 20 if r.random() < 0.7 else 400]) for _ in range(r.randrange(60)))) for i in range(70)]
    rows += [(None, "no id"), (500, None), (501, ""), (3, "again the same id"), (502, "Unseen words alone")]
    table = docs(rows).repartition(5)
    known = table.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 15)).alias("p")).collect()
    got = sorted(((str(x.doc_id), x.n_tokens, round(x.base_score, 6)), x.score) for x in lm.score(table).collect())
    bits = lm.feature_bits(lm.score(table).first().train_tokens)
    want = plain_scores([tuple(x) for x in known], bits)
    by_id = sorted((str(d), s) for (d, _, _), s in zip(known, want, strict=True))
    assert np.allclose(sorted(s for _, s in got), sorted(want), atol=2e-3)
    assert np.allclose([s for (d, *_), s in got if d not in ("3",)], [s for d, s in by_id if d not in ("3",)], atol=2e-3)


def test_rows_grow_with_the_training_tokens():
    bits = [lm.feature_bits(1 << k) for k in range(10, 60)]
    assert bits == sorted(bits) and lm.feature_bits(4_000_000) == 14
    assert lm.feature_bits(1 << 33) == 17 and lm.feature_bits(1 << 27) == 14
