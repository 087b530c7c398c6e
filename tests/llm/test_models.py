"""Operators that SQL can't express: against brute force, exact properties or held-out accuracy."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chroma, maxent_lm, toxicity, vamana

ODD = [(None, "no id here"), (2, None), (3, ""), (4, "Same text twice"), (4, "Same text twice"), (5, "x" * 40_000), (6, "long " * 20_000), (11, "a \0end b"), (12, "a b")]


def test_language_model(spark, docs):
    rng = random.Random(1)
    rows = ODD + [(100 + i, " ".join(f"{rng.choice('abc')}{(k := (3 * j + i % 5) % 11)}" for j in range(60))) for i in range(60)]
    got = maxent_lm.score(docs(rows)).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\0"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    counts = collections.Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), held(d), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 4)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got) and maxent_lm.score(docs([])).count() == 0
    mean = lambda column: sum(r[column] for r in got if r.held_out and r.doc_id >= 100)
    assert mean("score") > mean("base_score")  # what follows what is learned
    again = maxent_lm.score(docs(rows[::-1]).repartition(12)).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score)
    assert np.allclose([r.score for r in sorted(got, key=key)], [r.score for r in sorted(again, key=key)], atol=1e-3)


def test_softmax_factors_are_distributions():
    rng, bits = np.random.default_rng(1), 9
    weights = [rng.normal(size=(5 << bits, k)).astype(np.float32) for k in (maxent_lm.CLASSES, maxent_lm.MEMBERS)]
    n = maxent_lm.CLASSES * maxent_lm.MEMBERS
    with np.errstate(over="ignore"):
        total = sum(np.exp(maxent_lm.log_likelihood(weights, np.arange(5, dtype=np.uint64), np.array([0, 3]), np.full(5, leaf), bits)) for leaf in range(n))
    assert np.allclose(total, 1, atol=1e-3)


def test_gradient_equals_differences_of_the_likelihood():
    rng, bits = np.random.default_rng(2), 8
    weights = [rng.normal(size=(5 << bits, k)).astype(np.float32) for k in (maxent_lm.CLASSES, maxent_lm.MEMBERS)]
    tokens, starts, leaf = rng.integers(0, 9, 40, np.uint64), np.array([0, 15]), rng.integers(0, 256, 40)
    with np.errstate(over="ignore"):
        gradient = [np.zeros(w.shape) for w in weights]
        maxent_lm.add_gradient(gradient, weights, maxent_lm._features(tokens, starts, bits), leaf)
        for i in (0, 1):
            for at in np.argwhere(np.abs(gradient[i]) > 0.1)[::97]:
                ends = []
                for d in (0.01, -0.01):
                    moved = [w.astype(np.float64) for w in weights]
                    moved[i][tuple(at)] += d
                    ends.append(-maxent_lm.log_likelihood(moved, tokens, starts, leaf, bits).sum())
                assert abs((ends[0] - ends[1]) / 0.02 - gradient[i][tuple(at)]) < 1e-3


def test_toxicity_on_held_out_rows(spark, docs):
    rng = random.Random(2)
    bad = ["scumbag", "moron", "lowlife", "idiotic", "worthless"]
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    usual = [word() for _ in range(200)]
    rows, labels = list(ODD), []
    for i in range(100, 500):
        toxic = rng.random() < 0.3
        text = [rng.choice(usual) for _ in range(60)]
        for _ in range(3 * toxic):
            text[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(toxic)))
    frame, truth = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(frame, toxicity.fit(frame, truth), ["doc_id"]).collect()
    kind, seen = {d: t for d, _, t in labels}, {r.doc_id: r.predicted for r in got}
    fresh = [d for d in kind if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(seen[d] == kind[d] for d in fresh) >= 0.95 * len(fresh)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    again = toxicity.score(frame, toxicity.fit(frame.repartition(7), truth.union(truth)), ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in got)
    odd = spark.createDataFrame([(100, None, None), (None, 1, 1), (101, 1, 0), (101, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(frame, toxicity.fit(frame, odd), ["doc_id"]).count() == len(rows)
    assert toxicity.score(docs([]), toxicity.fit(docs([]), truth), ["doc_id"]).count() == 0
    none = toxicity.fit(frame, truth.limit(0))
    assert {r.score for r in toxicity.score(frame, none, ["doc_id"]).collect()} == {0.0}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype("f4")
    x[200:500] = x[200]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] * 16), (None, [1.0] * 16), (2100, [1.0, 2.0]), (7, x[7].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vamana.nearest(frame, frame.filter("vec_id % 100 = 0"), shard_rows=400).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    y, hit = x.astype("f8"), 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hit += len(set(want) & {i for i, _ in found[q]})
        assert all(abs(s - d[i]) < 1e-9 for i, s in found[q]) and [s for _, s in found[q]] == sorted(s for _, s in found[q])
    assert hit >= 0.9 * 150 and set(found) == set(range(0, 1500, 100)) and [i for i, _ in found[300]] == list(range(200, 210))
    assert vamana.nearest(frame.limit(0), frame.limit(0)).count() == 0


def tune(rng, seconds):
    """Chords that change after a tenth to half a second."""
    out = []
    while sum(map(len, out)) < seconds * chroma.RATE:
        t = np.arange(int(rng.integers(1000, 5000))) / chroma.RATE
        out.append(sum(np.sin(2 * np.pi * f * t) for f in rng.choice(220 * 2 ** (np.arange(36) / 12), 2)) / 2)
    return np.concatenate(out)[: int(seconds * chroma.RATE)]


def pcm(x):
    return np.clip(128 + 80 * x, 0, 255).astype(np.uint8)


def noisy(rng, x, decibel):
    return x + rng.normal(0, np.sqrt(np.mean(x**2) / 10 ** (decibel / 10)), len(x))


def media(spark, rows):
    return spark.createDataFrame([(i, None if x is None else bytearray(x.tobytes())) for i, x in rows], "doc_id long, audio binary").withColumn("v", F.lit("clash"))


def best_of_all_offsets(a, b):
    """Evidence of the best stretch over all offsets, by the definition."""
    most = 0.0
    for offset in range(-len(a) + 1, len(b)):
        x, y = a[max(0, -offset) :], b[max(0, offset) :]
        held = 0.0
        for p, q in zip(x.tolist(), y.tolist(), strict=False):
            held = max(0.0, held + 32 * chroma.MAX_ERROR - (p ^ q).bit_count())
            most = max(most, held)
    return most


def test_recordings_meet_as_brute_force_over_all_pairs_and_offsets_says(spark):
    rng = np.random.default_rng(4)
    tunes = [tune(rng, 4) for _ in range(24)]
    rows = [(20 * i, pcm(x)) for i, x in enumerate(tunes)]
    for i, x in enumerate(tunes):
        cut = int(rng.integers(0, chroma.HOP))
        rows += [(1000 + i, pcm(noisy(rng, x[cut:], 10))), (2001 + 20 * i, pcm(noisy(rng, x[chroma.HOP * 20 + cut :], 20)))]
    rows.append((3001, pcm(np.concatenate([tune(rng, 3), tunes[0], tune(rng, 3)]))))  # shares a passage
    classes = [(i, p) for (i, _), p in zip(rows, chroma.fingerprints([x for _, x in rows]), strict=True)]
    least = 32 * chroma.MAX_ERROR * chroma.LEAST * (1 - 1e-9)
    want = {(q, i) for q, a in classes if q % 20 == 0 for i, b in classes if i != q and best_of_all_offsets(a, b) >= least}
    planted = {(20 * i, k) for i in range(24) for k in (1000 + i, 2001 + 20 * i)} | {(0, 3001)}
    assert planted <= want
    out, links = chroma.align(media(spark, rows).repartition(5))
    got = {(r["query"], r["class"]) for r in links.collect()}
    assert got <= want and len(got & want) >= 0.9 * len(want) and len(got & planted) >= 0.95 * len(planted)
    row = {r.doc_id: r for r in out.collect()}
    assert row[1003].best_id == 60 and row[1003].component_id <= 60 and row[3001].best_id == 0


def test_audio_of_odd_kinds(spark):
    rng = np.random.default_rng(5)
    a, b = pcm(tune(rng, 6)), pcm(tune(rng, 6))
    part = a[chroma.HOP * 40 : chroma.HOP * 110]
    rows = [(20, a), (21, a), (3, part), (5, b), (7, None), (8, b[:0]), (None, b[:300]), (9, b[:300]), (40, np.tile(b, 40))]
    out, links = chroma.align(media(spark, rows))
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert len(got) == 8 and (got[3].best_id, got[3].best_offset, got[3].best_error) == (20, -40, 0.0)
    assert got[20].class_id == got[21].class_id == 20 and {got[i].component_id for i in (3, 20, 21)} == {3} and got[7].class_id == got[8].class_id == 7
    assert got[5].best_id == 40 and got[9].n_links == 0 and got[9].class_id == 9 and got[40].n_prints > 6000 // 2
    assert chroma.align(media(spark, rows).limit(0))[0].count() == 0


def test_a_group_that_shares_its_keys_is_joined_by_representative(spark):
    rng = np.random.default_rng(6)
    base = pcm(tune(rng, 5))
    rows = []
    for i in range(90):
        x = base.copy()
        x[30_000:] = pcm(tune(rng, 5))[30_000:]  # the same beginning, ends of their own
        rows.append((i, x))
    out, links = chroma.align(media(spark, rows), limit=8)
    assert {r.component_id for r in out.collect()} == {0} and links.count() < 5 * 90


def test_a_crowd_has_all_links_whatever_the_limit(spark):
    rng = np.random.default_rng(7)
    base, rows = pcm(tune(rng, 5)), []
    for i in range(45):
        x = base.copy()
        x[30_000:] = pcm(tune(rng, 5))[30_000:]
        rows.append((i, x))
    few, many = ({(r["query"], r["class"], r["offset"]) for r in chroma.align(media(spark, rows), limit=k)[1].collect()} for k in (8, 1000))
    assert few == many == {(q, v, 0) for q in (0, 20, 40) for v in range(45) if q != v}


@pytest.mark.parametrize("limit", [0, 1, 1000])
def test_all_places_of_a_key_count(spark, limit):
    rng = np.random.default_rng(8)
    some = lambda n: rng.integers(0, 1 << 32, n, np.uint32)
    passage = some(12)
    query = np.concatenate([some(20), passage, some(20)])
    thrice = np.concatenate([some(5), passage, some(30), passage, some(9), passage, some(3)])
    held, short = np.concatenate([some(4), np.full(50, 7, np.uint32), some(6)]), np.concatenate([some(7), np.full(20, 7, np.uint32), some(2)])
    rows = [(i, len(p), q, p.astype("<u4").tobytes()) for i, (p, q) in enumerate([(query, 0), (thrice, None), (held, 20), (short, None)])]
    classes = spark.createDataFrame(rows, "v long, n long, q long, prints binary")
    met, crowded = chroma.candidates(chroma.postings(classes, np.zeros(chroma.CELLS, bool)), limit)
    got = {(r.q, r.v, r.vp - r.qp) for r in met.collect()} | {tuple(r) for r in crowded.collect()}
    assert {(0, 1, o) for o in (5 - 20, 47 - 20, 68 - 20)} <= got
    # four equal integers begin at places 4 to 50 of the held one, and at winnowed places 10 to 23 of the short one
    assert {(2, 3, o) for o in range(10 - 50, 23 - 4 + 1)} <= got
