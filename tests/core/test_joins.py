"""Joins, matches, folds and ranks against plain Python or the product of both sides."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import evaluate, fold, locate, ranks, tree

INDEX = "doc_id long, page_index int, line_idx int, part int, k string, toks array<string>, text string, font string, y double, top double, size double, rel double, running boolean"
WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "winds", "rivers", "mountain", "chapter", "a1", "it"]


@pytest.mark.parametrize("seed", range(3))
def test_similar_pairs_equal_the_product(spark, seed):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice(WORDS[: 12 if seed else 5]) for _ in range(r.randint(0, n)))
    entries = [(d, i, some(6), i + 1, False) for d in range(4) for i in range(12)]
    index = [(d, p * 70, i, 0, k, [w for w in k.split() if len(w) > 2], k, "b", 1.0, 1.0, 10.0, 0.5, False) for d in range(1, 5) for p in range(3) for i in range(15) if (k := some(9))]
    e = spark.createDataFrame(entries, "doc_id long, entry_idx int, title string, printed int, roman boolean")
    ix = spark.createDataFrame(index, INDEX)
    columns = ["doc_id", "entry_idx", "page_index", "line_idx", "part", "sim"]
    keyed = e.select("doc_id", "entry_idx", T.title_key(F.col("title")).alias("e_k"), T.tokens(F.col("title")).alias("e_toks"))
    want = keyed.join(ix, "doc_id").withColumn("sim", locate.similarity(F.col("e_k"), F.col("e_toks"), F.col("k"), F.col("toks"))).filter("sim >= 0.6").select(columns)
    got = locate.similar_pairs(e, ix).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def test_no_pair_of_common_tokens_is_proposed(spark):
    # every line has "the" and "and"; only the line with the rare words is met
    lines = [(1, 0, i, 0, "the and line", ["the", "and", "line"], "", "b", 1.0, 1.0, 10.0, 0.5, False) for i in range(50)] + [(1, 1, 0, 0, "of rare winds and the", ["rare", "winds", "and", "the"], "", "b", 1.0, 1.0, 10.0, 0.5, False)]
    ix = spark.createDataFrame(lines, INDEX)
    e = spark.createDataFrame([(1, 0, ["rare", "winds", "and", "the"], "rare winds and the")], "doc_id long, entry_idx int, e_toks array<string>, e_k string")
    first = locate.rare_tokens(e, ix.select("doc_id", F.explode("toks").alias("t")))
    assert {r.t for r in first.collect()} == {"rare", "winds"}


def sequential(found, truth, key):
    used, out = set(), []
    def same(a, b):
        short, long_ = sorted((a, b), key=len)
        return a == b != "" or len(short) >= 8 and long_.startswith(short)

    for seq, title, page in found:
        for tseq, ttitle, tpage in truth:
            if tseq not in used and abs(page - (tpage - 1)) <= 1 and same(key[title], key[ttitle]):
                used.add(tseq)
                out.append((seq, tseq))
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_equals_the_sequential_fold(spark, seed):
    r = random.Random(seed)
    titles = ["Introduction", "Introduction to winds", "Introduction to winds and rain", "Methods", "Methods", "A", "chapter one", "chapter two", "chapter one, part two"]
    docs = {d: ([(i, r.choice(titles), r.randint(0, 4)) for i in range(30)], [(i, r.choice(titles), r.randint(1, 5)) for i in range(30)]) for d in range(6)}
    rows = lambda k: [(d, *x) for d, v in docs.items() for x in v[k]]
    found = spark.createDataFrame(rows(0), "doc_id long, seq int, title string, page_index int")
    truth = spark.createDataFrame(rows(1), "doc_id long, seq int, title string, page int").withColumn("level", F.lit(1))
    keys = {r.t: r.k for r in spark.createDataFrame([(t,) for t in titles], "t string").select("t", T.truth_key(F.col("t")).alias("k")).collect()}
    got = sorted(tuple(x) for x in evaluate.greedy_match(found, truth).select("doc_id", "seq", "truth_seq").collect())
    assert got == sorted((d, *p) for d, v in docs.items() for p in sequential(*v, keys))


def test_folds_keep_groups_whole_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i % 13 if i % 13 else None, i) for i in range(1000)]
        df = spark.createDataFrame(rows, "k long, v long")
        sums = fold.fold(df, ["k"], lambda g: [{"k": g[0]["k"], "n": len(g), "v": sum(r["v"] for r in g)}], "k long, n long, v long").collect()
        want = {}
        for k, v in rows:
            want.setdefault(k, []).append(v)
        assert {r.k: (r.n, r.v) for r in sums} == {k: (len(v), sum(v)) for k, v in want.items()} and len(sums) == len(want)
        first = fold.fold(df, ["k"], lambda g: [next(g)], "k long, v long", [F.desc("v")], lazily=True).collect()
        assert {r.k: r.v for r in first} == {k: max(v) for k, v in want.items()} and len(first) == len(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert fold.fold(df.limit(0), ["k"], lambda g: g, "k long, v long").count() == 0


def test_ranks_and_medians(spark):
    r = random.Random(5)
    values = [r.choice([0.0, 0.5, r.random(), r.random() * 1e-12, -3.0]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(5)
    ordered = sorted((v, i) for i, v in enumerate(values))
    ranked = {x.i: x["rank"] for x in ranks.global_rank(df, ["v", "i"], partitions=6).collect()}
    assert ranked == {i: n for n, (_, i) in enumerate(ordered)}
    for k in (0, 1, 1500, 2999):
        assert ranks.value_at(df, "v", k, ranges=8) == ordered[k][0]
    assert ranks.value_at(df, "v", 3000) is None and ranks.upper_median_of(df.limit(0), "v") is None
    assert ranks.upper_median_of(df, "v") == ordered[1500][0]
    groups = ranks.upper_medians(df.withColumn("g", F.col("i") % 7), ["g"], F.col("v")).collect()
    assert {x.g: x["median"] for x in groups} == {g: sorted(values[g::7])[len(values[g::7]) // 2] for g in range(7)}
    assert {x.i for x in tree.systematic_sample(df, ["v", "i"], 9).collect()} == {i for _, i in ordered[::9]}


def test_entries_of_one_key_meet_lines_once_and_places_are_the_best(spark):
    r = random.Random(7)
    entries = [(1, i, r.choice(["Rivers", "Alpha beta gamma", "Beta winds of delta"]), r.choice([None, r.randint(1, 120)]), False) for i in range(40)]
    e = spark.createDataFrame(entries, "doc_id long, entry_idx int, title string, printed int, roman boolean")
    texts = [["rivers", "rivers of winds", "alpha beta gamma", "beta winds of delta", "alpha beta"][r.randint(0, 4)] for _ in range(360)]
    index = [(1, i // 3, i % 3, 0, k, [], k, "b", 1.0, 1.0, r.choice([8.0, 10.0, 12.0]), 0.5, r.random() < 0.2) for i, k in enumerate(texts)]
    ix = spark.createDataFrame(index, INDEX)
    keyed = locate.entry_keys(e)
    pairs = locate.similar_keys(keyed, ix.select("doc_id", "page_index", "line_idx", "part", "k", "running", "size", "rel", "top"))
    assert pairs.groupBy("e_id", "page_index", "line_idx", "part").count().filter("count > 1").count() == 0 and pairs.select("e_id").distinct().count() == 3
    styles, offsets = spark.createDataFrame([(1, 10.0)], "doc_id long, body_size double"), spark.createDataFrame([(1, 2)], "doc_id long, offset int")
    got = {(x.entry_idx, x.cand_idx): (x.page_index, round(x.score, 6)) for x in locate.placements(pairs, keyed, styles, offsets, ix).collect()}
    best = {}
    for x in locate.similar_pairs(e, ix).collect():
        away = None if x.printed is None else abs(x.page_index - (x.printed - 1 + 2))
        score = x.sim * 10 - 7 * x.running + (2.5 if x["size"] >= 11.5 else -2.0 if x["size"] < 8.5 else 0.0)
        score += 0.0 if away is None else 6.0 if away == 0 else 4.0 if away == 1 else 1.5 if away <= 3 else -3.0 if away > 12 else 0.0
        best.setdefault(x.entry_idx, {}).setdefault(x.page_index, []).append(round(score, 6))
    want = {(i, n): (p, -s) for i, pages in best.items() for n, (s, p) in enumerate(sorted((-max(v), p) for p, v in pages.items())[:8])}
    assert got == want and len(got) == 320


@pytest.mark.parametrize("seed", range(2))
def test_surest_pairs_equal_the_product(spark, seed):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice(WORDS[: 5 if seed else 12] + ["mountainous winds of the north"]) for _ in range(r.randint(0, n)))
    entries = [(1, i, some(6), i + 1, False) for i in range(40)]
    index = [(1, p, i, 0, k, [w for w in k.split() if len(w) > 2], k, "b", 1.0, 1.0, 10.0, 0.5, False) for p in range(4) for i in range(15) if (k := some(6))]
    index += [(1, 9, i, 0, f"{t} and on", [w for w in f"{t} and on".split() if len(w) > 2], t, "b", 1.0, 1.0, 10.0, 0.5, False) for _, i, t, _, _ in entries if t]
    e = spark.createDataFrame(entries, "doc_id long, entry_idx int, title string, printed int, roman boolean")
    ix = spark.createDataFrame(index, INDEX)
    columns = ["doc_id", "entry_idx", "page_index", "line_idx", "part", "sim"]
    keyed = e.select("doc_id", "entry_idx", T.title_key(F.col("title")).alias("e_k"), T.tokens(F.col("title")).alias("e_toks"))
    want = keyed.join(ix, "doc_id").withColumn("sim", locate.similarity(F.col("e_k"), F.col("e_toks"), F.col("k"), F.col("toks"))).filter(F.col("sim") >= locate.SUREST).select(columns)
    own = locate.entry_keys(e)
    got = locate.similar_keys(own, ix, locate.SUREST).join(own.drop("doc_id"), "e_id").select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 30


def test_fewer_words_of_entries_are_asked_for_where_more_have_to_be_shared(spark):
    e = spark.createDataFrame([(1, 0, ["ice", "winds", "and", "the", "sea"]), (1, 1, ["sea", "sea", "sea"])], "doc_id long, entry_idx int, e_toks array<string>")
    words = spark.createDataFrame([(1, t, n) for n, t in enumerate(["ice", "winds", "sea", "and", "the"], 1)], "doc_id long, t string, lines long")
    asked = lambda **more: sorted((r.entry_idx, r.t) for r in locate.rare_tokens(e, words, **more).collect())
    assert asked() == [(0, "ice"), (0, "sea"), (0, "winds"), (1, "sea")] and asked(once=0.9) == [(0, "ice"), (1, "sea")]
