import random

import corpus_pipeline as P


def sets_of(texts, size=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def components(texts):
    """Number of the component of each text at similarity 0.8; an empty text is its own."""
    sets, parent = sets_of(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def copies(seed, n):
    rng, base, texts = random.Random(seed), [], []
    word = lambda: f"w{rng.randrange(400)}"
    for _ in range(n):
        if base and rng.random() < 0.7:
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, len(w) // 45])):
                w[rng.randrange(len(w))] = word()
            w += [word() for _ in range(rng.choice([0, 0, len(w) // 8, len(w) // 5, len(w) // 4]))]
        else:
            w = [word() for _ in range(rng.choice([3, 9, 20, 60, 150, 400]))]
        base.append(w)
        texts.append(" ".join(w))
    return texts


def test_near_duplicates_equal_brute_force_at_the_stage_thresholds(spark, docs):
    texts = [*copies(1, 220), None, "", " one ", "ONE"]
    least = {}
    for i, c in enumerate(components(texts)):
        least.setdefault(c, i)
    got = P.near_duplicates_out(spark, docs(list(enumerate(texts))).repartition(3), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(least.values())
    assert P.near_duplicates_out(spark, docs([]), "").count() == 0


def test_copies_between_the_thresholds_of_op6_and_the_stage_go(spark, docs):
    base = [f"w{i}" for i in range(200)]
    longer, changed, other = [*base, *[f"x{i}" for i in range(40)]], list(base), [*base, *[f"y{i}" for i in range(60)]]
    for i in (20, 60, 100, 140):
        changed[i] = "z"
    got = P.near_duplicates_out(spark, docs([(i, " ".join(w)) for i, w in enumerate((base, longer, changed, other))]), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 3]


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark, docs):
    words = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [
        (None, None), (None, ""), (None, words("a")), (None, words("a") + " more"), (None, words("b")), (3, words("b") + " more"), (3, words("c")), (3, words("d")),
        (3, words("d")), (4, words("d") + " more"), (5, " "), (5, None), (6, words("e")), (7, words("e")), (None, words("f")), (None, words("f")),
    ]
    got = sorted((str(r.doc_id), " ".join((r.text or "").split())) for r in P.near_duplicates_out(spark, docs(rows).repartition(3), "").collect())
    a = [x for x in got if x[1].startswith("a0")]
    assert len(a) == 1 and a[0][0] == "None"
    want = [("3", words("b") + " more"), ("3", words("c")), ("3", words("d")), ("5", ""), ("6", words("e")), ("None", ""), ("None", ""), ("None", words("f"))]
    assert [x for x in got if x not in a] == sorted(want)


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, label int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_all_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    usual = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(usual) for _ in range(40)]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(40)] = rng.choice(["scumbag", "moron", "lowlife", "worthless"])
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0, "clash", i))
        labels.append((i, 0, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + k, clean[0][1], "en", "s0", 0, None, None) for k in range(200)]  # a large group of copies
    rows += [(None, None, None, None, None, None, None), (None, "", None, None, None, None, None), (None, "no id and no source at all", None, None, 5, None, None), (2000, " \n", "en", "s1", 3, None, None)]
    rows += [(2001, "word " * 30_000, "en", "s2", 150_000, "long", 1), (2002, clean[1][1], "en", "s1", 0, None, None), (2002, clean[1][1], "en", "s1", 0, None, None)]
    tables(spark, str(tmp_path), rows, labels)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = [r.doc_id for r in kept["toxicity"] if r.doc_id is not None and r.doc_id < 400]
    assert sum(i % 4 == 0 for i in ids) <= 5 and sum(i % 4 > 0 for i in ids) >= 295  # nearly all toxic rows go, nearly all others stay
    texts = [r.text for r in kept["toxicity"]]
    groups = components(texts)
    some = {g for g, t in zip(groups, texts, strict=True) if (t or "").strip()}
    once = [r for r in kept["near_duplicates"] if (r.text or "").strip()]
    assert len(once) == len(some) and len({r.text for r in once}) == len(once)
    given = {r.text: len((r.text or "").split()) for r in kept["near_duplicates"]}
    mixed = kept["mixing"]
    assert sum(len(r.text.split()) for r in mixed) <= 3 * sum(given.values()) and all(any(t and t.startswith(r.text[:30]) for t in given) for r in mixed)
    pieces = P.run(spark, str(tmp_path)).collect()
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for k, own in by.items():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and (sum(n for _, n in own) == 2048 or k == len(by) - 1)


def test_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [], [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_columns_named_like_those_of_the_stages(spark, tmp_path):
    names = "score predicted held_out half toxic features _id _s _n _r _set _many label set n_shingles count column_0 column_3 size target taken source_size c0 c1 _f".split()
    usual = ["river stone under the old bridge near the mill", "three clouds over a harbour town in late winter", "a moron and a scumbag met one lowlife"]
    rows = [(i, usual[i % 3] + f" number {i % 40} of many words", "en", f"s{i % 2}", 9, *[f"{n}-{i}" for n in names]) for i in range(120)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 3 == 2)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}")
        found = docs.collect()
        assert found and all(r[n] == f"{n}-{r.doc_id}" for r in found for n in names)
    assert P.packed(spark, docs, str(tmp_path)).count() > 0


def test_near_duplicates_meet_by_partition_of_the_universe(spark, docs):
    """What brings sets together are the signatures of op6's segments, and pairs that share rare shingles alone are not compared."""
    from folioscope.llm import jaccard_join as J

    texts = copies(4, 60)
    seen = J.met(docs(list(enumerate(texts))).repartition(3), P.SHINGLE, P.PERCENT).collect()
    sets = {J.fingerprint(x): x for x in (J.shingles(t, P.SHINGLE) for t in texts)}
    flat, count = J.signatures(list(sets.values()), P.PERCENT)
    owner, of = [v for v, n in zip(sets, count, strict=True) for _ in range(n)], {}
    for v, s in zip(owner, flat.tolist(), strict=True):
        of.setdefault(s, set()).add(v)
    together = {frozenset((a, b)) for own in of.values() for a in own for b in own if a != b}
    by = {}
    for r in seen:
        by.setdefault(r.s, set()).add(r.v)
        assert r.n == len(sets[r.v])
    assert together and {frozenset((a, b)) for own in by.values() for a in own for b in own if a != b} == together
