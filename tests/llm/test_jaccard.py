import random

import numpy as np
import pytest

from folioscope.llm import jaccard_join as J


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    return out


def brute(rows):
    sets, parent = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def varied(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "é", "the", "of"]) + str(rng.randrange(60))
    rows, base = [(None, "k l m n"), (7, "k l m n"), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two")], []
    for i in range(n):
        if base and rng.random() < 0.7:
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w += [word() for _ in range(rng.randrange(1 + len(w) // 9))]
        else:
            w = [word() for _ in range(rng.choice([9, 12, 20, 40, 90, 300]))]
        base.append(w)
        rows.append((100 + i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(600):
        n = int(rng.choice([9, 10, 13, 19, 25, 60, 200, 1000]))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        both = int(np.ceil(0.9 * n)) if rng.random() < 0.5 else int(rng.integers(np.ceil(0.9 * n), n + 1))
        extra = rng.integers(0, 1 + max(0, int(both / 0.9) - n))
        b = np.unique(np.concatenate([rng.permutation(a)[:both], rng.integers(0, 2**64, int(extra), np.uint64)]))
        i = len(np.intersect1d(a, b))
        if 100 * i >= 90 * (len(a) + len(b) - i) and i < max(len(a), len(b)):
            words = J.bitmaps([a, b]).view(np.uint64).reshape(2, -1)
            assert 190 * int(np.bitwise_count(words[0] ^ words[1]).sum()) <= 10 * (len(a) + len(b))
            with np.errstate(over="ignore"):
                flat, count = J.signatures([a, b])
            assert set(flat[: count[0]].tolist()) & set(flat[count[0] :].tolist())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, docs, seed):
    rows = varied(seed, 260)
    got = J.link(docs(rows).repartition(3))[0].select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_large_group_of_near_copies_and_empty_table(spark, docs):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = J.link(docs(rows))[0].select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert J.link(docs([]))[0].count() == 0


def test_sets_travel_only_for_pairs_that_bitmaps_leave(spark, docs, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:120] + [f"x{k}-{i}" for i in range(80)])) for k in range(6)] + [(9, " ".join(base[:120] + [f"x1-{i}" for i in range(79)]))]
    checked, verified = [], J.verified
    monkeypatch.setattr(J, "verified", lambda docs, pairs, *more: checked.append(pairs.count()) or verified(docs, pairs, *more))
    for counted in (False, True):
        got = J.link(docs(rows), 5, 80, counted)[0].select("doc_id", "component_id").collect()
        assert sorted(map(tuple, got)) == [(k, k) for k in range(6)] + [(9, 1)]
    base = [f"w{i}" for i in range(6000)]
    rows = [(k, " ".join(base[:3600] + [f"x{k}-{i}" for i in range(2400 + k)])) for k in range(3)]  # large sets: 1,024 places say nothing
    got = J.link(docs(rows), 5, 80, True)[0].select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 1), (2, 2)]
    assert max(checked) == 1  # before, a set was sent to each text that shares a stretch with it


def test_wide_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(5)
    for n in (1025, 1600, 5000, 70_000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        for share in (1.0, 0.9, 0.7):
            b = np.unique(np.concatenate([a[: int(share * n)], rng.integers(0, 2**64, n // 4, np.uint64)]))
            x, y = (np.frombuffer(J.wide_bitmap(s) or bytes(128), np.uint8) for s in (a, b))
            if len(b) > J.BITMAP:
                assert J.differing(x, y) == J.differing(y, x) <= len(np.setxor1d(a, b))
