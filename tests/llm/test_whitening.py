import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, size string, x string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c", "d") for i, v in rows], schema)


def run(spark, rows, schema=SCHEMA, components=4):
    vectors = whitening.whole_numbers(table(spark, rows, schema).repartition(3))
    model = whitening.fit(vectors)
    return model, whitening.whiten(vectors, model, components).orderBy("vec_id", "component").collect()


def brute_force(rows):
    """The contract with numpy's own eigenvalues, and sums of Python integers."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    white = {i: ([c - s / n for c, s in zip(x, sums, strict=True)] @ v[:, :4]) / np.sqrt(e[:4]) for i, x in kept}
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in kept}
    return n, e, white, deviation


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(9, 9)) * np.geomspace(1, 1e-2, 9)
    rows = [(i, (r.normal(size=9) @ mix + 3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(5, rows[5][1])]  # copies
    rows += [(2000, None), (2001, [None] + [0.0] * 8), (2002, [float("nan")] + [0.0] * 8), (2003, [math.inf] * 9), (2004, []), (2005, [0.0] * 9), (2006, [-0.0] * 9)]
    model, got = run(spark, rows)
    n, e, white, deviation = brute_force(rows)
    taking = [i for i, v in rows if i < 2000 or i >= 2005]
    assert len(got) == 4 * len(taking) and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        want = white[r.vec_id][r.component - 1]
        if abs(want) > 1e-6:
            sign = signs.setdefault(r.component, np.sign(want * r.whitened))
            assert r.whitened * sign == pytest.approx(want, rel=1e-7, abs=1e-9)
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    assert len(signs) == 4


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 2**32 - 1), st.integers(0, 12))
def test_rotations_find_small_eigenvalues(d, seed, spread):
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.normal(size=(d, d)))
    want = np.sort(np.geomspace(1, 10.0**-spread, d))[::-1]
    e, v = whitening.rotations(q * want @ q.T)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-12)
    assert np.allclose(e, want, rtol=1e-9, atol=1e-15) and (np.diff(e) <= 0).all()
    assert np.allclose(v * e @ v.T, q * want @ q.T, atol=1e-13)


def test_graded_matrix_keeps_relative_accuracy():
    # a scaled diagonally dominant matrix: its smallest eigenvalue is known to all digits from its structure
    scale = np.array([1e6, 1.0, 1e-6])
    core = np.array([[1, 0.1, 0.1], [0.1, 1, 0.1], [0.1, 0.1, 1]])
    e, _ = whitening.rotations(core * np.outer(scale, scale))
    assert e.prod() == pytest.approx(np.linalg.det(core) * (scale**2).prod(), rel=1e-12)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**62), 2**62) | st.integers(-200, 200), min_size=3, max_size=3), min_size=1, max_size=20))
def test_packing_round_trip(rows):
    x = np.array(rows, np.int64)
    blobs = whitening.packed(x)
    assert (whitening.unpacked(blobs) == x).all()
    assert len(set(blobs)) == len({tuple(r) for r in rows})


def test_degenerate_tables(spark):
    assert run(spark, [])[1] == []
    assert run(spark, [(1, None), (2, [])])[1] == []
    model, got = run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])  # one distinct vector, fewer dimensions than components
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(i, c, 1, 0, None, None, None) for i in (0, 1, 2) for c in (1, 2)]
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]  # rank one
    model, got = run(spark, line)
    assert model.rank == 1 and got[0].identity_error < 1e-9
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    model, got = run(spark, [*line, (50, [1.0]), (51, [4.0, 5.0])])  # other lengths
    assert {r.vec_id for r in got} == set(range(10))


def test_large_entries(spark):
    schema = SCHEMA.replace("array<float>", "array<double>")
    rows = [(i, [float(i) * 2**45, 1.0]) for i in range(20)] + [(30, [1e300, 0.0]), (31, [2.0**60, 0.0])]
    _, got = run(spark, rows, schema)
    assert {r.vec_id for r in got} == set(range(20))
    assert all(r.deviation is None or r.deviation >= 0 for r in got) and any(r.deviation is None for r in got)
    assert all(math.isfinite(r.whitened) for r in got if r.component == 1)
