from fractions import Fraction
from math import floor

import numpy as np
import pytest

from tidemark.llm import whitening as wh
from tidemark.llm.common import table
from tidemark.llm.queries import op13_whitening

SF = "/root/testdata/sf0.001"


def brute(vectors, components=16):
    """{place: (n, deviations, covariance's largest values, explained, whitened up to the sign)} by whole fractions and one decomposition."""
    x = [[floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    different = sorted({tuple(v) for v in x})
    n, sums = len(different), [sum(c) for c in zip(*different)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(v, mean)] for v in different])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    every = np.array([[float(c - m) for c, m in zip(v, mean)] for v in x])
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, deviations, every @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_registered_query_matches_brute_force(spark):
    rows = table(spark, SF, "embeddings").orderBy("vec_id").collect()
    got = op13_whitening(spark, SF).orderBy("vec_id", "component").collect()
    n, deviations, whitened, explained = brute([r["embedding"] for r in rows])
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got[::16]] == deviations and [r["component"] for r in got[:16]] == list(range(1, 17))
    mine = np.array([r["whitened"] for r in got]).reshape(-1, 16)
    assert np.allclose(np.abs(mine), np.abs(whitened), atol=1e-9) and np.allclose(mine * np.sign((mine * whitened).sum(axis=0)), whitened, atol=1e-9)
    assert np.allclose([r["explained"] for r in got[:16]], explained, rtol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


VECTORS = "vec_id long, embedding array<float>, x string, v int, n int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], VECTORS)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 0.5]), (3, None), (4, [nan, 0.0]), (5, [0.0, -inf]), (6, [None, 0.0]), (7, []), (8, [1.0]), (9, [2.0, -1.0])]
    got = wh.whitened_embeddings(make(spark, rows)).collect()
    assert sorted([r["vec_id"] for r in got], key=str) == [1] * 4 + [9] * 2 + [None] * 2
    assert {r["n"] for r in got} == {3} and got[0]["identity_error"] < 1e-9
    n, deviations, _, explained = brute([[0.0, 1.0], [1.0, 0.5], [2.0, -1.0]])
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: deviations[0], None: deviations[1], 9: deviations[2]}
    assert np.allclose(sorted({r["explained"] for r in got}, reverse=True), explained)
    assert wh.whitened_embeddings(make(spark, [])).collect() == [] == wh.whitened_embeddings(make(spark, [(1, None), (2, [])])).collect()


def test_components_without_variance(spark):
    alone = wh.whitened_embeddings(make(spark, [(1, [3.0, 4.0, 5.0])] * 3)).collect()
    assert len(alone) == 9 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in alone} == {(None, 0.0, 0, 0.0)}
    flat = wh.whitened_embeddings(make(spark, [(i, [float(i), 7.0, -2.0 * i]) for i in range(10)])).orderBy("vec_id", "component").collect()
    assert [r["whitened"] is None for r in flat[:3]] == [False, True, True] and flat[0]["explained"] == pytest.approx(1) and flat[0]["identity_error"] < 1e-9


def test_entries_beyond_a_long(spark):
    got = wh.whitened_embeddings(make(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.5, 2.0])])).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] < 3)
    assert all(r["whitened"] is None or np.isfinite(r["whitened"]) for r in got)


def test_merging_in_any_order_gives_the_same_moments():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(1000, 8)) * 40).astype(np.int64) + 1_000_000
    whole = wh.moments_of(x)
    exact = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    for cuts in ([500], [1, 2, 3], [999], [10, 400, 401, 800]):
        state = wh.Moments(0, [], np.zeros((0, 0)))
        for part in np.split(x, cuts)[::-1]:
            state = state.merge(wh.moments_of(part))
        assert state.n == 1000 and state.sums == whole.sums == x.sum(axis=0).tolist()
        assert np.allclose(state.scatter, exact, rtol=1e-10, atol=1e-6)
