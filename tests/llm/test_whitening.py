import math

import numpy as np
import pytest

from disclens.llm import whitening
from disclens.llm.whitening import bidiagonal, right_vectors, squared_singular_values, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "n") for i, v in rows], SCHEMA)


def triangles():
    draw = np.random.default_rng(5)
    turn = lambda n: np.linalg.qr(draw.normal(size=(n, n)))[0]
    for n in (1, 2, 3, 17, 64):
        yield np.triu(draw.normal(size=(n, n)))
    yield np.eye(7)
    yield np.zeros((4, 4))
    yield turn(30) * np.array([5] * 4 + [1] * 26) @ turn(30)
    yield turn(40) * np.array([5] * 20 + [5 + 1e-9] * 10 + [0] * 10) @ turn(40)
    yield np.diag([1e8, 1e-8, 3, 2e4, 5])
    w = 21
    yield np.linalg.cholesky(np.diag(np.abs(np.arange(w) - 10.0) + 3) + np.diag(np.ones(w - 1), 1) + np.diag(np.ones(w - 1), -1)).T


@pytest.mark.parametrize("r", list(triangles()), ids=lambda r: str(len(r)))
def test_the_small_solver_gives_values_and_orthonormal_directions(r):
    diagonal, above, right = bidiagonal(r)
    values = squared_singular_values(diagonal, above)
    exact = np.linalg.svd(r, compute_uv=False) ** 2
    scale = max(exact[0], 1e-300)
    assert np.abs(values - exact).max() <= 1e-13 * scale
    directions = right @ right_vectors(diagonal, above, values)
    assert np.abs(directions.T @ directions - np.eye(len(r))).max() < 1e-9
    assert np.abs(r.T @ r @ directions - directions * values).max() <= 1e-12 * scale


def test_small_values_of_a_graded_bidiagonal_are_relatively_right():
    diagonal, above = np.array([1.0, 1e-5, 1e-10]), np.array([0.5, 1e-6])
    values = squared_singular_values(diagonal, above)
    assert math.prod(values) == pytest.approx(math.prod(diagonal**2), rel=1e-12)


def brute_force(rows, count=4):
    whole = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: np.array([math.floor(256 * float(np.float32(c))) for c in v]) for i, v in whole}
    fit = np.array(sorted({tuple(v) for v in x.values()}), float)
    mean = fit.mean(axis=0)
    values, turned = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    values, turned = values[::-1][:count], turned[:, ::-1][:, :count]
    total = np.trace((fit - mean).T @ (fit - mean) / len(fit))
    sums = [int(s) for s in fit.sum(axis=0)]
    out = {}
    for i, v in x.items():
        z = (v - mean) @ turned / np.sqrt(np.maximum(values, 1e-300))
        off = sum((len(fit) * int(c) - s) ** 2 for c, s in zip(v, sums))
        for k in range(len(values)):
            out[i, k + 1] = (len(fit), off, z[k], values[k] / total)
    return out


def compare(found, expected):
    assert len(found) == len(expected)
    signs = {}
    for r in found:
        n, deviation, z, share = expected[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert r.explained == pytest.approx(share, rel=1e-9)
        assert r.identity_error <= 1e-9
        if abs(z) > 1e-6:
            signs.setdefault(r.component, math.copysign(1, r.whitened * z))
        assert r.whitened == pytest.approx(signs.get(r.component, 1) * z, abs=1e-7)


@pytest.mark.parametrize("fan_in", [2, 32])
def test_equals_a_dense_eigensolver(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 50)
    draw = np.random.default_rng(3)
    mixed = draw.normal(size=(12, 12))
    rows = [(i, [float(c) for c in draw.normal(size=12) @ mixed + 2]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(400)]
    nan, inf = float("nan"), float("inf")
    bad = [(5000, None), (5001, [nan] * 12), (5002, [1.0] * 11 + [inf]), (5003, [1.0] * 11 + [None]), (5004, [-inf] * 12), (5005, [])]
    found = whiten(vectors(spark, rows + bad).repartition(9)).collect()
    compare(found, brute_force(rows))


def test_fewer_dimensions_than_components_and_copies_that_do_not_count(spark):
    rows = [(i, [float(i % 5), float(i * i % 7)]) for i in range(50)]
    compare(whiten(vectors(spark, rows)).collect(), brute_force(rows))
    tied = [(1, [1.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, -1.0, 0.0]), (5, [0.0, 0.0, 1.0]), (6, [0.0, 0.0, -1.0])]
    found = whiten(vectors(spark, tied)).collect()
    assert sorted(r.component for r in found) == [1] * 6 + [2] * 6 + [3] * 6
    assert all(r.identity_error < 1e-9 and r.explained == pytest.approx(1 / 3) for r in found)


def test_directions_without_variance_have_no_figure(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)]
    found = whiten(vectors(spark, line)).collect()
    assert len(found) == 30
    assert all((r.whitened is None) == (r.component > 1) for r in found)
    assert max(r.identity_error for r in found) < 1e-9
    alone = whiten(vectors(spark, [(1, [3.0, 4.0]), (None, [3.0, 4.0])])).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, None, None)] * 4


def test_empty_tables_other_dimensions_and_large_entries(spark):
    assert whiten(vectors(spark, []).limit(0)).collect() == []
    assert whiten(vectors(spark, [(1, None)])).collect() == []
    rows = [(i, [float(i), float(-i % 3)]) for i in range(20)]
    other = [(100, [1.0]), (101, [1.0, 2.0, 3.0])]
    compare(whiten(vectors(spark, rows + other)).collect(), brute_force(rows))
    large = [(i, [float(np.float32(i * 3e13)), 1.0 + i % 2]) for i in range(9)]
    compare(whiten(vectors(spark, large), components=1).collect(), brute_force(large, 1))
