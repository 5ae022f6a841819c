import math

import numpy as np
import pytest
from quotelens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], schema)


def brute(rows):
    """Rows kept, and the contract's figures from a full eigendecomposition."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in kept})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    centred = np.array(listed) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = {}
    for place, (i, x) in enumerate(kept):
        w = (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)
        out[place] = (i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), w)
    return n, values, out, np.trace(centred.T @ centred / n)


def given(seed=1, n=300, d=12):
    rng = np.random.default_rng(seed)
    points = (rng.standard_normal((n, d)) * np.linspace(3, 0.2, d)).astype(np.float32)
    rows = [(i, [float(c) for c in p]) for i, p in enumerate(points)]
    rows += [(n + k, rows[0][1]) for k in range(150)]
    rows += [(1000, None), (1001, [None] + [1.0] * (d - 1)), (1002, [float("nan")] * d), (1003, [float("inf")] + [0.0] * (d - 1)), (1004, [-0.0] * d)]
    return rows


def test_agrees_with_a_full_decomposition(spark):
    rows = given()
    docs = table(spark, rows).selectExpr("*", "1 AS x", "2 AS n", "3 AS component").repartition(5)
    n, values, expected, trace = brute(rows)
    got = whitening.whitened(docs).collect()
    assert len(got) == 4 * len(expected) and {r.n for r in got} == {n}
    signs = {}
    of = {i: (dev, w) for i, dev, w in expected.values()}
    for r in got:
        dev, w = of[r.vec_id]
        assert r.deviation == dev
        sign = signs.setdefault(r.component, 1 if r.whitened * w[r.component - 1] > 0 else -1)
        assert r.whitened == pytest.approx(sign * w[r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-10)
        assert r.identity_error < 1e-9


def test_ids_that_repeat_or_are_null_keep_their_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 5.0]), (3, [4.0, 1.0])]
    got = whitening.whitened(table(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in got if r.component == 1) == ["1", "1", "3", "None"] and {r.n for r in got} == {3}


def test_without_variance_or_rows_there_is_no_result(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(table(spark, [(1, []), (2, None)])).count() == 0
    # One direction only: one component.
    got = whitening.whitened(table(spark, [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [3.0, 3.0])])).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_lengths_are_fitted_apart(spark):
    got = whitening.whitened(table(spark, [(1, [1.0]), (2, [2.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [5.0, 5.0])])).collect()
    assert {(r.vec_id, r.n) for r in got} == {(1, 2), (2, 2), (3, 3), (4, 3), (5, 3)}


def test_huge_entries_do_not_fail(spark):
    docs = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(docs).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(1, None), (2, None), (3, 1 + 768**2)}


@pytest.mark.parametrize("case", ["flat", "steep", "ties", "all equal", "rank one", "wide"])
def test_solver_reaches_double_precision(case):
    rng = np.random.default_rng(3)
    values = {
        "flat": 1 + 0.01 * rng.random(64),
        "steep": 10.0 ** -np.arange(30),
        "ties": np.r_[[5.0] * 6, [1.0] * 20],
        "all equal": np.ones(40),
        "rank one": np.r_[9.0, np.zeros(20)],
        "wide": 1 / np.sqrt(np.arange(1, 1001)),
    }[case]
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    matrix = (turn * values) @ turn.T
    found = whitening.leading(lambda block: matrix @ block, len(values), 4)
    assert np.abs(found.values - np.sort(values)[::-1][:4]).max() < 1e-13 * values.max()
    assert found.residuals.max() < 1e-13 * values.max()
    assert np.abs(found.vectors.T @ found.vectors - np.eye(4)).max() < 1e-12


def test_minres_solves_shifted_systems_away_from_a_vector():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((20, 20))
    matrix, away = a @ a.T, np.eye(20)[:, :1]
    right = rng.standard_normal((20, 2))
    right[0] = 0
    shifts = np.array([0.5, 3.0])
    x = whitening.minres(lambda b: matrix @ b, shifts, right, away, 200, 1e-13)
    for j in range(2):
        full = np.linalg.solve((matrix - shifts[j] * np.eye(20))[1:, 1:], right[1:, j])
        assert np.allclose(x[1:, j], full, atol=1e-6) and x[0, j] == 0
