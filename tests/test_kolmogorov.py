"""Finite-sample p-values against enumeration, closed forms and the limit."""

from __future__ import annotations

import math
from itertools import combinations

import pytest

from txnlens.functions import kolmogorov as K
from txnlens.operators import separation as SP


def enumerated(d: float, m: int, n: int) -> float:
    """The share of orders of two samples whose statistic reaches ``d``."""
    orders = list(combinations(range(m + n), m))
    reached = 0
    for first in orders:
        i = j = most = 0
        for k in range(m + n):
            i, j = (i + 1, j) if k in first else (i, j + 1)
            most = max(most, abs(i * n - j * m))
        reached += most >= round(d * m * n)
    return reached / len(orders)


@pytest.mark.parametrize(("m", "n"), [(1, 1), (2, 3), (3, 3), (4, 6), (5, 7), (6, 4), (1, 8)])
def test_lattice_paths_equal_enumeration(m, n):
    g = math.gcd(m, n)
    for h in range(g, m * n + 1, g):
        assert K.two_sample_exact(h / (m * n), m, n) == pytest.approx(enumerated(h / (m * n), m, n), abs=1e-12)


def test_matrix_law_equals_closed_forms():
    for d in (0.55, 0.7, 0.9):
        assert K.matrix_cdf(d, 1) == pytest.approx(2 * d - 1, abs=1e-10)
    for d in (0.3, 0.4, 0.6, 0.8):
        want = 2 * (2 * d - 0.5) ** 2 if d < 0.5 else 1 - 2 * (1 - d) ** 2
        assert K.matrix_cdf(d, 2) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("z", [0.4, 0.7, 1.0, 1.4, 1.9])
def test_laws_agree_where_they_meet(z):
    d = z / math.sqrt(K.MATRIX_N)
    assert K.expansion_cdf(d, K.MATRIX_N) == pytest.approx(K.matrix_cdf(d, K.MATRIX_N), abs=2e-6)
    big = 10**10
    assert K.two_sided_sf(z / math.sqrt(big), big) == pytest.approx(1 - K.limit_cdf(z), abs=1e-5)
    assert K.two_sided_sf(1.999 / math.sqrt(400), 400) == pytest.approx(K.two_sided_sf(2.001 / math.sqrt(400), 400), rel=0.02)


def test_tail_keeps_its_digits():
    p = K.two_sample_exact(0.5, 404, 9596)
    assert 1e-91 < p < 1e-88 and K.two_sample_exact(1.0, 50, 70) == pytest.approx(2 / math.comb(120, 50))


def test_edges():
    assert K.p_value(0.0, 5, 5) == 1.0 and K.p_value(1.0, 20_000, 30_000) == 0.0
    assert math.isnan(K.p_value(0.5, 0, 3)) and math.isnan(K.p_value(math.nan, 3, 3))


def test_feature_ks_finite(spark):
    rows = [(float(k), 0) for k in range(7)] + [(k + 3.5, 1) for k in range(5)] + [(None, 1), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "V1 double, Class int")
    got = SP.feature_ks(df, ["V1"], finite=True).first()
    assert (got.n_neg, got.n_pos) == (7, 5) and got.p_value == pytest.approx(enumerated(got.ks, 7, 5), abs=1e-12)


def test_density_by_cells_equals_the_sum_of_kernels(spark):
    """Many more values than cells, far outliers, and a grid of its own; the series' bound holds."""
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, 3000), rng.exponential(2, 1500), [60.0, -45.0], np.zeros(500)])
    df = spark.createDataFrame([(float(x), 1) for x in v] + [(float("nan"), 1), (5.0, 0)], "V1 double, Class int")
    got = SP.density_by_label(df, "V1", grid_lo=-5.0, grid_hi=9.0).orderBy("point").collect()
    h = 0.3 * v.std(ddof=1)
    grid = np.linspace(-5, 9, SP.KDE_POINTS)
    want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
    assert [r.Class for r in got] == [1] * SP.KDE_POINTS
    assert np.abs(np.array([r.density for r in got]) - want).max() < 1e-12
    assert SP.series_error() < 1e-15 < SP.series_error(0.5, 6)
