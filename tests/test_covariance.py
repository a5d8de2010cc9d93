"""Robust covariance: planted clusters, order of rows, chi-square values."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from trafficward.operators import detectors


def test_chi_square_values():
    # closed forms: two degrees of freedom are exponential, four a sum of two of them
    for x in (0.01, 0.5, 1.0, 3.0, 9.0, 40.0):
        assert detectors.chi2_cdf(x, 2) == pytest.approx(1 - np.exp(-x / 2), abs=1e-12)
        assert detectors.chi2_cdf(x, 4) == pytest.approx(1 - np.exp(-x / 2) * (1 + x / 2), abs=1e-12)
    for d in (1, 3, 10, 64):
        for p in (0.025, 0.5, 0.975):
            assert detectors.chi2_cdf(detectors.chi2_quantile(p, d), d) == pytest.approx(p, abs=1e-12)


def contaminated(n: int = 240, d: int = 3):
    rng = np.random.default_rng(9)
    mix = np.array([[2.0, 0, 0], [1.0, 1.0, 0], [0.3, -0.5, 0.7]])
    x = rng.normal(size=(n, d)) @ mix.T
    bad = int(0.3 * n)
    x[:bad] = np.array([9.0, -7.0, 6.0]) + 0.3 * rng.normal(size=(bad, d))
    return x, bad


def test_a_cluster_of_thirty_percent_is_found_in_any_order(spark):
    x, bad = contaminated()
    clean = x[bad:]
    results = []
    for seed, parts in ((1, 1), (2, 5)):
        order = np.random.default_rng(seed).permutation(len(x))
        df = spark.createDataFrame([(f"p{i:03}", x[i].tolist()) for i in order], "id string, vec array<double>").repartition(parts)
        found = {r.id: (r.mahalanobis, r.envelope_anomaly) for r in detectors.elliptic_envelope(df, 0.3).collect()}
        assert {i for i, (_, flag) in found.items() if flag} == {f"p{i:03}" for i in range(bad)}
        results.append(found)
        fit = detectors.robust_covariance(df)
        assert np.abs(fit.mean - clean.mean(axis=0)).max() < 0.3
        assert np.abs(fit.cov / np.cov(clean.T) - 1)[np.eye(3, dtype=bool)].max() < 0.35
    assert max(abs(results[0][i][0] - results[1][i][0]) for i in results[0]) < 1e-6


def test_the_raw_fit_has_the_smallest_determinant(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(9, 2)), rng.normal(size=(4, 2)) + 8])
    half = (13 + 2 + 1) // 2
    best = min(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True))[1] for c in combinations(range(13), half))
    df = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    assert detectors.robust_covariance(df, starts=4, finalists=5).raw_log_det == pytest.approx(best, abs=0.05)
