"""Exact p-values of the two-sample Kolmogorov–Smirnov test against counted paths."""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from trafficward.operators import evaluate


def listed(n: int, m: int, statistic: Fraction) -> Fraction:
    """Every order of the n + m values, one by one."""
    far = 0
    for ups in combinations(range(n + m), n):
        i = j = 0
        worst = Fraction(0)
        for at in range(n + m):
            i, j = (i + 1, j) if at in ups else (i, j + 1)
            worst = max(worst, abs(Fraction(i, n) - Fraction(j, m)))
        far += worst >= statistic
    return Fraction(far, math.comb(n + m, n))


def counted(n: int, m: int, statistic: Fraction) -> Fraction:
    ways = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if abs(Fraction(i, n) - Fraction(j, m)) < statistic:
                ways[i][j] = 1 if i == j == 0 else (ways[i - 1][j] if i else 0) + (ways[i][j - 1] if j else 0)
    return 1 - Fraction(ways[n][m], math.comb(n + m, n))


def test_exact_p_values(spark):
    cases = [(n, m, Fraction(k, n * m)) for n, m in ((1, 1), (3, 4), (5, 5), (6, 3)) for k in range(0, n * m + 1, 2)]
    large = [(n, m, Fraction(k, n * m)) for n, m in ((60, 60), (60, 41), (17, 60)) for k in (n * m // 10, n * m // 5, n * m // 3)]
    rows = [(i, n, m, float(d)) for i, (n, m, d) in enumerate(cases + large)]
    df = spark.createDataFrame(rows, "i int, n long, m long, d double").select("i", evaluate.exact_ks(F.col("n"), F.col("m"), F.col("d")).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    for i, (n, m, d) in enumerate(cases + large):
        wanted = listed(n, m, d) if i < len(cases) else counted(n, m, d)
        assert got[i] == pytest.approx(float(wanted), abs=1e-10), (n, m, d)


def test_small_samples_take_the_exact_value(spark):
    a = spark.createDataFrame([(float(i),) for i in range(8)], "x double")
    b = spark.createDataFrame([(float(i) + 5.5,) for i in range(6)], "x double")
    exact = evaluate.drift(a, b).first()
    rough = evaluate.drift(a, b, exact_cells=0).first()
    statistic = Fraction(6, 8)
    assert exact.ks_statistic == rough.ks_statistic == pytest.approx(float(statistic))
    assert exact.p_value == pytest.approx(float(listed(8, 6, statistic))) and abs(exact.p_value - rough.p_value) > 1e-3
