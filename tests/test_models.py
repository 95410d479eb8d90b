"""Numpy-backed operators against plain recomputation on small inputs."""

import datetime as dt

import numpy as np

from tessera.operators import futures, models


def test_regimes_find_two_levels():
    rng = np.random.default_rng(1)
    truth = np.repeat([0, 1, 0, 1], 100)
    x = (rng.normal(size=400) * 0.3 + truth * 3)[:, None]
    got = models.fit_regimes(x, states=2)
    assert (got == truth).mean() > 0.98


def test_ols_recovers_betas(spark):
    rng = np.random.default_rng(2)
    day = dt.date(2024, 1, 1)
    f = rng.normal(size=(100, 2))
    y = 0.5 * f[:, 0] - 1.5 * f[:, 1]
    factors = spark.createDataFrame([(day + dt.timedelta(i), float(a), float(b)) for i, (a, b) in enumerate(f)], "d date, a double, b double")
    rets = spark.createDataFrame([("s", day + dt.timedelta(i), float(v)) for i, v in enumerate(y)], "sym string, d date, ret double")
    got = {r.factor: r for r in models.ols_attribution(rets, factors).collect()}
    assert abs(got["a"].beta - 0.5) < 1e-9 and abs(got["b"].beta + 1.5) < 1e-9
    assert abs(got["a"].contribution - 0.5 * f[99, 0]) < 1e-9
    assert models.ols_attribution(rets.limit(30), factors).count() == 0


def test_stories_join_nearest_earlier(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [0.99, 0.05]), (0, 3, [0.0, 1.0]), (0, 4, [0.05, 1.0]), (1, 5, [1.0, 0.0])]
    got = {r.id: r.story for r in models.stories(spark.createDataFrame(rows, "bucket int, id long, v array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_stories_look_back_over_the_whole_bucket(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2600, 64))
    x[600], x[2599], x[2000] = x[3] * 2, x[1500] + 0.01 * x[7], x[10]  # the only partner is 597, 1099 and 1990 rows back
    x[2300] = x[600] + 0.01 * x[8]  # joins by way of an earlier joiner
    got = {r.id: r.story for r in models.stories(spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "bucket int, id long, v array<double>")).collect()}
    assert got == {i: i for i in range(2600)} | {600: 3, 2599: 1500, 2000: 10, 2300: 3}


def test_triple_barrier_adverse_first(spark):
    day = dt.date(2024, 1, 1)
    closes = [100 + (i % 2) for i in range(25)] + [101.0] * 12
    rows = [("s", day + dt.timedelta(i), float(c), c + (9 if i == 26 else 0.0), c - (9 if i == 26 else 0.0)) for i, c in enumerate(closes)]
    d = spark.createDataFrame(rows, "sym string, d date, close double, high double, low double")
    got = {r.d: r.label for r in futures.triple_barrier(d).collect()}
    assert got[day + dt.timedelta(24)] == -1 and min(got) == day + dt.timedelta(20)


def test_psi_needs_points(spark):
    rows = [("a", "base", float(i)) for i in range(100)] + [("a", "live", float(i)) for i in range(100)] + [("b", "base", 1.0), ("b", "live", 1.0)]
    got = {r.feature: r.psi for r in futures.psi(spark.createDataFrame(rows, "feature string, side string, value double")).collect()}
    assert abs(got["a"]) < 1e-9 and got["b"] is None
