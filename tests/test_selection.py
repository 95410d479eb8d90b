"""Deflated Sharpe and combinatorial purged splits against the standard library and plain loops."""

import math
import random
from itertools import combinations
from statistics import NormalDist, mean, stdev

import pytest
from pyspark.sql import functions as F

from tessera.operators import selection

N = NormalDist()


def test_distribution_and_its_inverse(spark):
    xs = [-9.0, -8.0, -5.5, -2.0, -0.3, 0.0, 0.7, 3.1, 6.0, 8.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(selection.normal_cdf(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - N.cdf(x)) < 1e-14 for r, x in zip(got, xs, strict=True))
    ps = [0.0, 1e-9, 1e-4, 0.02, 0.03, 0.5, 0.8, 0.9757, 0.98, 0.999999, 1.0]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(selection.normal_quantile(F.col("p")).alias("y")).collect()
    assert all(abs(r.y - N.inv_cdf(min(max(p, 1e-9), 1 - 1e-9))) < 2e-8 * max(1, abs(r.y)) for r, p in zip(got, ps, strict=True))


def test_deflated_sharpe(spark):
    def plain(sr, trials, n, skew, kurt):
        top = (1 - 0.5772156649) * N.inv_cdf(max(1 - 1 / trials, 1e-9)) + 0.5772156649 * N.inv_cdf(1 - 1 / (trials * math.e))
        return N.cdf((sr - top / math.sqrt(n - 1)) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))

    rows = [(0.1, 5, 200, 0.0, 3.0), (0.3, 50, 60, -0.5, 5.0), (0.0, 1, 10, 0.0, 3.0), (0.5, 10, 1, 0.0, 3.0), (None, 5, 10, 0.0, 3.0), (0.2, 0, 10, 0.0, 3.0)]
    d = spark.createDataFrame(rows, "sr double, t int, n int, s double, k double")
    got = [r.x for r in d.select(selection.deflated_sharpe(d.sr, d.t, d.n, d.s, d.k).alias("x")).collect()]
    assert all(abs(g - plain(*r)) < 1e-7 for g, r in zip(got[:3], rows[:3], strict=True)) and got[3:] == [None] * 3
    more = d.limit(1).select(*[selection.deflated_sharpe(F.lit(0.1), F.lit(t), F.lit(200)).alias(f"t{t}") for t in (2, 20, 200)]).first()
    assert more.t2 > more.t20 > more.t200


@pytest.mark.parametrize(("blocks", "test", "embargo"), [(4, 2, 0), (5, 2, 3), (6, 1, 2)])
def test_cpcv_by_loops(spark, blocks, test, embargo):
    rnd = random.Random(blocks)
    rets = {s: [rnd.gauss(0.01 * k, 1) for _ in range(97)] for k, s in enumerate("abc")} | {"flat": [0.0] * 97, "short": [0.5, -0.2]}
    df = spark.createDataFrame([(s, i, r) for s, rs in rets.items() for i, r in enumerate(rs)], "strategy string, i long, ret double").repartition(3)
    got = {(r.split, r.strategy): (r.inside, r.outside) for r in selection.cpcv(df, blocks, test, embargo).collect()}
    want = {}
    for s, chosen in enumerate(combinations(range(blocks), test)):
        for name in "abc":
            rs = rets[name]
            size = len(rs) // blocks
            at = [min(i // size, blocks - 1) for i in range(len(rs))]
            out = [r for r, b in zip(rs, at, strict=True) if b in chosen]
            far = lambda i: all(not 0 <= j < len(rs) or at[j] not in chosen for j in range(i - embargo, i + embargo + 1))  # noqa: B023, E731
            ins = [r for i, r in enumerate(rs) if at[i] not in chosen and far(i)]
            want[s, name] = (mean(ins) / stdev(ins), mean(out) / stdev(out))
    assert {k for k in got if k[1] != "short"} == set(want)
    assert all(got[k] == (pytest.approx(a), pytest.approx(b)) for k, (a, b) in want.items())
    below = [sum(want[s, n][1] <= want[s, best][1] for n in "abc") / 3 <= 0.5 for s in range(math.comb(blocks, test)) for best in [max("abc", key=lambda n: want[s, n][0])]]  # noqa: B023
    r = selection.cpcv_overfitting(df.where("strategy in ('a', 'b', 'c')"), blocks, test, embargo).first()
    assert r.splits == math.comb(blocks, test) and r.pbo == pytest.approx(mean(below))


def test_corners(spark):
    df = spark.createDataFrame([], "strategy string, i long, ret double")
    assert selection.cpcv(df).collect() == [] and selection.cpcv_overfitting(df).first().pbo is None
    with pytest.raises(ValueError):
        selection.combinatorial_splits(spark, 4, 4)
    assert selection.combinatorial_splits(spark, 4, 2).count() == 24
