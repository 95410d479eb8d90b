"""The learned filter on rows whose true chances are known."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import policy as pol

SCHEMA = "t long, a double, b double, empty double, signed_qty int, win int, chance double"


def made(n, seed=3):
    rnd, rows = random.Random(seed), []
    for t in range(n):
        a, q = rnd.gauss(0, 1), rnd.choice((-2, 1))
        p = 1 / (1 + math.exp(-(1.6 * a * (1 if q > 0 else -1) - 0.4)))
        rows.append((t, None if rnd.random() < 0.1 else a, rnd.random(), None, q, int(rnd.random() < p), p))
    return rows


def test_held_out_rows(spark):
    df = spark.createDataFrame(made(3000), SCHEMA).repartition(4)
    policy, got = pol.train(df, ["a", "b", "empty"], "t", rounds=12)
    assert policy.isotonic and 850 <= got["n"] <= 950
    base = got["base_win_rate"] * (1 - got["base_win_rate"])
    assert got["brier"] < base - 0.04 and got["gap"] < 0.05 and got["auc"] > 0.75 and got["lift"] > 0.15
    scored = policy.score(df.where("t >= 2100").withColumn("p_win", F.lit("old")))
    assert scored.columns == [*df.columns, "p_win"] and scored.where("p_win < 0 or p_win > 1 or p_win is null").isEmpty()
    assert scored.agg(F.avg(F.abs(F.col("p_win") - F.col("chance"))).alias("e")).first().e < 0.12


def test_few_rows(spark):
    few = spark.createDataFrame(made(330), SCHEMA)
    policy = pol.fit(few, ["a"], "t", rounds=4)
    assert policy.calibrator is not None and not policy.isotonic and policy.score(few).where("p_win between 0 and 1").count() == 330
    policy = pol.fit(few.limit(60), ["a"], "t", rounds=3)
    assert policy.calibrator is None
    assert pol.fit(few.limit(20), ["a"], "t") is None and pol.fit(few.where("win = 1"), ["a"], "t") is None and pol.fit(few.limit(0), ["a"], "t") is None
    assert pol.train(few.limit(5), ["a"], "t") == (None, {})


def test_cut_keeps_times_together(spark):
    df = spark.createDataFrame([(i // 10, i) for i in range(100)] + [(None, 1)], "t long, v int")
    a, b = pol.cut(df, "t", 0.3)
    assert a.count() + b.count() == 100 and a.agg(F.max("t")).first()[0] < b.agg(F.min("t")).first()[0] and b.count() in (30, 40)


@pytest.mark.parametrize(("direction", "p", "want"), [(1, 0.5, 0), (1, 0.55, 1), (-1, 0.8, -2), (1, 1.0, 3), (0, 0.9, 0), (1, None, 0), (-1, 0.6625, -1)])
def test_decide(spark, direction, p, want):
    d = spark.createDataFrame([(direction, p)], "d int, p double")
    assert d.select(pol.decide(d.d, d.p).alias("q")).first().q == want
