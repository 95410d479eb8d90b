"""Days that replace themselves: written twice, emptied, and after a failure between."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.operators import news
from tessera.sources import snapshots as sn

A, B, C = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)
SCHEMA = "k string, v long, d date"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path, **kw):
    return sorted(map(tuple, sn.read_days(spark, path, SCHEMA, **kw).select("k", "v", "d").collect()))


def test_replaced_emptied_and_kept(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert held(spark, path) == []
    first = frame(spark, [("x", 1, A), ("y", 2, A), ("x", 3, B), ("x", 9, None)])
    for _ in range(2):
        sn.replace_days(first, path, [A, B])
        assert held(spark, path) == [("x", 1, A), ("x", 3, B), ("y", 2, A)]
    sn.replace_days(frame(spark, [("z", 7, B), ("z", 8, C)]), path, [B])
    assert held(spark, path) == [("x", 1, A), ("y", 2, A), ("z", 7, B)]
    sn.replace_days(frame(spark, []), path, [A])
    assert held(spark, path) == [("z", 7, B)] and held(spark, path, until=A) == [] and held(spark, path, since=B, until=B) == [("z", 7, B)]
    sn.replace_days(first, path, [])
    assert held(spark, path) == [("z", 7, B)]


def test_a_failure_between_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sn.replace_days(frame(spark, [("x", 1, A), ("x", 2, B)]), path, [A, B])
    bad = frame(spark, [("n", i, A) for i in range(50)]).repartition(4).withColumn("v", F.when(F.col("v") == 49, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        sn.replace_days(bad, path, [A])
    assert held(spark, path) == [("x", 1, A), ("x", 2, B)]
    sn.replace_days(frame(spark, [("n", 5, A)]), path, [A])
    assert held(spark, path) == [("n", 5, A), ("x", 2, B)]


def test_sentiment_days_equal_the_fold(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    daily = spark.createDataFrame([("market", "", A, 0.5, 3), ("market", "", B, -0.5, 2), ("asset", "1", B, 1.0, 1), ("market", "", C, 0.25, 4), ("asset", "1", C, 0.0, 1)], "scope string, key string, d date, mean double, n long")
    for days in ([A], [A, B], [B], [C], [B, C], [C]):  # days come again, as after a restart
        sn.record_sentiment(daily, path, days)
    got = {(r.scope, r.key, r.d): r.ewma for r in sn.read_days(spark, path, "scope string, key string, mean double, n long, ewma double, d date").collect()}
    want = {(r.scope, r.key, r.d): r.ewma for r in news.ewma(daily, ["scope", "key"], "mean").collect()}
    assert got == pytest.approx(want) and len(got) == 5
