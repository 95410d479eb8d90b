"""Corner cases of single operators against plain recomputation."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import alerts, fundamentals, prices, relational
from tessera.operators import backtest as bt
from tessera.operators import indicators as ind
from tessera.streaming import streams


def bars(spark, closes, sym="a"):
    day = dt.date(2024, 1, 1)
    rows = [(sym, day + dt.timedelta(i), float(c), float(c) + 1, float(c) - 1, float(c), 10) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "sym string, d date, open double, high double, low double, close double, volume long")


def test_warm_up_and_flat(spark):
    r = ind.rsi_simple(bars(spark, range(1, 20))).orderBy("d").collect()
    assert r[13].rsi is None and r[14].rsi == 100.0
    flat = bars(spark, [5] * 20).withColumns({"high": F.col("close"), "low": F.col("close")})
    assert all(x.stoch_k is None for x in ind.stochastic(flat).collect())


def test_folds_equal_recurrence(spark):
    closes = [10 + (i * 7 % 11) for i in range(60)]
    e = statistics.mean(closes[:12])
    for c in closes[12:]:
        e = e * 11 / 13 + c * 2 / 13
    assert abs(ind.ema_latest(bars(spark, closes)).first().ema - e) < 1e-9
    assert ind.macd_latest(bars(spark, closes[:33])).first().macd is None
    got = ind.macd_latest(bars(spark, closes)).first()

    def ema(v, n):
        out = [statistics.mean(v[:n])]
        for c in v[n:]:
            out.append(out[-1] * (1 - 2 / (n + 1)) + c * 2 / (n + 1))
        return out

    line = [a - b for a, b in zip(ema(closes, 12)[14:], ema(closes, 26), strict=True)]
    assert abs(got.macd - line[-1]) < 1e-9 and abs(got.macd_signal - ema(line, 9)[-1]) < 1e-9
    assert ind.ewma_volatility(bars(spark, closes[:20])).first().ewma_vol is None


def test_no_lookahead_and_open_trade(spark):
    b = bars(spark, [10, 11, 12, 6, 6, 9]).withColumn("signal", F.when(F.col("close") >= 12, 1).when(F.col("close") == 6, 1).otherwise(0))
    held = [r.held for r in bt.positions(b).orderBy("d").collect()]
    assert held == [0, 0, 0, 1, 1, 1]
    t = bt.trades(b).collect()
    assert len(t) == 1 and t[0].bars == 3 and abs(t[0].pnl_pct - (9 / 12 - 1) * 100) < 1e-9


def test_walk_forward_against_loops(spark):
    closes = [100 + 10 * ((i * 13) % 17) / 17 + i * 0.1 for i in range(130)]
    b = bars(spark, closes)
    got = {(r.fold): r for r in bt.walk_forward(b, [(2, 5), (3, 8)], train=50, test=20).collect()}
    import math

    rets = {}
    for g in [(2, 5), (3, 8)]:
        rets[g] = [math.log1p(r.ret) for r in bt.positions(bt.sma_cross(b, *g)).orderBy("d").collect()]
    assert set(got) == {0, 1, 2, 3}
    for f, r in got.items():
        sums = {g: sum(v[f * 20 : f * 20 + 50]) for g, v in rets.items()}
        best = max(sums, key=lambda g: (round(sums[g], 9), g == (2, 5)))
        assert (r.fast, r.slow) == best and abs(r.train_ret - sums[best]) < 1e-9
        assert abs(r.test_ret - sum(rets[best][f * 20 + 50 : f * 20 + 70])) < 1e-9


@pytest.mark.parametrize("strict", [True, False])
def test_asof(spark, strict):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), ("a", 0)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 4, 40.0), ("a", 5, 50.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.asof_v for r in prices.asof_join(left, right, "k", "t", "v", strict).collect()}
    assert got == {("a", 0): None, ("a", 1): None if strict else 10.0, ("a", 5): 40.0 if strict else 50.0, ("b", 5): None}


def test_upsert_new_wins_ties(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 9, "old")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 5, "new"), (2, 3, "new"), (3, 1, "new")], "k int, t int, v string")
    assert {r.k: r.v for r in relational.upsert(old, new, ["k"], "t").collect()} == {1: "new", 2: "old", 3: "new"}


def test_one_asset_scores(spark):
    v = spark.createDataFrame([(1, "m", 5.0)], "asset_id int, metric string, value double")
    assert fundamentals.percentiles(v).first().pct == 50.0 and fundamentals.zscores(v).first().z == 0.0


def test_expired_mute_is_ignored(spark):
    a = spark.createDataFrame([("x", "rsi_low"), ("y", "volume")], "sym string, kind string")
    m = spark.createDataFrame([("ticker", "x", "2020-01-01 00:00:00"), ("pair", "y:volume", None)], "scope string, value string, until string").withColumn("until", F.col("until").cast("timestamp"))
    assert [r.sym for r in alerts.unmuted(a, m, "2024-01-01 00:00:00").collect()] == ["x"]


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    src = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(src).schema
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "events.parquet").symlink_to(src)
    s = streams.read(spark, str(folder), schema)
    q = streams.negative_windows(s).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    batch = streams.negative_windows(spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda d: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in d.collect())
    assert key(spark.table("w")) == key(batch)
    q = streams.deduplicated(s, ["user_id"], "9000 hours").writeStream.outputMode("append").format("memory").queryName("u").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert spark.table("u").count() == spark.read.parquet(src).select("user_id").distinct().count()
