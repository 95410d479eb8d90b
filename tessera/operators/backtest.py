"""Signals, backtests without lookahead, trades, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.indicators import YEAR, bollinger, by_symbol, rsi_simple, sma


def sma_cross(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    c = F.col("close")
    return bars.withColumn("signal", F.coalesce((sma(c, fast) > sma(c, slow)).cast("int"), F.lit(0)))


def momentum(bars: DataFrame, lookback: int = 20) -> DataFrame:
    return bars.withColumn("signal", F.coalesce((F.col("close") > F.lag("close", lookback).over(by_symbol())).cast("int"), F.lit(0)))


def hysteresis(df: DataFrame, enter, leave) -> DataFrame:
    """signal 1 from a row where enter holds until one where leave does: the last of the two events decides."""
    event = F.when(F.coalesce(leave, F.lit(False)), 0).when(F.coalesce(enter, F.lit(False)), 1)
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_e", event).withColumn("signal", F.coalesce(F.last("_e", ignorenulls=True).over(w), F.lit(0))).drop("_e")


def rsi_signal(bars: DataFrame, low: float = 30.0, high: float = 55.0) -> DataFrame:
    d = rsi_simple(bars).withColumn("rsi", F.round("rsi", 2))
    return hysteresis(d, F.col("rsi") < low, F.col("rsi") > high)


def bollinger_signal(bars: DataFrame) -> DataFrame:
    d = bollinger(bars)
    return hysteresis(d, F.col("close") <= F.round("boll_lo", 2), F.col("close") >= F.round("boll_mid", 2))


def positions(signals: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """signals with held (the signal of the bar before), and ret of the strategy after costs on changes."""
    w = by_symbol()
    d = signals.withColumn("held", F.coalesce(F.lag("signal").over(w), F.lit(0)))
    d = d.withColumns({"_r": F.coalesce(F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1, F.lit(0.0)), "_t": F.abs(F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0)))})
    return d.withColumn("ret", F.col("held") * F.col("_r") - F.col("_t") * cost_bps / 1e4).withColumn("market", F.col("_r")).drop("_r", "_t")


def report(signals: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """One row a symbol: total return, buy and hold, Sharpe, Sortino, drawdown, exposure (percent, ratios)."""
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    d = positions(signals, cost_bps).withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(w)))
    d = d.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w))).withColumn("n", F.row_number().over(by_symbol()))
    real = F.col("n") > 1
    year = F.sqrt(F.lit(float(YEAR)))
    r = F.when(real, F.col("ret"))
    down = F.sqrt(F.avg(F.when(real, F.pow(F.least(F.col("ret"), F.lit(0.0)), 2))))
    return d.groupBy("sym").agg(
        F.count(F.lit(1)).alias("bars"), ((F.max_by("equity", "d") - 1) * 100).alias("total_pct"),
        ((F.max_by("close", "d") / F.min_by("close", "d") - 1) * 100).alias("hold_pct"),
        (F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * year).alias("sharpe"),
        (F.avg(r) / F.nullif(down, F.lit(0.0)) * year).alias("sortino"),
        (F.max((F.col("peak") - F.col("equity")) / F.col("peak")) * 100).alias("drawdown_pct"),
        (F.avg(F.when(real, F.col("held"))) * 100).alias("exposure_pct"),
    )


def trades(signals: DataFrame) -> DataFrame:
    """(sym, entry, exit, bars, pnl_pct) of every run of held bars, an open one closed at the last bar.

    Entry price is the close of the bar before the run."""
    w = by_symbol()
    d = positions(signals).withColumns({"p": F.lag("close").over(w), "pd": F.lag("d").over(w), "turn": (F.col("held") != F.coalesce(F.lag("held").over(w), F.lit(0))).cast("int")})
    d = d.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("held = 1")
    d = d.groupBy("sym", "run").agg(F.min("pd").alias("entry"), F.max("d").alias("exit"), F.count(F.lit(1)).alias("bars"), ((F.max_by("close", "d") / F.min_by("p", "d") - 1) * 100).alias("pnl_pct"))
    return d.drop("run")


def folds(spark, n: int, train: int, test: int, anchored: bool = False) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end), half-open, rolling or anchored at 0."""
    count = max(0, (n - train) // test)
    d = spark.range(count).select(F.col("id").cast("int").alias("fold"))
    start = F.lit(0) if anchored else F.col("fold") * test
    return d.select("fold", start.alias("train_start"), (F.col("fold") * test + train).alias("train_end"), (F.col("fold") * test + train).alias("test_start"), (F.col("fold") * test + train + test).alias("test_end"))


def walk_forward(bars: DataFrame, grid: list[tuple[int, int]], train: int = 120, test: int = 40) -> DataFrame:
    """(sym, fold, fast, slow, train_ret, test_ret): the SMA pair of best training return (first of the grid on
    a tie), applied to the test bars. Signals of each pair come once from the full history; folds are a
    join on the bar number's block, so nothing is multiplied by train length more than the folds demand."""
    w = by_symbol()
    best = None
    for g, (fast, slow) in enumerate(grid):
        d = positions(sma_cross(bars, fast, slow)).select("sym", "d", "ret", F.row_number().over(w).alias("i")).withColumns({"g": F.lit(g), "fast": F.lit(fast), "slow": F.lit(slow)})
        best = d if best is None else best.unionByName(d)
    # bar i (from 0) is tested in one fold and trained on in those whose window holds it
    i = F.col("i") - 1
    tested = best.withColumn("fold", F.floor((i - train) / test)).where(i >= train)
    lo = F.greatest(F.lit(0), F.ceil((i - train + 1) / test))
    trained = best.withColumn("fold", F.explode(F.sequence(lo, F.greatest(lo, F.floor(i / test))))).where((i >= F.col("fold") * test) & (i < F.col("fold") * test + train))
    count = best.groupBy("sym").agg(F.floor((F.max("i") - train) / test).alias("folds"))
    total = F.sum(F.log1p("ret"))
    a = trained.groupBy("sym", "fold", "g", "fast", "slow").agg(total.alias("train_ret"))
    b = tested.groupBy("sym", "fold", "g").agg(total.alias("test_ret"))
    pick = a.join(count, "sym").where("fold < folds").withColumn("k", F.row_number().over(Window.partitionBy("sym", "fold").orderBy(F.round("train_ret", 9).desc(), "g"))).where("k = 1")
    return pick.join(b, ["sym", "fold", "g"]).select("sym", F.col("fold").cast("int").alias("fold"), "fast", "slow", "train_ret", "test_ret")
