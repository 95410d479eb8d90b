"""MACD over time, long/short signals, and news overlays on price signals.

What needs only a window is a window. EMAs and three-state positions depend on the whole past of a symbol
in order: they run as one linear pass over its bars inside a task (one symbol, one group).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.operators.candlesticks import candles
from tessera.operators.indicators import bollinger, by_symbol, last, rsi_simple, sma


def ema_seeded(v, n: int):
    """EMA of a pandas Series seeded by the mean of its first n values; nothing before the n-th."""
    import pandas as pd

    if len(v) < n:
        return pd.Series([float("nan")] * len(v), index=v.index)
    head = pd.Series([v.iloc[:n].mean()], index=v.index[n - 1 : n])
    return pd.concat([head, v.iloc[n:]]).ewm(alpha=2 / (n + 1), adjust=False).mean().reindex(v.index)


def macd_history(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(sym, d, macd_hist): line less signal on every bar, null in the first slow + signal - 2."""

    session.ship(bars.sparkSession)

    def run(pdf):
        pdf = pdf.sort_values("d").reset_index(drop=True)
        line = (ema_seeded(pdf["close"], fast) - ema_seeded(pdf["close"], slow)).iloc[slow - 1 :]
        pdf["macd_hist"] = (line - ema_seeded(line, signal)).reindex(pdf.index)
        return pdf[["sym", "d", "macd_hist"]]

    out = bars.select("sym", "d", F.col("close").cast("double").alias("close")).groupBy("sym").applyInPandas(run, "sym string, d date, macd_hist double")
    return out.withColumn("macd_hist", F.when(~F.isnan("macd_hist"), F.col("macd_hist")))


def macd_signals(bars: DataFrame, both_ways: bool = False) -> DataFrame:
    """(sym, d, signal): 1 while the histogram is above 0; else 0, or -1 both ways; 0 before it exists."""
    below = F.when(F.col("macd_hist").isNotNull(), -1).otherwise(0) if both_ways else F.lit(0)
    return macd_history(bars).select("sym", "d", F.when(F.col("macd_hist") > 0, 1).otherwise(below).cast("int").alias("signal"))


def sma_directional(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    c = F.col("close")
    s = F.when(sma(c, slow).isNull(), 0).when(sma(c, fast) > sma(c, slow), 1).otherwise(-1)
    return bars.select("sym", "d", s.alias("signal"))


def momentum_directional(bars: DataFrame, lookback: int = 20) -> DataFrame:
    past = F.lag("close", lookback).over(by_symbol())
    return bars.select("sym", "d", F.when(past.isNull(), 0).when(F.col("close") > past, 1).otherwise(-1).alias("signal"))


def reversal(rows: DataFrame, long: Column, short: Column, leave_long: Column, leave_short: Column) -> DataFrame:
    """(sym, d, signal) of a position that enters long or short from flat and leaves to flat; a null condition does not hold."""

    session.ship(rows.sparkSession)

    def run(pdf):
        pdf = pdf.sort_values("d")
        at, out = 0, []
        for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["x"], pdf["y"], strict=True):
            at = (1 if a else -1 if b else 0) if at == 0 else (0 if (x if at == 1 else y) else at)
            out.append(at)
        pdf["signal"] = out
        return pdf[["sym", "d", "signal"]]

    on = {k: F.coalesce(c, F.lit(False)) for k, c in {"a": long, "b": short, "x": leave_long, "y": leave_short}.items()}
    return rows.select("sym", "d", *[c.alias(k) for k, c in on.items()]).groupBy("sym").applyInPandas(run, "sym string, d date, signal int")


def rsi_directional(bars: DataFrame, low: float = 30.0, high: float = 70.0, mid: float = 50.0) -> DataFrame:
    """Warm-up bars come before any entry, so they are flat; RSI is compared as rounded to 2 places."""
    r = F.round("rsi", 2)
    return reversal(rsi_simple(bars), r < low, r > high, r >= mid, r <= mid)


def bollinger_directional(bars: DataFrame) -> DataFrame:
    lo, mid, hi, c = F.round("boll_lo", 2), F.round("boll_mid", 2), F.round("boll_hi", 2), F.col("close")
    return reversal(bollinger(bars), c <= lo, c >= hi, c >= mid, c <= mid)


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sma_cross": sma_directional, "momentum": momentum_directional, "rsi": rsi_directional,
    "macd": lambda bars: macd_signals(bars, both_ways=True), "bollinger": bollinger_directional,
    "candles": lambda bars: candles(bars, both_ways=True),
}


def news_score(bars: DataFrame, scored: DataFrame, days: int = 5) -> DataFrame:
    """bars (sym, d) with news: the sum of scores (sym, d, score) of the last `days` days, the bar's day included; 0 without any."""
    daily = scored.where("score is not null").groupBy("sym", "d").agg(F.sum("score").alias("score"))
    both = bars.select("sym", "d", F.lit(True).alias("_bar"), F.lit(None).cast("double").alias("score"))
    both = both.unionByName(daily.select("sym", "d", F.lit(False).alias("_bar"), "score"))
    w = by_symbol().partitionBy("sym").orderBy(F.datediff("d", F.lit("1970-01-01"))).rangeBetween(-days, 0)
    return both.withColumn("news", F.coalesce(F.sum("score").over(w), F.lit(0.0))).where("_bar").select("sym", "d", "news")


def news_signals(bars: DataFrame, scored: DataFrame, days: int = 5, least: float = 0.0) -> DataFrame:
    """(sym, d, news_long, news_gate): news above 0, and not below `least`."""
    d = news_score(bars, scored, days)
    total = F.round("news", 9)
    return d.select("sym", "d", (total > 0).cast("int").alias("news_long"), (total >= least).cast("int").alias("news_gate"))


def combine_and(a: DataFrame, b: DataFrame, left: str = "signal", right: str = "news_gate") -> DataFrame:
    """(sym, d, signal): 1 where both signals are."""
    return a.join(b, ["sym", "d"]).select("sym", "d", ((F.col(left) == 1) & (F.col(right) == 1)).cast("int").alias("signal"))


def divergence(bars: DataFrame, mood: DataFrame, n: int = 5, price_eps: float = 1.0, mood_eps: float = 0.1) -> DataFrame:
    """(sym, d, change_pct, mood, diverging): a marked move of n bars against the sign of a marked mood (sym, d, mood)."""
    past = F.lag("close", n).over(by_symbol())
    d = bars.select("sym", "d", ((F.col("close") / F.nullif(past, F.lit(0.0)) - 1) * 100).alias("change_pct")).join(mood, ["sym", "d"], "left")
    marked = (F.abs("change_pct") >= price_eps) & (F.abs("mood") >= mood_eps)
    return d.select("sym", "d", "change_pct", "mood", F.coalesce(marked & ((F.col("change_pct") > 0) != (F.col("mood") > 0)), F.lit(False)).alias("diverging"))


def thin_liquidity(bars: DataFrame, n: int = 20, least: float = -1.5) -> DataFrame:
    """(sym, d, volume_z, thin): no volume, or a z-score over the last n bars below `least`."""
    v = F.col("volume").cast("double")
    w = last(n)
    z = F.when(F.count(v).over(w) == n, (v - F.avg(v).over(w)) / F.nullif(F.stddev_samp(v).over(w), F.lit(0.0)))
    d = bars.select("sym", "d", "volume", z.alias("volume_z"))
    return d.select("sym", "d", "volume_z", (F.col("volume").isNull() | (F.col("volume") <= 0) | F.coalesce(F.round("volume_z", 9) < least, F.lit(False))).alias("thin"))
