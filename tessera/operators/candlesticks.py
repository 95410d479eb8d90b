"""Candlestick patterns, each gated by the trend before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.indicators import by_symbol, sma


#: Patterns that inform but are no signal of their own.
UNTRADED = ("inverted_hammer", "doji")


def marked(bars: DataFrame, trend: int = 10) -> DataFrame:
    """bars with hits: an array of (pattern, direction); direction 1 bullish after a fall, -1 bearish after a rise, 0 doji.

    Bars without a column of open, high or low have the close there; with closes alone nothing is found."""
    w, given = by_symbol(), bars.columns
    bars = bars.withColumns({x: F.col("close") for x in ("open", "high", "low") if x not in given})
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    d = bars.withColumn("_m", sma(c, trend))
    lag = lambda x, n=1: F.lag(x, n).over(w)
    d = d.withColumns({f"{x}{n}": lag(x, n) for x in ("open", "high", "low", "close") for n in (1, 2)} | {"_m1": lag("_m")})
    o1, h1, l1, c1, o2, h2, l2, c2 = (F.col(x) for x in ("open1", "high1", "low1", "close1", "open2", "high2", "low2", "close2"))
    rise = F.when(F.col("_m1").isNull(), 0).when(c1 > F.col("_m1"), 1).when(c1 < F.col("_m1"), -1).otherwise(0)
    body, span = F.abs(c - o), h - lo
    lower, upper = F.least(o, c) - lo, h - F.greatest(o, c)
    body1, span1, body2, span2 = F.abs(c1 - o1), h1 - l1, F.abs(c2 - o2), h2 - l2
    inside = (F.greatest(o, c) < F.greatest(o1, c1)) & (F.least(o, c) > F.least(o1, c1)) & (body1 >= 0.6 * span1) & (body < 0.6 * body1) & (span1 > 0)
    star = (body2 >= 0.6 * span2) & (span2 > 0) & (body1 <= 0.3 * span1)
    found = {
        ("doji", 0): (span > 0) & (body <= 0.1 * span),
        ("hammer", 1): (span > 0) & (lower >= 0.6 * span) & (upper <= 0.15 * span) & (rise == -1),
        ("hanging_man", -1): (span > 0) & (lower >= 0.6 * span) & (upper <= 0.15 * span) & (rise == 1),
        ("inverted_hammer", 1): (span > 0) & (upper >= 0.6 * span) & (lower <= 0.15 * span) & (rise == -1),
        ("shooting_star", -1): (span > 0) & (upper >= 0.6 * span) & (lower <= 0.15 * span) & (rise == 1),
        ("bullish_engulfing", 1): (c1 < o1) & (c > o) & (o <= c1) & (c >= o1) & (body > body1) & (rise == -1),
        ("bearish_engulfing", -1): (c1 > o1) & (c < o) & (o >= c1) & (c <= o1) & (body > body1) & (rise == 1),
        ("bullish_harami", 1): (c1 < o1) & (c > o) & inside & (rise == -1),
        ("bearish_harami", -1): (c1 > o1) & (c < o) & inside & (rise == 1),
        ("morning_star", 1): (c2 < o2) & star & (c > o) & (c >= (o2 + c2) / 2) & (rise == -1),
        ("evening_star", -1): (c2 > o2) & star & (c < o) & (c <= (o2 + c2) / 2) & (rise == 1),
    }
    hits = F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(p).alias("pattern"), F.lit(way).alias("direction"))) for (p, way), ok in found.items()])
    return d.select(*given, F.filter(hits, lambda x: x.isNotNull()).alias("hits"))


def patterns(bars: DataFrame, trend: int = 10) -> DataFrame:
    """(sym, d, pattern, direction), one row a hit of marked()."""
    return marked(bars, trend).select("sym", "d", F.explode("hits").alias("x")).select("sym", "d", "x.pattern", "x.direction")


def reversals(bars: DataFrame, trend: int = 10, name: str = "way") -> DataFrame:
    """bars with a column: the direction of a bar's confirmed reversal, null without one. A fall and a rise before a
    bar exclude each other, so all reversals of a bar agree."""
    way = F.get(F.filter("hits", lambda x: ~x["pattern"].isin(*UNTRADED)), F.lit(0))["direction"]
    return marked(bars, trend).select(*bars.columns, way.alias(name))


def side(way: str, i: str, hold: int) -> Column:
    """The side of the last reversal while it is younger than `hold` bars (numbered by i), else 0: one of the other side
    turns the position, one of the same side renews it; the bar of a reversal is always held."""
    until = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    age = F.col(i) - F.last(F.when(F.col(way).isNotNull(), F.col(i)), ignorenulls=True).over(until)
    return F.when(age < max(hold, 1), F.last(way, ignorenulls=True).over(until)).otherwise(0).cast("int")


def candles(bars: DataFrame, hold: int = 10, trend: int = 10, both_ways: bool = False) -> DataFrame:
    """(sym, d, signal): side() of the bars' reversals; only the long side unless both ways."""
    d = reversals(bars, trend).select("sym", "d", "way").withColumn("i", F.row_number().over(by_symbol()))
    at = side("way", "i", hold)
    return d.select("sym", "d", (at if both_ways else F.greatest(at, F.lit(0))).alias("signal"))
