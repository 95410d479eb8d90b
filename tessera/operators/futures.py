"""Futures track: continuous series, labels, weights, drift, sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stitch(bars: DataFrame) -> DataFrame:
    """bars (sym, contract, expiry, d, close), each contract owning its dates, with adj: closes scaled so that the
    series of an asset has no step at a seam. Factors (first of the next over last of this) accumulate backwards over one
    row a contract."""
    ends = bars.groupBy("sym", "contract", "expiry").agg(F.min_by("close", "d").alias("first"), F.max_by("close", "d").alias("last"))
    w = Window.partitionBy("sym").orderBy("expiry")
    ratio = F.coalesce(F.lead("first").over(w) / F.col("last"), F.lit(1.0))
    ends = ends.withColumn("ratio", ratio).withColumn("factor", F.exp(F.sum(F.log("ratio")).over(w.rowsBetween(0, Window.unboundedFollowing))))
    return bars.join(ends.select("sym", "contract", "factor"), ["sym", "contract"]).withColumn("adj", F.col("close") * F.col("factor"))


def triple_barrier(bars: DataFrame, horizon: int = 12, mult: float = 1.5, vol_window: int = 20) -> DataFrame:
    """(sym, d, label): 1 or -1 by the first barrier at +-mult * sigma that the next bars touch, the lower one
    first where a bar touches both, 0 at the horizon. Bars ahead come by lead(), a frame of fixed length."""
    w = Window.partitionBy("sym").orderBy("d")
    r = bars.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    v = F.when(F.count("_r").over(w.rowsBetween(-(vol_window - 1), 0)) == vol_window, F.stddev_samp("_r").over(w.rowsBetween(-(vol_window - 1), 0)))
    d = r.withColumn("vol", v)
    up, down = F.col("close") * (1 + mult * F.col("vol")), F.col("close") * (1 - mult * F.col("vol"))
    ahead = F.collect_list(F.struct("low", "high")).over(w.rowsBetween(1, horizon))
    d = d.withColumns({"ahead": ahead, "up": up, "down": down}).where((F.size("ahead") == horizon) & F.col("vol").isNotNull())
    first = F.aggregate("ahead", F.lit(0), lambda s, x: F.when(s != 0, s).when(x["low"] <= F.col("down"), -1).when(x["high"] >= F.col("up"), 1).otherwise(0))
    return d.select("sym", "d", first.alias("label"))


def uniqueness(labels: DataFrame, length: int = 5) -> DataFrame:
    """labels (sym, i): mean of 1 / concurrency over the bars i .. i + length - 1 that a label lives, mean 1.

    Concurrency is counted per bar after spreading each label over its bars, so no interval meets another."""
    spread = labels.select("sym", "i", F.explode(F.sequence(F.col("i"), F.col("i") + length - 1)).alias("t"))
    c = spread.groupBy("sym", "t").agg(F.count(F.lit(1)).alias("c"))
    d = spread.join(c, ["sym", "t"]).groupBy("sym", "i").agg(F.avg(1 / F.col("c")).alias("u"))
    mean = d.agg(F.avg("u").alias("m"))
    return d.join(F.broadcast(mean)).select("sym", "i", (F.col("u") / F.col("m")).alias("weight"))


def psi(values: DataFrame, bins: int = 10, min_n: int = 20, eps: float = 1e-4) -> DataFrame:
    """(feature, psi) of values (feature, side, value): shares by the baseline's quantile bins against the live ones."""
    base = values.where("side = 'base'").groupBy("feature").agg(F.expr(f"percentile(value, array({', '.join(str(q / bins) for q in range(1, bins))}))").alias("edges"), F.count(F.lit(1)).alias("nb"))
    d = values.join(base, "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value"))))
    d = d.groupBy("feature", "bin").agg(F.count_if(F.col("side") == "base").alias("b"), F.count_if(F.col("side") == "live").alias("l"))
    all_ = d.groupBy("feature").agg(F.sum("b").alias("nb"), F.sum("l").alias("nl"))
    grid = all_.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(d, ["feature", "bin"], "left")
    pb, pl = F.greatest(F.coalesce("b", F.lit(0)) / F.col("nb"), F.lit(eps)), F.greatest(F.coalesce("l", F.lit(0)) / F.col("nl"), F.lit(eps))
    out = grid.where((F.col("nb") >= min_n) & (F.col("nl") >= min_n)).groupBy("feature").agg(F.sum((pl - pb) * F.log(pl / pb)).alias("psi"))
    return all_.select("feature").join(out, "feature", "left")


# Minutes of the exchange's wall clock. A break ends before its last minute.
OPEN, CLOSE, EVENING_CLOSE = 9 * 60, 18 * 60 + 45, 23 * 60 + 50
BREAK, EVENING_BREAK = (14 * 60, 14 * 60 + 5), (CLOSE, 19 * 60)
CLEARING = ((13 * 60 + 55, 14 * 60 + 10), (18 * 60 + 40, 19 * 60 + 10))


def session_flags(bars: DataFrame, ts: str = "ts", evening: bool = False, weekend: bool = False, flat_before: float = 15.0) -> DataFrame:
    """bars with in_session, clearing, to_close (minutes, below 0 after it), force_flat, entry_allowed and thin, from
    wall-clock time labelled as it is (no zone shift).

    Without `evening` the day ends with the main session; `weekend` takes Saturdays and Sundays for trading days. Positions
    are closed before the opening, from flat_before minutes to the close on and on days without trading; weekends and the
    evening are thin. A null time gives nulls."""
    m = F.hour(ts) * 60 + F.minute(ts)
    within = lambda a, b: (m >= a) & (m < b)
    close = EVENING_CLOSE if evening else CLOSE
    week = F.dayofweek(ts).between(2, 6)
    day = week | F.lit(weekend)
    inside = day & within(OPEN, close) & ~within(*BREAK)
    if evening:
        inside = inside & ~within(*EVENING_BREAK)
    clearing = within(*CLEARING[0]) | within(*CLEARING[1])
    left = close - m - F.date_format(ts, "s.SSSSSS").cast("double") / 60
    flat = ~day | (m < OPEN) | (left <= flat_before)
    thin = (~week | (m >= CLOSE)) if evening else ~week
    return bars.withColumns({"in_session": inside, "clearing": clearing, "to_close": left, "force_flat": flat, "entry_allowed": inside & ~clearing & ~flat, "thin": thin})


def cross_section(bars: DataFrame, lookback: int = 20, top: float = 0.34) -> DataFrame:
    """(d, sym, signal): of the symbols that have a bar on a date, the best by lookback return long, the worst short."""
    w = Window.partitionBy("sym").orderBy("d")
    d = bars.withColumn("mom", F.col("close") / F.lag("close", lookback).over(w) - 1).where("mom is not null")
    by = Window.partitionBy("d")
    d = d.withColumns({"n": F.count(F.lit(1)).over(by), "hi": F.row_number().over(by.orderBy(F.desc("mom"), "sym")), "lo": F.row_number().over(by.orderBy("mom", "sym"))})
    k = F.greatest(F.lit(1), F.floor(F.col("n") * top))
    return d.where("n >= 3").select("d", "sym", F.when(F.col("lo") <= k, -1).when(F.col("hi") <= k, 1).otherwise(0).alias("signal"))
