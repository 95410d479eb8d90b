"""Execution and risk limits as expressions; features at decision time; overfitting of a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.indicators import by_symbol

# Hard limits of an account that trades without an operator, in percent.
DAILY_LOSS, GROSS_MARGIN, PRICE_JUMP = 6.0, 80.0, 25.0


def slippage_ticks(qty: Column, vol_z: Column, base: float = 1.0, impact: float = 0.5, k: float = 0.5, cap: float = 3.0) -> Column:
    """(base + impact * (|qty| - 1)) times a multiplier that rises to cap as volume falls below its mean."""
    thin = F.least(F.lit(cap), F.greatest(F.lit(1.0), 1 - k * F.coalesce(vol_z, F.lit(0.0))))
    return (base + impact * F.greatest(F.lit(0), F.abs(qty) - 1)) * thin


def fill_price(price: Column, side: Column, tick: float, ticks: Column) -> Column:
    return price + F.signum(side) * ticks * tick


def decisions(bars: DataFrame, window: int = 20) -> DataFrame:
    """Rows where the signal changes, with features of the bar: vol_z against the window before it (population
    deviation), place in the range of the window, return of the bar."""
    w = by_symbol()
    before = w.rowsBetween(-window, -1)
    n = F.count("volume").over(before)
    z = (F.col("volume") - F.avg("volume").over(before)) / F.nullif(F.stddev_pop("volume").over(before), F.lit(0.0))
    hi, lo = F.max("high").over(w.rowsBetween(-(window - 1), 0)), F.min("low").over(w.rowsBetween(-(window - 1), 0))
    d = bars.withColumns({"prev": F.coalesce(F.lag("signal").over(w), F.lit(0)), "vol_z": F.when(n == window, z), "place": (F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)), "move_pct": (F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1) * 100})
    return d.where("signal <> prev").drop("prev")


def jumps(bars: DataFrame, max_pct: float = PRICE_JUMP) -> DataFrame:
    """bars with jump: the move from the bar before, if that has a price above 0, is beyond the limit."""
    p = F.lag("close").over(by_symbol())
    return bars.withColumn("jump", F.coalesce(F.when(p > 0, F.abs(F.col("close") / p - 1) * 100 > max_pct), F.lit(False)))


def loss_reached(peak: Column, equity: Column, max_pct: float = DAILY_LOSS) -> Column:
    """A fall from the day's peak of at least the limit; never with a peak of 0 or less."""
    return F.coalesce((peak > 0) & (peak - equity >= max_pct / 100 * peak), F.lit(False))


def daily_loss(equity: DataFrame, max_pct: float = DAILY_LOSS) -> DataFrame:
    """equity (account, ts, equity) with halted: the loss limit is reached against the day's running peak."""
    w = Window.partitionBy("account", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("equity").over(w)
    return equity.withColumn("halted", loss_reached(peak, F.col("equity"), max_pct))


def margin_budget(rows: DataFrame, max_pct: float = 60.0) -> DataFrame:
    """rows (desired, equity, used, margin) with qty: what free margin allows."""
    free = F.col("equity") * max_pct / 100 - F.col("used")
    return rows.withColumn("qty", F.greatest(F.lit(0), F.least(F.col("desired"), F.floor(free / F.nullif("margin", F.lit(0.0))))).cast("int"))


def overfitting(perf: DataFrame) -> DataFrame:
    """(pbo, splits) of (split, strategy, inside, outside): share of splits whose best inside (ties: the first by name) is not above half of
    the strategies outside, itself and its equals counted. Splits of one strategy say nothing and are left out; without any, pbo is null."""
    w = Window.partitionBy("split")
    d = perf.withColumns({"best": F.row_number().over(w.orderBy(F.desc("inside"), "strategy")), "rank": F.cume_dist().over(w.orderBy("outside")), "n": F.count(F.lit(1)).over(w)})
    return d.where("best = 1 and n >= 2").agg(F.avg((F.col("rank") <= 0.5).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("splits"))


def latest_values(series: DataFrame) -> DataFrame:
    """(indicator, ts, value): the newest value of each indicator, of equal times the largest."""
    x = series.groupBy("indicator").agg(F.max(F.struct("ts", "value")).alias("x"))
    return x.select("indicator", "x.ts", "x.value")


def alert_precision(rows: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(kind, n, hits, precision) of (kind, move): a hit moves at least the threshold either way; pending rows are left out."""
    d = rows.where(F.col("move").isNotNull()).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("move") >= threshold).alias("hits"))
    return d.withColumn("precision", F.col("hits") / F.col("n"))
