"""Technical indicators as columns over bars (sym, d, open, high, low, close, volume).

Every operator takes and returns a DataFrame; one window per symbol ordered by date serves them all, so
a row of indicators costs one shuffle. Warm-up rows are null. Recursive averages are folds over a
symbol's ordered array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def by_symbol(key: str = "sym", at: str = "d"):
    return Window.partitionBy(key).orderBy(at)


def last(n: int, w=None):
    return (w if w is not None else by_symbol()).rowsBetween(-(n - 1), 0)


def full(x: Column, of: Column, n: int, w=None) -> Column:
    """x where the last n rows all hold a value of `of`."""
    return F.when(F.count(of).over(last(n, w)) == n, x)


def sma(x: Column, n: int, w=None) -> Column:
    return full(F.avg(x).over(last(n, w)), x, n, w)


def change_pct(x: Column, n: int, w=None) -> Column:
    past = F.lag(x, n).over(w if w is not None else by_symbol())
    return (x - past) / F.nullif(past, F.lit(0.0)) * 100


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """boll_lo, boll_mid, boll_hi: mean and k sample deviations of the last n closes."""
    c = F.col("close")
    mid, dev = sma(c, n), full(F.stddev_samp(c).over(last(n)), c, n)
    return bars.withColumns({"boll_lo": mid - k * dev, "boll_mid": mid, "boll_hi": mid + k * dev})


def rsi_simple(bars: DataFrame, n: int = 14) -> DataFrame:
    """rsi from plain averages of the last n gains and losses; 100 without losses."""
    w = by_symbol()
    d = bars.withColumn("_d", F.col("close") - F.lag("close").over(w))
    up, down = F.greatest(F.col("_d"), F.lit(0.0)), F.greatest(-F.col("_d"), F.lit(0.0))
    gain, loss = F.avg(up).over(last(n)), F.avg(down).over(last(n))
    rsi = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return d.withColumn("rsi", full(rsi, F.col("_d"), n)).drop("_d")


def volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """Yearly volatility in percent from the last n simple returns."""
    w = by_symbol()
    d = bars.withColumn("_r", F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1)
    return d.withColumn("volatility", full(F.stddev_samp("_r").over(last(n)), F.col("_r"), n) * F.sqrt(F.lit(float(YEAR))) * 100).drop("_r")


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range of the last n bars that have a bar before them."""
    p = F.lag("close").over(by_symbol())
    tr = F.when(p.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p)))
    return bars.withColumn("_tr", tr).withColumn("atr", full(F.avg("_tr").over(last(n)), F.col("_tr"), n)).drop("_tr")


def stochastic(bars: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    """stoch_k of the last k bars and stoch_d, its mean over d bars; null where a range is flat."""
    hi, lo = F.max("high").over(last(k)), F.min("low").over(last(k))
    at = full((F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100, F.col("close"), k)
    return bars.withColumn("stoch_k", at).withColumn("stoch_d", full(F.avg("stoch_k").over(last(d)), F.col("stoch_k"), d))


def obv(bars: DataFrame) -> DataFrame:
    """Running volume signed by the close's change; null volumes count 0."""
    step = F.signum(F.col("close") - F.lag("close").over(by_symbol())) * F.coalesce("volume", F.lit(0))
    return bars.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("obv", F.sum("_s").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def volume_spike(bars: DataFrame, n: int = 20) -> DataFrame:
    mean = sma(F.col("volume"), n)
    return bars.withColumns({"volume_sma": mean, "volume_spike": F.col("volume") / F.nullif(mean, F.lit(0.0))})


def high_low(bars: DataFrame, n: int = YEAR) -> DataFrame:
    return bars.withColumns({"high_n": F.max("close").over(last(n)), "low_n": F.min("close").over(last(n))})


def trend(bars: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """up or down by close > sma(short) > sma(long), by close > sma(short) until the long one exists."""
    c = F.col("close")
    d = bars.withColumns({"_s": sma(c, short), "_l": sma(c, long)})
    up = F.when(F.col("_l").isNull(), F.when(c > F.col("_s"), "up").otherwise("down"))
    up = up.when((c > F.col("_s")) & (F.col("_s") > F.col("_l")), "up").when((c < F.col("_s")) & (F.col("_s") < F.col("_l")), "down")
    return d.withColumn("trend", F.when(F.col("_s").isNotNull(), up)).drop("_s", "_l")


# ---- folds ----


def series(bars: DataFrame, value: str = "close", key: str = "sym", at: str = "d") -> DataFrame:
    """(key, xs): a symbol's values in order of time, as one array of structs (at, v)."""
    return bars.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("v")))).alias("xs"))


def ema_array(v: Column, n: int) -> Column:
    """EMA of an array, seeded by the mean of the first n; element 0 belongs to the n-th value."""
    alpha = 2.0 / (n + 1)
    seed = F.aggregate(F.slice(v, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    step = lambda out, x: F.concat(out, F.array(F.element_at(out, -1) * (1 - alpha) + x * alpha))
    rest = F.aggregate(F.slice(v, n + 1, F.greatest(F.size(v) - n, F.lit(0))), F.array(seed), step)
    return F.when(F.size(v) >= n, rest)


def ema_last(v: Column, n: int) -> Column:
    alpha = 2.0 / (n + 1)
    seed = F.aggregate(F.slice(v, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    return F.when(F.size(v) >= n, F.aggregate(F.slice(v, n + 1, F.greatest(F.size(v) - n, F.lit(0))), seed, lambda a, x: a * (1 - alpha) + x * alpha))


def ema_latest(bars: DataFrame, n: int = 12) -> DataFrame:
    """(sym, ema): the last EMA of each symbol."""
    return series(bars).select("sym", ema_last(F.transform("xs", lambda x: x["v"]), n).alias("ema"))


def macd_latest(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keep: int = 300) -> DataFrame:
    """(sym, macd, macd_signal, macd_hist) of the last `keep` bars; null below slow + signal - 1 bars."""
    xs = series(bars).select("sym", F.transform(F.slice("xs", F.greatest(F.size("xs") - keep + 1, F.lit(1)), F.lit(keep)), lambda x: x["v"]).alias("v"))
    d = xs.select("sym", "v", ema_array(F.col("v"), fast).alias("f"), ema_array(F.col("v"), slow).alias("s"))
    line = F.zip_with(F.slice("f", slow - fast + 1, F.greatest(F.size("s"), F.lit(0))), "s", lambda a, b: a - b)
    d = d.where(F.size("v") >= slow + signal - 1).select("sym", line.alias("line"))
    d = d.select("sym", F.element_at("line", -1).alias("macd"), ema_last(F.col("line"), signal).alias("macd_signal"))
    return xs.select("sym").join(d.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")), "sym", "left")


def ewma_volatility(bars: DataFrame, lam: float = 0.94, min_obs: int = 30, keep: int = 120) -> DataFrame:
    """(sym, ewma_vol) in percent: variance r0^2 first, then lam * var + (1 - lam) * r^2, over the last `keep` closes."""
    xs = series(bars).select("sym", F.transform(F.slice("xs", F.greatest(F.size("xs") - keep + 1, F.lit(1)), F.lit(keep)), lambda x: x["v"]).alias("v"))
    r = F.zip_with(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0))), lambda b, a: b / a - 1)
    d = xs.where(F.size("v") > 1).select("sym", r.alias("r"))
    first = F.element_at("r", 1)
    var = F.aggregate(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), first * first, lambda a, x: lam * a + (1 - lam) * x * x)
    return xs.select("sym").join(d.select("sym", F.when(F.size("r") >= min_obs, F.sqrt(var) * 100).alias("ewma_vol")), "sym", "left")
