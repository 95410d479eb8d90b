"""Returns, correlation, beta and risk of dated series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP_DAYS = 4


def returns(levels: DataFrame, key: str = "sym", at: str = "d", value: str = "close", gap: int = MAX_GAP_DAYS) -> DataFrame:
    """(key, at, ret): simple returns between a series' own dates; none over a gap or from a base of 0."""
    w = Window.partitionBy(key).orderBy(at)
    d = levels.select(key, at, F.col(value).alias("v"), F.lag(value).over(w).alias("p"), F.lag(at).over(w).alias("pd"))
    return d.where((F.datediff(at, "pd") <= gap) & (F.col("p") != 0)).select(key, at, (F.col("v") / F.col("p") - 1).alias("ret"))


def correlation_matrix(rets: DataFrame, min_points: int = 20) -> DataFrame:
    """(a, b, n, r) of every pair of series with enough common dates; r null without variance."""
    a = rets.select(F.col("sym").alias("a"), "d", F.col("ret").alias("x"))
    b = rets.select(F.col("sym").alias("b"), "d", F.col("ret").alias("y"))
    pairs = a.join(b, "d").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cov"))
    return pairs.where(F.col("n") >= min_points).select("a", "b", "n", (F.col("cov") / F.nullif(F.sqrt(F.col("vx") * F.col("vy")), F.lit(0.0))).alias("r"))


def beta(rets: DataFrame, index: DataFrame, min_obs: int = 60) -> DataFrame:
    """(sym, n, beta) against index (d, iret); null below min_obs or without variance."""
    d = rets.join(index, "d").groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("ret", "iret").alias("c"), F.var_pop("iret").alias("v"))
    return d.select("sym", "n", F.when((F.col("n") >= min_obs) & (F.col("v") > 1e-12), F.col("c") / F.col("v")).alias("beta"))


def historical_var(rets: DataFrame, level: float = 0.95, min_points: int = 20) -> DataFrame:
    """(sym, n, var, es): the loss at the level by linear interpolation, and the mean of the worst
    max(1, round((1 - level) n)) returns."""
    w = Window.partitionBy("sym")
    d = rets.withColumns({"k": F.row_number().over(w.orderBy("ret", "d")), "n": F.count(F.lit(1)).over(w)})
    worst = F.greatest(F.lit(1), F.bround((1 - F.lit(level)) * F.col("n"), 0))
    d = d.groupBy("sym").agg(F.max("n").alias("n"), (-F.expr(f"percentile(ret, {round(1 - level, 10)})")).alias("var"), (-F.avg(F.when(F.col("k") <= worst, F.col("ret")))).alias("es"))
    return d.select("sym", "n", *[F.when(F.col("n") >= min_points, F.col(c)).alias(c) for c in ("var", "es")])


def risk_contributions(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """(sym, share): each position's part of the portfolio variance in percent, on dates that all have."""
    n = weights.count()
    d = rets.join(weights, "sym")
    dates = d.groupBy("d").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("weight") * F.col("ret")).alias("p")).where(F.col("c") == n)
    d = d.join(dates, "d").groupBy("sym").agg(F.first("weight").alias("weight"), F.covar_pop("ret", "p").alias("c"), F.var_pop("p").alias("v"))
    return d.select("sym", (F.col("weight") * F.col("c") / F.nullif("v", F.lit(0.0)) * 100).alias("share"))


def max_drawdown(rets: DataFrame) -> DataFrame:
    """(sym, drawdown): largest fall of the equity from its running peak, percent."""
    w = Window.partitionBy("sym").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    d = rets.withColumn("e", F.exp(F.sum(F.log1p("ret")).over(w)))
    d = d.withColumn("peak", F.greatest(F.lit(1.0), F.max("e").over(w)))
    return d.groupBy("sym").agg((F.max((F.col("peak") - F.col("e")) / F.col("peak")) * 100).alias("drawdown"))


def cross_levels(levels: DataFrame, base: str, quote: str) -> DataFrame:
    """(d, close): one currency in another, of levels (currency, d, close) in a third; dates that both have, no quote of 0."""
    one = lambda c, to: levels.where(F.col("currency") == c).select("d", F.col("close").alias(to))
    return one(base, "_b").join(one(quote, "_q"), "d").where("_q != 0").select("d", (F.col("_b") / F.col("_q")).alias("close"))


def factor_correlations(rets: DataFrame, factors: DataFrame, min_points: int = 20) -> DataFrame:
    """(sym, factor, n, r) of returns with each factor (factor, d, ret) on common dates; no row with fewer
    dates than min_points or without variance."""
    f = factors.select("factor", "d", F.col("ret").alias("_f"))
    return _pearson(rets.select("sym", "d", "ret").join(f, "d"), min_points)


def peer_correlations(rets: DataFrame, sectors: DataFrame, coverage: float = 0.6, min_points: int = 20) -> DataFrame:
    """(sym, factor, n, r) with the mean return of the other symbols of the sector (sectors: sym, sector), on dates where at
    least ceil(coverage * others) of them have one.

    A sector's sums of a date less the symbol's own part: no pairs of symbols are made."""
    size = sectors.groupBy("sector").agg(F.count(F.lit(1)).alias("_k"))
    own = rets.select("sym", "d", "ret").join(sectors.select("sym", "sector"), "sym")
    day = own.groupBy("sector", "d").agg(F.sum("ret").alias("_s"), F.count("ret").alias("_c"))
    d = own.join(day, ["sector", "d"]).join(size, "sector")
    need = F.greatest(F.lit(1), F.ceil(F.round((F.col("_k") - 1) * coverage, 9)))
    d = d.where(F.col("_c") - 1 >= need).withColumn("_f", (F.col("_s") - F.col("ret")) / (F.col("_c") - 1))
    return _pearson(d.select("sym", F.lit("sector_peers").alias("factor"), "ret", "_f"), min_points)


def _pearson(d: DataFrame, min_points: int) -> DataFrame:
    d = d.groupBy("sym", "factor").agg(F.count(F.lit(1)).alias("n"), F.var_pop("ret").alias("vx"), F.var_pop("_f").alias("vy"), F.covar_pop("ret", "_f").alias("cov"))
    d = d.where((F.col("n") >= min_points) & (F.col("vx") > 0) & (F.col("vy") > 0))
    return d.select("sym", "factor", "n", (F.col("cov") / F.sqrt(F.col("vx") * F.col("vy"))).alias("r"))
