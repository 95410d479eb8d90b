"""Is a found strategy real: deflated Sharpe ratios and overfitting over combinatorial, purged splits."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.execution import overfitting

# Coefficients of a rational approximation of the inverse normal distribution, and where its tails begin.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425
EULER = 0.5772156649


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda a, c: a * x + c, coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """The inverse of the standard normal distribution, to about nine digits; p is cut to 1e-9 .. 1 - 1e-9."""
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    tail = lambda p: _poly(F.sqrt(-2 * F.log(p)), C) / _poly(F.sqrt(-2 * F.log(p)), (*D, 1.0))
    q = p - 0.5
    middle = _poly(q * q, A) * q / _poly(q * q, (*B, 1.0))
    return F.when(p < TAIL, tail(p)).when(p <= 1 - TAIL, middle).otherwise(-tail(1 - p))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution: half and the density times x + x^3/3 + x^5/15 + ..., whose terms all have one sign."""
    step = lambda s, n: F.struct((s["term"] * x * x / (2 * n + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(x.alias("term"), F.lit(0.0).alias("sum")), step)["sum"]
    inside = 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.when(x > 8, 1.0).when(x < -8, 0.0).otherwise(inside)


def deflated_sharpe(sharpe: Column, trials: Column, n: Column, skew: Column | None = None, kurtosis: Column | None = None) -> Column:
    """The chance that a Sharpe ratio (a return, not a year) found among so many trials is above what the best of as many worthless
    ones is expected to show; null below two observations or without a trial. kurtosis is 3 for a normal distribution."""
    skew, kurtosis = F.lit(0.0) if skew is None else skew, F.lit(3.0) if kurtosis is None else kurtosis
    best = (1 - EULER) * normal_quantile(1 - 1.0 / trials) + EULER * normal_quantile(1 - 1.0 / (trials * math.e))
    width = F.sqrt(F.greatest(F.lit(1e-12), 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe))
    z = (sharpe - best / F.sqrt(n - 1)) * F.sqrt(n - 1) / width
    return F.when((n >= 2) & (trials >= 1) & sharpe.isNotNull(), normal_cdf(z))


def deflated(returns: DataFrame) -> DataFrame:
    """(key, trial, n, sharpe, deflated) of returns (key, trial, ret): one aggregation; the trials of a key are counted over its rows of it."""
    ret, n = F.col("ret"), F.col("n")
    d = returns.where(ret.isNotNull()).groupBy("key", "trial").agg(F.count(F.lit(1)).alias("n"), (F.avg(ret) / F.nullif(F.stddev_samp(ret), F.lit(0.0))).alias("sharpe"), F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurtosis"))
    trials = d.groupBy("key").agg(F.count(F.lit(1)).alias("trials"))
    value = deflated_sharpe(F.col("sharpe"), F.col("trials"), n, F.col("skew"), F.col("kurtosis"))
    return d.join(trials, "key").select("key", "trial", "n", "sharpe", value.alias("deflated"))


def combinatorial_splits(spark, blocks: int, test: int) -> DataFrame:
    """(split, block, inside, before, after): every choice of `test` of the blocks to be tested on, as rows; inside marks the others,
    before and after whether the blocks next to it are of the same part (as do the ends)."""
    if not 1 <= test < blocks or math.comb(blocks, test) > 100_000:
        raise ValueError("test must be between 1 and blocks - 1, with at most 100,000 choices")
    rows = []
    for s, chosen in enumerate(combinations(range(blocks), test)):
        inside = [b not in chosen for b in range(blocks)]
        rows += [(s, b, inside[b], b == 0 or inside[b - 1] == inside[b], b == blocks - 1 or inside[b + 1] == inside[b]) for b in range(blocks)]
    return spark.createDataFrame(rows, "split int, block int, inside boolean, before boolean, after boolean")


def cpcv(returns: DataFrame, blocks: int = 6, test: int = 2, embargo: int = 0) -> DataFrame:
    """(split, strategy, inside, outside): the Sharpe ratio (a return) of every strategy in both parts of every combinatorial split, of
    returns (strategy, i, ret) numbered from 0. `embargo` returns next to a block of the other part are left out of the part that is not tested.

    Blocks keep sums of their first, middle and last returns: bars are aggregated once, and splits are joined to a row a block and strategy.
    A part of fewer than two returns, or whose returns do not differ, has no ratio; splits where a strategy lacks one are left out for it."""
    spark = returns.sparkSession
    n = returns.groupBy("strategy").agg((F.max("i") + 1).alias("_n"))
    d = returns.join(n, "strategy").withColumn("block", F.least(F.floor(F.col("i") / F.greatest(F.floor(F.col("_n") / blocks), F.lit(1))), F.lit(blocks - 1)).cast("int"))
    ends = d.groupBy("strategy", "block").agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"))
    d = d.join(ends, ["strategy", "block"])
    first, last = F.col("i") < F.col("_lo") + embargo, F.col("i") > F.col("_hi") - embargo
    part = F.when(first & last, "both").when(first, "first").when(last, "last").otherwise("middle")
    sums = d.where("ret is not null").groupBy("strategy", "block", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    x = sums.join(F.broadcast(combinatorial_splits(spark, blocks, test)), "block")
    stays = ~F.col("inside") | F.when(F.col("part") == "first", F.col("before")).when(F.col("part") == "last", F.col("after")).when(F.col("part") == "both", F.col("before") & F.col("after")).otherwise(True)
    x = x.where(stays).groupBy("split", "strategy", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("s") * mean) / F.nullif(F.col("n") - 1, F.lit(0))
    x = x.select("split", "strategy", "inside", F.when(var > 1e-18, mean / F.sqrt(var)).alias("sharpe"))
    pick = lambda side: F.max(F.when(F.col("inside") == side, F.col("sharpe")))
    return x.groupBy("split", "strategy").agg(pick(True).alias("inside"), pick(False).alias("outside")).where("inside is not null and outside is not null")


def cpcv_overfitting(returns: DataFrame, blocks: int = 6, test: int = 2, embargo: int = 0) -> DataFrame:
    """(pbo, splits) of cpcv(): how often the strategy that is best inside is in the lower half outside."""
    return overfitting(cpcv(returns, blocks, test, embargo))
