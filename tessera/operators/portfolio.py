"""Portfolios: value, book returns on common dates, risk, factor exposure and value over time.

Every frame carries an owner; nothing is collected, and the work of one owner is spread by (owner, date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_POINTS, WINDOW = 20, 250
BASE, CASH = "RUB", "cash"


def valued(positions: DataFrame, prices: DataFrame, cash: DataFrame, rates: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(owner, asset, sector, qty, price, avg_price, value, weight, pnl_pct, is_cash) of positions (owner, asset, sector,
    qty, avg_price) at prices (asset, price), or at live prices where there are any, and of cash (owner, currency,
    amount) at rates (currency, rate).

    The base currency counts at its face; other cash without a rate is left out. A position without a price stays
    without value and weight. pnl_pct is null without a price paid (null or 0). Owners whose total is not above 0 have
    no rows. Repeated positions of an owner are rows of their own."""
    p = positions.join(prices.select("asset", F.col("price").alias("_close")), "asset", "left")
    price = F.col("_close")
    if live is not None:
        p = p.join(live.select("asset", F.col("price").alias("_live")), "asset", "left")
        price = F.coalesce("_live", "_close")
    pnl = F.round((price / F.nullif("avg_price", F.lit(0.0)) - 1) * 100, 2)
    p = p.select("owner", "asset", "sector", "qty", price.alias("price"), "avg_price", (price * F.col("qty")).alias("value"), pnl.alias("pnl_pct"), F.lit(False).alias("is_cash"))
    c = cash.join(rates.select("currency", "rate"), "currency", "left").withColumn("rate", F.when(F.col("currency") == BASE, 1.0).otherwise(F.col("rate"))).where("rate is not null")
    none = F.lit(None).cast("double")
    money = F.when(F.col("currency") == BASE, F.col("amount")).otherwise(F.col("amount") * F.col("rate"))
    c = c.select("owner", F.col("currency").alias("asset"), F.lit(CASH).alias("sector"), F.col("amount").alias("qty"), F.col("rate").alias("price"), none.alias("avg_price"), F.round(money, 2).alias("value"), none.alias("pnl_pct"), F.lit(True).alias("is_cash"))
    total = F.sum("value").over(Window.partitionBy("owner"))
    d = p.unionByName(c).withColumn("_total", total).where("_total > 0")
    return d.withColumn("weight", F.col("value") / F.col("_total")).drop("_total")


def totals(rows: DataFrame) -> DataFrame:
    """(owner, total, cost): value of valued() rows, and what was paid: price paid times quantity, cash at its value;
    no cost where an owner has no position or one without a price paid."""
    stock = ~F.col("is_cash")
    whole = (F.count(F.when(stock, 1)) > 0) & (F.count(F.when(stock & F.col("avg_price").isNull(), 1)) == 0)
    cost = F.sum(F.when(stock, F.col("avg_price") * F.col("qty")).otherwise(F.coalesce("value", F.lit(0.0))))
    return rows.groupBy("owner").agg(F.round(F.sum("value"), 2).alias("total"), F.round(F.when(whole, cost), 2).alias("cost"))


def allocation(rows: DataFrame) -> DataFrame:
    """(owner, sector, weight_pct): weights in percent, rounded to 2 places, summed by sector and rounded to 1; a position
    without a sector is under '-', one without a weight is left out."""
    d = rows.where("weight is not null").groupBy("owner", F.coalesce("sector", F.lit("-")).alias("sector"))
    return d.agg(F.round(F.sum(F.round(F.col("weight") * 100, 2).cast("decimal(14,2)")), 1).cast("double").alias("weight_pct"))


def series(rows: DataFrame, rets: DataFrame, fx: DataFrame) -> DataFrame:
    """(owner, asset, weight, place, d, ret): the returns of all weighted rows of valued().

    rets (asset, d, ret) belong to positions. Cash has a return on every date of any of its owner's positions: 0 in the
    base currency, else that of fx (currency, d, ret), 0 where it has none. place orders an owner's assets by length of
    history, longest first, cash before all; of equals the greater name comes first. Repeated positions are one, with
    the sum of their weights; a weight of 0 takes no part."""
    w = rows.where("weight is not null").groupBy("owner", "asset", "is_cash").agg(F.sum("weight").alias("weight")).where("weight != 0")
    have = rets.groupBy("asset").agg(F.count(F.lit(1)).alias("_n"))
    stock = w.where("not is_cash").join(have, "asset").select("owner", "asset", "weight", "is_cash", "_n")
    money = w.where("is_cash").withColumn("_n", F.lit(0).cast("long")).select(*stock.columns)
    order = Window.partitionBy("owner").orderBy(F.desc("is_cash"), F.desc("_n"), F.desc("asset"))
    placed = stock.unionByName(money).withColumn("place", F.row_number().over(order)).drop("_n")
    held = placed.where("not is_cash").join(rets.select("asset", "d", "ret"), "asset")
    dates = held.select("owner", "d").distinct()
    cash = placed.where("is_cash").join(dates, "owner").join(fx.select(F.col("currency").alias("asset"), "d", F.col("ret").alias("_fx")), ["asset", "d"], "left")
    cash = cash.withColumn("ret", F.when(F.col("asset") == BASE, 0.0).otherwise(F.coalesce("_fx", F.lit(0.0))))
    columns = ["owner", "asset", "weight", "place", "d", "ret"]
    return held.select(columns).unionByName(cash.select(columns))


def book(rows: DataFrame, min_points: int = MIN_POINTS, window: int = WINDOW) -> DataFrame:
    """(owner, d, ret, members): weighted returns of series() rows on the last `window` dates that all members have.

    Assets of short history leave, shortest first, until the rest share min_points dates; the weights of the rest
    are scaled to 1. The members are then the first places of an owner: a date that has places 1 to k without a gap
    counts for k, and the greatest k with enough dates of k or more is taken. No step depends on the one before.
    An owner without such a k, or whose members' weights sum to 0, has no rows."""
    day = rows.groupBy("owner", "d").agg(F.array_sort(F.collect_list(F.struct("place", "weight", "ret"))).alias("x"))
    whole = F.size(F.filter("x", lambda v, i: v["place"] == i + 1))
    day = day.withColumn("k", whole).where("k > 0")
    common = F.count(F.lit(1)).over(Window.partitionBy("owner").orderBy(F.desc("k")).rangeBetween(Window.unboundedPreceding, 0))
    day = day.withColumn("_c", common)
    day = day.withColumn("members", F.max(F.when(F.col("_c") >= min_points, F.col("k"))).over(Window.partitionBy("owner"))).where(F.col("k") >= F.col("members"))
    day = day.withColumn("_n", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("d")))).where(F.col("_n") <= window)
    first = F.slice("x", F.lit(1), F.col("members"))
    total = lambda of: F.aggregate(first, F.lit(0.0), lambda a, v: a + of(v))
    ret = total(lambda v: v["weight"] * v["ret"]) / F.nullif(total(lambda v: v["weight"]), F.lit(0.0))
    return day.select("owner", "d", ret.alias("ret"), "members").where("ret is not null")


def excluded(rows: DataFrame, weighted: DataFrame, of: DataFrame) -> DataFrame:
    """(owner, asset): weighted rows of valued() that are no members of their owner's book `of` (series() rows)."""
    members = of.groupBy("owner").agg(F.max("members").alias("members"))
    inside = rows.select("owner", "asset", "place").distinct().join(members, "owner").where("place <= members")
    return weighted.where("weight is not null").select("owner", "asset").distinct().join(inside, ["owner", "asset"], "left_anti")


def risk(of: DataFrame, worth: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(owner, day, n, vol_pct, var95_pct, var99_pct, es95_pct, var95, drawdown_pct) of book() rows and totals().

    Volatility, value at risk (quantile by interpolation) and expected shortfall are daily and null below min_points; the
    drawdown is that of the equity that starts at 1. es95 is the mean of the worst max(1, round(n / 20)) days."""
    w = Window.partitionBy("owner")
    up = w.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    # a running product: exp of sums of logs, 0 from a loss of all on
    grown = F.when(F.min("ret").over(up) <= -1, 0.0).otherwise(F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(up)))
    d = of.withColumns({"_e": grown, "_k": F.row_number().over(w.orderBy("ret", "d")), "_n": F.count(F.lit(1)).over(w)})
    d = d.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_e").over(up)))
    worst = F.greatest(F.lit(1), F.bround((1 - F.lit(0.95)) * F.col("_n"), 0))
    d = d.groupBy("owner").agg(
        F.max("d").alias("day"), F.count(F.lit(1)).alias("n"), F.stddev_samp("ret").alias("vol"), (-F.expr("percentile(ret, 0.05)")).alias("v95"), (-F.expr("percentile(ret, 0.01)")).alias("v99"),
        (-F.avg(F.when(F.col("_k") <= worst, F.col("ret")))).alias("es"), F.round(F.max((F.col("_peak") - F.col("_e")) / F.col("_peak")) * 100, 2).alias("drawdown_pct"),
    )
    seen = lambda c, x: F.when(F.col("n") >= min_points, x).alias(c)
    pct = lambda c: F.round(F.col(c) * 100, 2)
    d = d.join(worth.select("owner", "total"), "owner")
    return d.select("owner", "day", "n", seen("vol_pct", pct("vol")), seen("var95_pct", pct("v95")), seen("var99_pct", pct("v99")), seen("es95_pct", pct("es")), seen("var95", F.round(F.col("v95") * F.col("total"), 2)), "drawdown_pct")


def risk_shares(rows: DataFrame, of: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(owner, asset, share_pct): each asset's part of the variance of the book, by Euler, to 1 place.

    Assets that have every date of the book take part, their weights scaled to 1; no rows below min_points dates,
    without variance, or where the weights do not sum to more than 0."""
    b = of.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("owner"))).where(F.col("_n") >= min_points)
    d = rows.join(b.select("owner", "d", F.col("ret").alias("_p"), "_n"), ["owner", "d"]).groupBy("owner", "asset")
    d = d.agg(F.first("weight").alias("weight"), F.count(F.lit(1)).alias("c"), F.first("_n").alias("n"), F.covar_pop("ret", "_p").alias("cov"), F.var_pop("_p").alias("var"))
    d = d.where("c = n and var > 0").withColumn("_w", F.sum("weight").over(Window.partitionBy("owner"))).where("_w > 0")
    return d.select("owner", "asset", F.round(F.col("weight") / F.col("_w") * F.col("cov") / F.col("var") * 100, 1).alias("share_pct"))


def factor_exposure(weights: DataFrame, betas: DataFrame) -> DataFrame:
    """(owner, factor, exposure): weights (owner, asset, weight) times betas (asset, factor, beta), summed, to 3 places; an
    asset without a beta adds nothing."""
    d = weights.where("weight is not null").join(betas.select("asset", "factor", "beta"), "asset")
    return d.groupBy("owner", "factor").agg(F.round(F.sum(F.col("weight") * F.col("beta")), 3).alias("exposure"))


def mean_r2(weights: DataFrame, fits: DataFrame) -> DataFrame:
    """(owner, avg_r2): r2 of fits (asset, r2) weighted, to 3 places; owners without fitted weight above 0 have no row."""
    d = weights.where("weight is not null").join(fits.select("asset", "r2"), "asset").groupBy("owner").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("r2")).alias("x"))
    return d.where("w > 0").select("owner", F.round(F.col("x") / F.col("w"), 3).alias("avg_r2"))


def settled_day(rets: DataFrame, market: DataFrame) -> DataFrame:
    """(asset, day): the newest date that both rets (asset, d) and the market (d) have."""
    return rets.join(market.select("d").distinct(), "d").groupBy("asset").agg(F.max("d").alias("day"))


def value_series(of: DataFrame, worth: DataFrame, snapshots: DataFrame | None = None, window: int = WINDOW) -> DataFrame:
    """(owner, d, value, pnl, source): value over time.

    Where an owner has two or more snapshots (owner, d, total, cost), the newest `window` of these, with pnl = total -
    cost; else the equity of the book scaled so that its last day has today's total (no rows where all was lost)."""
    up = Window.partitionBy("owner").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.min("ret").over(Window.partitionBy("owner")) <= -1
    d = of.withColumns({"_e": F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(up), "_lost": lost}).where("not _lost")
    d = d.withColumn("_last", F.max_by("_e", "d").over(Window.partitionBy("owner"))).join(worth.select("owner", "total"), "owner")
    none = F.lit(None).cast("double")
    d = d.select("owner", "d", F.round(F.exp(F.col("_e") - F.col("_last")) * F.col("total"), 2).alias("value"), none.alias("pnl"), F.lit("reconstructed").alias("source"))
    if snapshots is None:
        return d
    w = Window.partitionBy("owner")
    s = snapshots.withColumns({"_k": F.row_number().over(w.orderBy(F.desc("d"))), "_n": F.count(F.lit(1)).over(w)}).where((F.col("_n") >= 2) & (F.col("_k") <= window))
    s = s.select("owner", "d", F.col("total").alias("value"), F.round(F.col("total") - F.col("cost"), 2).alias("pnl"), F.lit("snapshots").alias("source"))
    return s.unionByName(d.join(s.select("owner").distinct(), "owner", "left_anti"))


def correlation_scale(entries: DataFrame, exposure: DataFrame, corr: DataFrame, threshold: float = 0.6, penalty: float = 0.5) -> DataFrame:
    """entries (owner, asset, direction) with scale: `penalty` where an open position of the owner in another asset
    (exposure: owner, asset, value) is correlated with it (corr: a, b, r, either way round) by the threshold or more
    and the entry adds to the same bet; else 1."""
    r = corr.where(F.abs("r") >= threshold).select("a", "b", "r")
    r = r.unionByName(r.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).where("a != b")
    bets = exposure.where("value != 0").join(r, F.col("asset") == F.col("b")).select("owner", F.col("a").alias("asset"), (F.signum("r") * F.signum("value")).cast("int").alias("direction")).distinct()
    d = entries.join(bets.withColumn("_hit", F.lit(True)), ["owner", "asset", "direction"], "left")
    return d.withColumn("scale", F.when(F.col("_hit"), penalty).otherwise(1.0)).drop("_hit")

