"""Scenarios, exposure, sizing and account limits as column expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.execution import DAILY_LOSS, GROSS_MARGIN, loss_reached


def scenario(betas: DataFrame, shocks: DataFrame) -> DataFrame:
    """(asset, move_pct, missing): betas (asset, factor, beta) times shocks (factor, shock), each contribution and
    their sum rounded to 2 places; missing counts the shocked factors that an asset has no beta for.

    Every asset of betas has a row; a factor without a shock adds nothing."""
    many = shocks.agg(F.count(F.lit(1)).alias("shocks"))
    d = betas.join(shocks, "factor", "left").withColumn("part", F.round(F.col("beta") * F.col("shock"), 2))
    d = d.groupBy("asset").agg(F.coalesce(F.round(F.sum("part"), 2), F.lit(0.0)).alias("move_pct"), F.count("part").alias("hit"))
    return d.join(F.broadcast(many)).select("asset", "move_pct", (F.col("shocks") - F.col("hit")).alias("missing"))


def portfolio_move(weights: DataFrame, moves: DataFrame) -> DataFrame:
    """(owner, move_pct): weights (owner, asset, weight) times moves; an asset without a move adds nothing."""
    d = weights.join(moves.select("asset", "move_pct"), "asset", "left")
    return d.groupBy("owner").agg(F.coalesce(F.round(F.sum(F.col("weight") * F.col("move_pct")), 2), F.lit(0.0)).alias("move_pct"))


def exposure(positions: DataFrame, by: str) -> DataFrame:
    """(owner, <by>, value, share): value of positions (owner, ..., value) by a column, and its share of the owner's total."""
    d = positions.groupBy("owner", F.coalesce(by, F.lit("unknown")).alias(by)).agg(F.sum("value").alias("value"))
    return d.withColumn("share", F.col("value") / F.nullif(F.sum("value").over(Window.partitionBy("owner")), F.lit(0.0)))


def contract_risk(price: Column, vol: Column, tick: Column, tick_value: Column, floor: float = 0.005) -> Column:
    """Money at one deviation of one bar for one contract; the volatility is at least `floor`, 0 where it is unknown."""
    return F.when((tick > 0) & (vol > 0), F.greatest(vol, F.lit(floor)) * (price / tick) * tick_value).otherwise(0.0)


def conviction(p: Column, payoff: float = 1.0, ref: float = 0.7) -> Column:
    """Kelly fraction of p over that of ref, within 0 and 1; where that of ref is not above 0: 1 for any edge, else 0."""
    payoff = max(1e-9, payoff)
    kelly = lambda x: (x * (payoff + 1) - 1) / payoff
    if kelly(ref) <= 0:
        return F.when(kelly(p) > 0, 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(kelly(p) / kelly(ref), F.lit(1.0)))


def vol_target_qty(equity: Column, risk: Column, target_pct: float, most: int) -> Column:
    raw = target_pct / 100 * equity / F.nullif(risk, F.lit(0.0))
    return F.when(risk <= 0, min(1, most)).otherwise(F.floor(F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(most))))).cast("int")


def sized_qty(base: Column, p_win: Column, threshold: float = 0.55, most: int = 5, ref: float = 0.7) -> Column:
    """The base by volatility times the weight of conviction, halves to even, at least 1 where the base is and the
    weight is not 0; 0 below the threshold."""
    w = conviction(p_win, ref=ref)
    qty = F.bround(base * w).cast("int")
    qty = F.when((qty < 1) & (base >= 1) & (w > 0), 1).otherwise(qty)
    return F.when(p_win < threshold, 0).otherwise(F.least(qty, F.lit(most)))


def sized(rows: DataFrame, threshold: float = 0.55, target_pct: float = 1.0, most: int = 5) -> DataFrame:
    """rows (p_win, equity, price, vol, tick, tick_value) with risk, base and qty (see sized_qty)."""
    d = rows.withColumn("risk", contract_risk(F.col("price"), F.col("vol"), F.col("tick"), F.col("tick_value")))
    d = d.withColumn("base", vol_target_qty(F.col("equity"), F.col("risk"), target_pct, most))
    return d.withColumn("qty", sized_qty(F.col("base"), F.col("p_win"), threshold, most))


def drawdowns(equity: DataFrame, limit_pct: float = 20.0) -> DataFrame:
    """equity (account, at, equity) with drawdown_pct from the peak so far, scale (1 at none, 0 at the limit) and
    breached (the largest drawdown so far has reached the limit); without a limit above 0 nothing is scaled or breached."""
    w = Window.partitionBy("account").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("equity").over(w)
    d = equity.withColumn("drawdown_pct", F.when(peak > 0, (peak - F.col("equity")) / peak * 100).otherwise(0.0))
    if limit_pct <= 0:
        return d.withColumns({"scale": F.lit(1.0), "breached": F.lit(False)})
    d = d.withColumn("scale", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("drawdown_pct") / limit_pct)))
    return d.withColumn("breached", (F.count(F.lit(1)).over(w) >= 2) & (F.max("drawdown_pct").over(w) >= limit_pct))


def account_checks(rows: DataFrame, daily_pct: float = DAILY_LOSS, margin_pct: float = GROSS_MARGIN) -> DataFrame:
    """rows (day_peak, equity, margin_used) with daily_loss, gross_margin and halt."""
    margin = (F.col("equity") > 0) & (F.col("margin_used") >= margin_pct / 100 * F.col("equity"))
    flags = {"daily_loss": loss_reached(F.col("day_peak"), F.col("equity"), daily_pct), "gross_margin": F.coalesce(margin, F.lit(False))}
    return rows.withColumns(flags).withColumn("halt", F.col("daily_loss") | F.col("gross_margin"))


def margin_used(positions: DataFrame, specs: DataFrame) -> DataFrame:
    """(account, margin): sum of |qty| times the initial margin of the contract; contracts without a spec add nothing."""
    d = positions.join(specs.select("code", "initial_margin"), "code")
    return d.groupBy("account").agg(F.sum(F.abs("qty") * F.coalesce("initial_margin", F.lit(0.0))).alias("margin"))


def classification(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (gold, found): confusion (gold, found, n), and per class (label, precision, recall, f1, support).

    Counts come first, one row a pair of labels; the measures need no second look at the rows. A measure without a
    denominator is 0."""
    pairs = rows.where("gold is not null and found is not null").groupBy("gold", "found").agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("gold") == F.col("found"), F.col("n")).otherwise(0))
    said = pairs.groupBy(F.col("found").alias("label")).agg(F.sum("n").alias("said"))
    meant = pairs.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    d = said.join(meant, "label", "full").na.fill(0, ["said", "support", "tp"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("said")), share(F.col("tp"), F.col("support"))
    return pairs, d.select("label", p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"), "support")


def average_cost(trades: DataFrame) -> DataFrame:
    """(owner, asset, qty, avg_cost, cost): held quantity and average cost of buys of trades (owner, asset, qty, price)."""
    buys = F.when(F.col("qty") > 0, F.col("qty"))
    d = trades.groupBy("owner", "asset").agg(F.sum("qty").alias("qty"), (F.sum(buys * F.col("price")) / F.nullif(F.sum(buys), F.lit(0.0))).alias("avg_cost"))
    return d.withColumn("cost", F.col("qty") * F.col("avg_cost"))
