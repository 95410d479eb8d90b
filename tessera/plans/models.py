"""Queries of the model, evaluation and risk operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import session
from tessera.operators import indicators as ind
from tessera.operators import futures, models, policy, stats, story
from tessera.plans.market import BARS, RETS, W, index_returns, rounded
from tessera.plans.registry import register
from tessera.sources.tables import bars_1d, table


@register("ols_attribution")
def ols_attribution(spark, sf_dir):
    session.ship(spark)
    rets = stats.returns(bars_1d(spark, sf_dir))
    f = rets.where("sym = '1-URGENT'").select("d", F.col("ret").alias("peer")).join(index_returns(spark, sf_dir).withColumnRenamed("iret", "market"), "d")
    return rounded(models.ols_attribution(rets.where("sym <> '1-URGENT'"), f), "beta", "contribution")


@register("market_regimes")
def market_regimes(spark, sf_dir):
    session.ship(spark)
    v = ind.volatility(bars_1d(spark, sf_dir)).where("volatility > 0")
    return models.regimes(v.select(F.col("sym").alias("key"), "d", F.log("volatility").alias("x")), ["x"], min_points=100)


@register("stories")
def stories(spark, sf_dir):
    session.ship(spark)
    e = table(spark, sf_dir, "embeddings")
    return models.stories(e.select(F.col("label").alias("bucket"), F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


@register("evaluation_metrics", f"""with {RETS} select sym as key, count(*) as n, round(avg(ret) / nullif(stddev_samp(ret), 0), 6) as sharpe, round(avg(ret) / nullif(sqrt(avg(ret * ret) filter (ret < 0)), 0), 6) as sortino,
  round(sum(ret) filter (ret > 0) / nullif(-sum(ret) filter (ret < 0), 0), 6) as profit_factor from rets group by 1""")
def evaluation_metrics(spark, sf_dir):
    return rounded(models.evaluation(stats.returns(bars_1d(spark, sf_dir)).select(F.col("sym").alias("key"), "ret")), "sharpe", "sortino", "profit_factor")


@register("calibration", "select event_type as key, count(*) as n, round(avg(power(value / 500 - (event_id % 2), 2)), 6) as brier, round(abs(avg(value / 500) - avg((event_id % 2)::double)), 6) as gap from events group by 1")
def calibration(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), (F.col("event_id") % 2).cast("double").alias("y"), (F.col("value") / 500).alias("p"))
    return rounded(models.calibration(e), "brier", "gap")


@register("position_sizes", """with x as (select event_id, p, greatest(0, least(1, (2 * p - 1) / (2 * 0.7::double - 1))) as w, least(5, floor(100000 * 1.0::double / 100 / (50 + event_id % 900))) as b from (select *, value / 500 as p from events)),
y as (select *, round_even(b * w, 0) as q from x)
select event_id, (case when p < 0.55 then 0 when q < 1 and b >= 1 and w > 0 then 1 else least(q, 5) end)::int as qty from y""")
def position_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500).alias("p_win"), F.lit(100000.0).alias("equity"), (50 + F.col("event_id") % 900).cast("double").alias("risk"))
    return models.position_size(e, ref=0.7).select("event_id", "qty")


@register("purged_folds", f"""with {BARS}, l as (select sym, row_number() over {W} - 1 as i, d as start, d + 5 as "end" from bars), o as (select *, floor(i * 5 / count(*) over (partition by sym)::double)::int as own from l),
s as (select sym, own as fold, min(start) as lo, max("end") as hi from o group by 1, 2)
select sym, fold, i, case when own = fold then 'test' else 'train' end as part from o join s using (sym) where own = fold or "end" < lo or start > hi""")
def purged_folds(spark, sf_dir):
    rows = bars_1d(spark, sf_dir).select("sym", (F.row_number().over(ind.by_symbol()) - 1).cast("long").alias("i"), F.col("d").alias("start"), F.date_add("d", 5).alias("end"))
    return models.purged_folds(rows)


@register("shift_positions", f"with {BARS} select sym, d, coalesce(lead(close, 2) over {W}, last_value(close) over (partition by sym order by d rows between unbounded preceding and unbounded following)) as shifted from bars")
def shift_positions(spark, sf_dir):
    return models.shift_back(bars_1d(spark, sf_dir)).select("sym", "d", "shifted")


@register("peer_returns", f"with {RETS} select d, round(avg(ret), 8) as ret, count(*) as n from rets group by 1 having count(*) >= ceil((select count(distinct sym) from rets) * 0.6::double)")
def peer_returns(spark, sf_dir):
    return rounded(models.peer_returns(stats.returns(bars_1d(spark, sf_dir))), "ret", at=8)


@register("metric_drift", """with r as (select event_type as key, ts::date as "at", avg(value) as value from events group by 1, 2),
m as (select *, avg(value) over w as mean, count(*) over w as n from r window w as (partition by key order by "at" rows between unbounded preceding and 1 preceding))
select key, "at", coalesce(n >= 3 and mean > 0 and value < 0.85 * mean, false) as drifted from m""")
def metric_drift(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("at")).agg(F.avg("value").alias("value"))
    return models.drift(r).select("key", "at", "drifted")


@register("gross_net_exposure", "select round(sum(abs(x)), 2) as gross, round(sum(x), 2) as net from (select (case when l_linenumber % 2 = 0 then 1 else -1 end) * l_quantity * l_extendedprice / 0.5 * 0.05 as x from lineitem)")
def gross_net_exposure(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.lit("c").alias("code"), (F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1) * F.col("l_quantity")).alias("qty"), F.col("l_extendedprice").alias("price"))
    specs = spark.createDataFrame([("c", 0.5, 0.05)], "code string, tick double, tick_value double")
    return rounded(models.exposure(p, F.broadcast(specs)), "gross", "net", at=2)


@register("term_structure", f"""with {BARS}, q as (select d as ts, sym as contract, close, row_number() over (partition by d order by sym) as k from bars)
select a.ts, round((b.close / a.close - 1) * 100, 6) as slope_pct from q a join q b on a.ts = b.ts and a.k = 1 and b.k = 2""")
def term_structure(spark, sf_dir):
    q = bars_1d(spark, sf_dir).select(F.col("d").alias("ts"), F.col("sym").alias("contract"), F.substring("sym", 1, 1).cast("int").alias("expiry"), "close")
    return rounded(models.term_slope(q), "slope_pct")


@register("upcoming_orders", "select o_orderkey, o_orderdate::date as d, date_diff('day', date '1998-01-01', o_orderdate::date)::int as days_left from orders where o_orderdate::date between date '1998-01-01' and date '1998-01-08'")
def upcoming_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return models.upcoming(o, "1998-01-01", 7)


@register("stories_72h")
def stories_72h(spark, sf_dir):
    """Every vector as an article of its label, 17 minutes apart."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("bucket"), F.col("vec_id").alias("id"), F.timestamp_seconds(1704067200 + F.col("vec_id") * 1020).alias("ts"), F.col("embedding").alias("v"))
    return story.windowed(v)


#: What a decision knows of its bar.
KNOWN = ["ret_1", "ret_5", "ret_20", "sma_gap_20", "range_pos", "vol_z"]


@register("policy_holdout")
def policy_holdout(spark, sf_dir):
    """Chances and contracts of the newest decisions (one a bar, in the direction of its 20-bar move), by a filter that learnt from the older ones."""
    bars, w = bars_1d(spark, sf_dir), ind.by_symbol()
    c, v, last20 = F.col("close"), F.col("volume").cast("double"), w.rowsBetween(-19, 0)
    low, high = F.min("low").over(last20), F.max("high").over(last20)
    seen = {f"ret_{n}": ind.change_pct(c, n) for n in (1, 5, 20)} | {"sma_gap_20": (c / ind.sma(c, 20) - 1) * 100, "range_pos": (c - low) / F.nullif(high - low, F.lit(0.0)), "vol_z": (v - F.avg(v).over(last20)) / F.nullif(F.stddev_samp(v).over(last20), F.lit(0.0))}
    rows = bars.withColumns(seen).withColumn("signed_qty", F.signum("ret_20").cast("int")).where("signed_qty <> 0")
    rows = rows.join(futures.triple_barrier(bars), ["sym", "d"]).withColumn("win", (F.col("label") == F.col("signed_qty")).cast("int")).select("sym", "d", "signed_qty", "win", *KNOWN)
    learnt, _ = policy.train(rows, KNOWN, "d")
    if learnt is None:
        return spark.createDataFrame([], "sym string, d date, win int, p_win double, qty int")
    held = learnt.score(policy.cut(rows, "d", policy.TEST)[1])
    return held.select("sym", "d", "win", F.round("p_win", 6).alias("p_win"), policy.decide(F.col("signed_qty"), F.col("p_win")).alias("qty"))
