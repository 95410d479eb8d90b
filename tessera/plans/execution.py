"""Queries of the execution, limit and overfitting operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import execution
from tessera.operators import backtest as bt
from tessera.plans.market import BARS, SMA_CROSS, W, frame, rounded
from tessera.plans.news import TECH, technical_rows
from tessera.plans.registry import register
from tessera.sources.tables import bars_1d, table

DEC = f"""v as (select s.sym, s.d, s.close, s.signal, b.volume, b.high, b.low, coalesce(lag(s.signal) over (partition by s.sym order by s.d), 0) as prev from s join bars b on s.sym = b.sym and s.d = b.d),
f as (select *, case when count(volume) over p = 20 then (volume - avg(volume) over p) / nullif(stddev_pop(volume) over p, 0) end as vol_z, (close - min(low) over {frame(20)}) / nullif(max(high) over {frame(20)} - min(low) over {frame(20)}, 0) as place,
  (close / nullif(lag(close) over {W}, 0) - 1) * 100 as move_pct from v window p as (partition by sym order by d rows between 20 preceding and 1 preceding))"""


def decided(spark, sf_dir):
    return execution.decisions(bt.sma_cross(bars_1d(spark, sf_dir)))


@register("decisions", f"with {BARS}, {SMA_CROSS}, {DEC} select sym, d, signal, round(vol_z, 6) as vol_z, round(place, 6) as place, round(move_pct, 6) as move_pct from f where signal <> prev")
def decisions(spark, sf_dir):
    return rounded(decided(spark, sf_dir).select("sym", "d", "signal", "vol_z", "place", "move_pct"), "vol_z", "place", "move_pct")


@register("fills", f"""with {BARS}, {SMA_CROSS}, {DEC}, q as (select *, case when signal = 1 then 1 else -1 end as side, 1 + dayofmonth(d) % 4 as qty from f where signal <> prev)
select sym, d, qty::int as qty, round(close + side * (1 + 0.5 * greatest(0, qty - 1)) * least(3.0, greatest(1.0, 1 - 0.5 * coalesce(vol_z, 0))) * 0.01, 6) as fill from q""")
def fills(spark, sf_dir):
    d = decided(spark, sf_dir).withColumns({"side": F.when(F.col("signal") == 1, 1).otherwise(-1), "qty": 1 + F.dayofmonth("d") % 4})
    fill = execution.fill_price(F.col("close"), F.col("side"), 0.01, execution.slippage_ticks(F.col("qty"), F.col("vol_z")))
    return d.select("sym", "d", F.col("qty").cast("int").alias("qty"), F.round(fill, 6).alias("fill"))


@register("price_jumps", f"with {BARS} select sym, d, coalesce(lag(close) over {W} > 0 and abs(close / lag(close) over {W} - 1) * 100 > 25, false) as jump from bars")
def price_jumps(spark, sf_dir):
    return execution.jumps(bars_1d(spark, sf_dir)).select("sym", "d", "jump")


@register("daily_loss_halts", """with e as (select event_id, user_id % 3 as account, ts, 1000 + value as equity from events), p as (select *, max(equity) over (partition by account, ts::date order by ts rows unbounded preceding) as peak from e)
select event_id, coalesce(peak > 0 and peak - equity >= 6 / 100.0::double * peak, false) as halted from p""")
def daily_loss_halts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("account"), "ts", (1000 + F.col("value")).alias("equity"))
    return execution.daily_loss(e).select("event_id", "halted")


@register("margin_budget", "select o_orderkey, greatest(0, least(5, floor((o_totalprice * 60 / 100 - 20000) / (500 + o_orderkey % 9000))))::int as qty from orders")
def margin_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(5).cast("long").alias("desired"), F.col("o_totalprice").alias("equity"), F.lit(20000.0).alias("used"), (500 + F.col("o_orderkey") % 9000).cast("double").alias("margin"))
    return execution.margin_budget(o).select("o_orderkey", "qty")


@register("backtest_overfitting", f"""with {BARS}, r as (select sym as strategy, month(d) as split, day(d) <= 15 as ins, close from bars), p as (select split, strategy, avg(close) filter (ins) as inside, avg(close) filter (not ins) as outside from r group by 1, 2),
k as (select *, row_number() over (partition by split order by inside desc, strategy) as best, cume_dist() over (partition by split order by outside) as rank, count(*) over (partition by split) as n from p)
select round(avg((rank <= 0.5)::int::double), 6) as pbo, count(*) as splits from k where best = 1 and n >= 2""")
def backtest_overfitting(spark, sf_dir):
    half = F.dayofmonth("d") <= 15
    p = bars_1d(spark, sf_dir).groupBy(F.month("d").alias("split"), F.col("sym").alias("strategy")).agg(F.avg(F.when(half, F.col("close"))).alias("inside"), F.avg(F.when(~half, F.col("close"))).alias("outside"))
    return rounded(execution.overfitting(p), "pbo")


@register("macro_snapshot", "select l_returnflag as indicator, max(l_shipdate) as ts, max(l_extendedprice) filter (l_shipdate = m) as value from (select *, max(l_shipdate) over (partition by l_returnflag) as m from lineitem) group by 1")
def macro_snapshot(spark, sf_dir):
    return execution.latest_values(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("indicator"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value")))


@register("alert_precision", f"""with {BARS}, {TECH}, n as (select sym, d, (lead(close, 5) over {W} / close - 1) * 100 as move from bars), x as (select kind, move from al join n using (sym, d) where move is not null)
select kind, count(*) as n, count(*) filter (abs(move) >= 1) as hits, round(count(*) filter (abs(move) >= 1) / count(*)::double, 6) as precision from x group by 1""")
def alert_precision(spark, sf_dir):
    w = Window.partitionBy("sym").orderBy("d")
    move = bars_1d(spark, sf_dir).select("sym", "d", ((F.lead("close", 5).over(w) / F.col("close") - 1) * 100).alias("move"))
    return rounded(execution.alert_precision(technical_rows(spark, sf_dir).join(move, ["sym", "d"])), "precision")
