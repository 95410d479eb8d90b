"""Queries of MACD history, long/short signals, news overlays, scenarios, exposure, sizing and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import backtest as bt
from tessera.operators import directional as dr
from tessera.operators import exposure as ex
from tessera.operators import indicators as ind
from tessera.plans.market import BARS, CANDLES, HITS, RSI, W, frame, full, rounded
from tessera.plans.news import ART, SYMS, articles
from tessera.plans.registry import register
from tessera.sources.tables import bars_1d, table


def _ema(name: str, of: str, n: int, first: int = 1) -> str:
    """EMA of rows (sym, i, v) from i = first on, seeded by the mean of the first n, as a recursive member."""
    seed = first + n - 1
    return f"""{name}(sym, i, v) as (select sym, {seed}::bigint, avg(v) from {of} where i between {first} and {seed} group by sym having count(*) = {n}
  union all select x.sym, x.i, e.v * (1 - 2.0::double / {n + 1}) + x.v * (2.0::double / {n + 1}) from {name} e join {of} x on x.sym = e.sym and x.i = e.i + 1)"""


MACD = f"""nb as materialized (select sym, d, row_number() over {W} as i, close::double as v from bars),
{_ema('ef', 'nb', 12)}, {_ema('es', 'nb', 26)},
ln as materialized (select es.sym, es.i, ef.v - es.v as v from es join ef using (sym, i)),
{_ema('eg', 'ln', 9, 26)},
mh as materialized (select nb.sym, nb.d, ln.v - eg.v as hist from nb left join eg on nb.sym = eg.sym and nb.i = eg.i left join ln on nb.sym = ln.sym and nb.i = ln.i)"""


@register("macd_history", f"with recursive {BARS}, {MACD} select sym, d, round(hist, 2) as macd_hist from mh")
def macd_history(spark, sf_dir):
    return rounded(dr.macd_history(bars_1d(spark, sf_dir)), "macd_hist", at=2)


@register("signal_macd_cross", f"with recursive {BARS}, {MACD} select sym, d, coalesce(hist > 0, false)::int as signal from mh")
def signal_macd_cross(spark, sf_dir):
    return dr.macd_signals(bars_1d(spark, sf_dir))


def _steps(name: str, of: str, long: str, short: str, leave_long: str, leave_short: str) -> str:
    """The position as a recursion over bars numbered i."""
    x = lambda c: f"coalesce({c}, false)"
    flat = f"case when {x(long)} then 1 when {x(short)} then -1 else 0 end"
    return f"""{name}n as materialized (select *, row_number() over {W} as i from {of}),
{name}(sym, d, i, pos) as (select sym, d, i, {flat} from {name}n where i = 1
  union all select n.sym, n.d, n.i, case s.pos when 0 then {flat} when 1 then case when {x(leave_long)} then 0 else 1 end else case when {x(leave_short)} then 0 else -1 end end from {name} s join {name}n n on n.sym = s.sym and n.i = s.i + 1)"""


BAND = f"bm as (select sym, d, close, {full(f'avg(close) over {frame(20)}', 'close', 20)} as mid, {full(f'stddev_samp(close) over {frame(20)}', 'close', 20)} as dev from bars), bb as (select sym, d, close, round(mid - 2 * dev, 2) as lo, round(mid, 2) as m, round(mid + 2 * dev, 2) as hi from bm), rr as (select sym, d, round(rsi, 2) as rs from r)"


@register("signals_directional", f"""with recursive {BARS}, {RSI}, {MACD}, {BAND}, {HITS}, {CANDLES},
{_steps('ps', 'rr', 'rs < 30', 'rs > 70', 'rs >= 50', 'rs <= 50')}, {_steps('pb', 'bb', 'close <= lo', 'close >= hi', 'close >= m', 'close <= m')},
sm as (select sym, d, {full(f'avg(close) over {frame(20)}', 'close', 20)} as f, {full(f'avg(close) over {frame(50)}', 'close', 50)} as s, close, lag(close, 20) over {W} as past from bars)
select 'sma_cross' as strategy, sym, d, (case when s is null then 0 when f > s then 1 else -1 end)::int as signal from sm
union all select 'momentum', sym, d, (case when past is null then 0 when close > past then 1 else -1 end)::int from sm
union all select 'macd', sym, d, (case when hist is null then 0 when hist > 0 then 1 else -1 end)::int from mh
union all select 'rsi', sym, d, pos::int from ps union all select 'bollinger', sym, d, pos::int from pb union all select 'candles', sym, d, pos::int from cb""")
def signals_directional(spark, sf_dir):
    bars, out = bars_1d(spark, sf_dir), None
    for name, of in dr.STRATEGIES.items():
        one = of(bars).select(F.lit(name).alias("strategy"), "sym", "d", "signal")
        out = one if out is None else out.unionByName(one)
    return out


SCORED = f"sc as (select ['{SYMS[0]}', '{SYMS[1]}', '{SYMS[2]}', '{SYMS[3]}', '{SYMS[4]}'][1 + asset_id % 5] as sym, (ts - interval 9000 day)::date as d, score from art), sd as (select sym, d, sum(score) as score from sc group by all), nw as (select b.sym, b.d, b.close, round(coalesce((select sum(score) from sd where sd.sym = b.sym and sd.d between b.d - 5 and b.d), 0), 9) as news from bars b)"


def scored(spark, sf_dir):
    sym = F.get(F.array(*[F.lit(s) for s in SYMS]), (F.col("asset_id") % 5).cast("int"))
    return articles(spark, sf_dir).select(sym.alias("sym"), F.date_sub(F.to_date("ts"), 9000).alias("d"), "score")


@register("signal_news", f"with {ART}, {BARS}, {SCORED} select sym, d, (news > 0)::int as news_long, (news >= 0)::int as news_gate from nw")
def signal_news(spark, sf_dir):
    return dr.news_signals(bars_1d(spark, sf_dir), scored(spark, sf_dir))


@register("signal_momentum_gated", f"with {ART}, {BARS}, {SCORED}, p as (select sym, d, close > lag(close, 20) over {W} as up from bars) select sym, d, (coalesce(up, false) and news >= 0)::int as signal from p join nw using (sym, d)")
def signal_momentum_gated(spark, sf_dir):
    bars = bars_1d(spark, sf_dir)
    return dr.combine_and(bt.momentum(bars).select("sym", "d", "signal"), dr.news_signals(bars, scored(spark, sf_dir)))


@register("mood_divergence", f"""with {ART}, {BARS}, {SCORED}, p as (select sym, d, (close / nullif(lag(close, 5) over {W}, 0) - 1) * 100 as c from bars), j as (select p.sym, p.d, p.c, nw.news as m from p join nw using (sym, d))
select sym, d, round(c, 6) as change_pct, round(m, 6) as mood, coalesce(abs(c) >= 1 and abs(m) >= 0.1 and (c > 0) <> (m > 0), false) as diverging from j""")
def mood_divergence(spark, sf_dir):
    bars = bars_1d(spark, sf_dir)
    mood = dr.news_score(bars, scored(spark, sf_dir)).select("sym", "d", F.round("news", 9).alias("mood"))
    return rounded(dr.divergence(bars, mood), "change_pct", "mood")


@register("thin_sessions", f"""with {BARS}, z as (select sym, d, volume, {full(f'(volume - avg(volume) over {frame(20)}) / nullif(stddev_samp(volume) over {frame(20)}, 0)', 'volume', 20)} as z from bars)
select sym, d, round(z, 6) as volume_z, volume <= 0 or coalesce(round(z, 9) < -1.5, false) as thin from z""")
def thin_sessions(spark, sf_dir):
    return rounded(dr.thin_liquidity(bars_1d(spark, sf_dir)), "volume_z")


BETAS = "bt as (select n_name as asset, f.factor, ((n_nationkey * 7 + f.k * 5) % 13 - 4) / 10.0::double as beta from nation, (values ('market', 0), ('oil', 1), ('rate', 2), ('usd', 3)) f(factor, k) where (n_nationkey + f.k) % 4 <> 0), sh(factor, shock) as (values ('market', -5.0::double), ('oil', 12.5), ('usd', 3.3)), mv as (select asset, coalesce(round(sum(round(beta * shock, 2)), 2), 0) as move_pct, 3 - count(shock) as missing from bt left join sh using (factor) group by asset)"


def _betas(spark, sf_dir):
    f = spark.createDataFrame([("market", 0), ("oil", 1), ("rate", 2), ("usd", 3)], "factor string, k int")
    n = table(spark, sf_dir, "nation").join(F.broadcast(f)).where("(n_nationkey + k) % 4 != 0")
    return n.select(F.col("n_name").alias("asset"), "factor", (((F.col("n_nationkey") * 7 + F.col("k") * 5) % 13 - 4) / 10.0).alias("beta"))


def _shocks(spark):
    return spark.createDataFrame([("market", -5.0), ("oil", 12.5), ("usd", 3.3)], "factor string, shock double")


@register("whatif_assets", f"with {BETAS} select * from mv")
def whatif_assets(spark, sf_dir):
    return ex.scenario(_betas(spark, sf_dir), _shocks(spark))


HELD = "po as (select c_mktsegment as owner, n_name as asset, r_name as region, c_acctbal::double as value from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal > 0)"


def _held(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    d = t("customer").where("c_acctbal > 0").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select(F.col("c_mktsegment").alias("owner"), F.col("n_name").alias("asset"), F.col("r_name").alias("region"), F.col("c_acctbal").cast("double").alias("value"))


@register("whatif_portfolios", f"with {BETAS}, {HELD}, w as (select owner, asset, sum(value) / sum(sum(value)) over (partition by owner) as weight from po group by owner, asset) select owner, coalesce(round(sum(weight * move_pct), 2), 0) as move_pct from w left join mv using (asset) group by owner")
def whatif_portfolios(spark, sf_dir):
    weights = ex.exposure(_held(spark, sf_dir), "asset").select("owner", "asset", F.col("share").alias("weight"))
    return ex.portfolio_move(weights, ex.scenario(_betas(spark, sf_dir), _shocks(spark)))


@register("portfolio_exposure", f"with {HELD}, g as (select owner, region, sum(value) as value from po group by all) select owner, region, round(value, 4) as value, round(value / sum(value) over (partition by owner), 8) as share from g")
def portfolio_exposure(spark, sf_dir):
    d = ex.exposure(_held(spark, sf_dir), "region")
    return d.select("owner", "region", F.round("value", 4).alias("value"), F.round("share", 8).alias("share"))


@register("cost_basis", """with t as (select o_custkey as owner, l_partkey % 50 as asset, (case when l_returnflag = 'R' then -1 else 1 end) * l_quantity::double as qty, l_extendedprice::double / l_quantity::double as price from lineitem join orders on l_orderkey = o_orderkey)
select owner, asset, sum(qty) as qty, round(sum(case when qty > 0 then qty * price end) / sum(case when qty > 0 then qty end), 7) as avg_cost from t group by all""")
def cost_basis(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    q = F.col("l_quantity").cast("double")
    t = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("owner"), (F.col("l_partkey") % 50).alias("asset"), (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * q).alias("qty"), (F.col("l_extendedprice").cast("double") / q).alias("price"))
    return ex.average_cost(t).select("owner", "asset", "qty", F.round("avg_cost", 7).alias("avg_cost"))


@register("sized_entries", f"""with {BARS}, r as (select sym, d, close, close / lag(close) over {W} - 1 as ret from bars),
v as (select sym, d, close, {full(f'stddev_samp(ret) over {frame(20)}', 'ret', 20)} as vol, 0.5 + (day(d) % 11) / 25.0::double as p from r),
k as (select *, case when vol > 0 then greatest(vol, 0.005) * (close / 0.5) * 0.01 else 0 end::double as risk from v),
b as (select *, (case when risk <= 0 then 1 else floor(least(greatest(0.01 * 1000000 / nullif(risk, 0), 0), 12)) end)::int as base, greatest(0, least((p * 2 - 1) / (0.7 * 2 - 1), 1))::double as w from k),
q as (select *, round_even(base * w, 0)::int as q from b)
select sym, d, base, (case when p < 0.55 then 0 when q < 1 and base >= 1 and w > 0 then 1 else least(q, 12) end)::int as qty from q""")
def sized_entries(spark, sf_dir):
    w = ind.by_symbol()
    r = bars_1d(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    vol = ind.full(F.stddev_samp("ret").over(ind.last(20)), F.col("ret"), 20)
    rows = r.select("sym", "d", F.lit(1_000_000.0).alias("equity"), F.col("close").cast("double").alias("price"), vol.alias("vol"), F.lit(0.5).alias("tick"), F.lit(0.01).alias("tick_value"), (0.5 + (F.dayofmonth("d") % 11) / 25.0).alias("p_win"))
    return ex.sized(rows, most=12).select("sym", "d", "base", "qty")


@register("account_drawdowns", f"""with {BARS}, p as (select sym as account, d as "at", close::double as equity, max(close::double) over (partition by sym order by d rows unbounded preceding) as peak, row_number() over {W} as n from bars),
k as (select *, (peak - equity) / peak * 100 as dd from p)
select account, "at", round(dd, 6) as drawdown_pct, round(greatest(0, least(1, 1 - dd / 20)), 6) as scale, n >= 2 and max(dd) over (partition by account order by "at" rows unbounded preceding) >= 20 as breached from k""")
def account_drawdowns(spark, sf_dir):
    e = bars_1d(spark, sf_dir).select(F.col("sym").alias("account"), F.col("d").alias("at"), F.col("close").cast("double").alias("equity"))
    return rounded(ex.drawdowns(e).select("account", "at", "drawdown_pct", "scale", "breached"), "drawdown_pct", "scale")


@register("account_checks", """with a as (select c_custkey, c_acctbal::double + 1000 as day_peak, c_acctbal::double + 1000 - c_custkey % 300 as equity, (c_custkey % 17) * 100.0::double as margin_used from customer)
select c_custkey, day_peak > 0 and day_peak - equity >= 6 / 100.0::double * day_peak as daily_loss, equity > 0 and margin_used >= 80 / 100.0::double * equity as gross_margin, (day_peak > 0 and day_peak - equity >= 6 / 100.0::double * day_peak) or (equity > 0 and margin_used >= 80 / 100.0::double * equity) as halt from a""")
def account_checks(spark, sf_dir):
    peak = F.col("c_acctbal").cast("double") + 1000
    rows = table(spark, sf_dir, "customer").select("c_custkey", peak.alias("day_peak"), (peak - F.col("c_custkey") % 300).alias("equity"), (F.col("c_custkey") % 17 * 100.0).alias("margin_used"))
    return ex.account_checks(rows).select("c_custkey", "daily_loss", "gross_margin", "halt")


@register("margin_used", """select o_custkey as account, sum(abs(q) * m)::double as margin from (select o_custkey, l_suppkey as code, (case when l_returnflag = 'R' then -1 else 1 end) * l_quantity::double as q from lineitem join orders on l_orderkey = o_orderkey) join (select s_suppkey as code, s_acctbal::double as m from supplier) using (code) group by 1""")
def margin_used(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pos = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("account"), F.col("l_suppkey").alias("code"), (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_quantity").cast("double")).alias("qty"))
    specs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").cast("double").alias("initial_margin"))
    return rounded(ex.margin_used(pos, specs), "margin", at=4)


GOLD = "g as (select l_returnflag as gold, case when l_discount > 0.06 then 'R' when l_shipdate > date '1995-06-17' then 'N' else 'A' end as found from lineitem), p as (select gold, found, count(*) as n from g group by all)"


def _gold(spark, sf_dir):
    found = F.when(F.col("l_discount") > 0.06, "R").when(F.col("l_shipdate") > F.lit("1995-06-17").cast("date"), "N").otherwise("A")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("gold"), found.alias("found"))


@register("confusion", f"with {GOLD} select gold, found, n from p")
def confusion(spark, sf_dir):
    return ex.classification(_gold(spark, sf_dir))[0]


@register("class_metrics", f"""with {GOLD}, s as (select found as label, sum(n) as said from p group by 1), m as (select gold as label, sum(n) as support, sum(n) filter (gold = found) as tp from p group by 1),
x as (select label, coalesce(support, 0)::bigint as support, coalesce(case when said > 0 then coalesce(tp, 0) / said end, 0) as precision, coalesce(case when support > 0 then coalesce(tp, 0) / support end, 0) as recall from s full join m using (label))
select label, round(precision, 8) as precision, round(recall, 8) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 8) as f1, support from x""")
def class_metrics(spark, sf_dir):
    return rounded(ex.classification(_gold(spark, sf_dir))[1], "precision", "recall", "f1", at=8)
