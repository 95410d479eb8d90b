"""Queries of the price-series operators, on daily bars by order priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import backtest as bt
from tessera.operators import candlesticks, prices, stats
from tessera.operators import indicators as ind
from tessera.plans.registry import register
from tessera.sources.tables import bars_1d, table

BARS = """bars as (
  select o_orderpriority as sym, o_orderdate::date as d, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
         min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close, count(*)::bigint as volume
  from orders group by 1, 2)"""
W = "(partition by sym order by d)"
RETS = BARS + f""",
lagged as (select sym, d, close, lag(close) over {W} as p, lag(d) over {W} as pd from bars),
rets as (select sym, d, close / p - 1 as ret from lagged where date_diff('day', pd, d) <= 4 and p <> 0)"""


def frame(n: int) -> str:
    return f"(partition by sym order by d rows between {n - 1} preceding and current row)"


def rounded(df: DataFrame, *names: str, at: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), at) for c in names})


def full(x: str, of: str, n: int) -> str:
    return f"case when count({of}) over {frame(n)} = {n} then {x} end"


@register("bars_daily", f"with {BARS} select * from bars")
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_1d(spark, sf_dir)


def _resample_sql(period: str) -> str:
    return f"""with {BARS} select sym, date_trunc('{period}', d)::date as bucket, max(d) as d, arg_min(open, d) as open, max(high) as high,
      min(low) as low, arg_max(close, d) as close, sum(volume)::bigint as volume from bars group by 1, 2"""


@register("bars_weekly", _resample_sql("week"))
def bars_weekly(spark, sf_dir):
    return prices.resample(bars_1d(spark, sf_dir), "week")


@register("bars_monthly", _resample_sql("month"))
def bars_monthly(spark, sf_dir):
    return prices.resample(bars_1d(spark, sf_dir), "month")


@register("latest_close", f"with {BARS} select sym, d, close from bars qualify row_number() over (partition by sym order by d desc) = 1")
def latest_close(spark, sf_dir):
    return prices.newest(bars_1d(spark, sf_dir), ["sym"], [F.desc("d")]).select("sym", "d", "close")


@register("close_series", f"with {BARS} select sym, d, close from bars qualify row_number() over (partition by sym order by d desc) <= 300")
def close_series(spark, sf_dir):
    """The last 300 closes of each symbol."""
    return prices.newest(bars_1d(spark, sf_dir), ["sym"], [F.desc("d")], 300).select("sym", "d", "close")


@register("sma_20", f"with {BARS} select sym, d, round({full(f'avg(close) over {frame(20)}', 'close', 20)}, 6) as sma from bars")
def sma_20(spark, sf_dir):
    return bars_1d(spark, sf_dir).select("sym", "d", F.round(ind.sma(F.col("close"), 20), 6).alias("sma"))


@register("returns_pct", f"with {BARS} select sym, d, round((close - lag(close, 5) over {W}) / nullif(lag(close, 5) over {W}, 0) * 100, 6) as ret5 from bars")
def returns_pct(spark, sf_dir):
    return bars_1d(spark, sf_dir).select("sym", "d", F.round(ind.change_pct(F.col("close"), 5), 6).alias("ret5"))


@register("bollinger", f"""with {BARS}, m as (select sym, d, {full(f'avg(close) over {frame(20)}', 'close', 20)} as mid, {full(f'stddev_samp(close) over {frame(20)}', 'close', 20)} as dev from bars)
select sym, d, round(mid - 2 * dev, 6) as boll_lo, round(mid, 6) as boll_mid, round(mid + 2 * dev, 6) as boll_hi from m""")
def bollinger(spark, sf_dir):
    return rounded(ind.bollinger(bars_1d(spark, sf_dir)).select("sym", "d", "boll_lo", "boll_mid", "boll_hi"), "boll_lo", "boll_mid", "boll_hi")


RSI = f"""c as (select *, close - lag(close) over {W} as dd from bars),
g as (select *, {full(f'avg(case when dd > 0 then dd when dd <= 0 then 0 end) over {frame(14)}', 'dd', 14)} as gain, {full(f'avg(case when dd < 0 then -dd when dd >= 0 then 0 end) over {frame(14)}', 'dd', 14)} as loss from c),
r as (select *, case when loss = 0 then 100.0 else 100 - 100 / (1 + gain / nullif(loss, 0)) end as rsi from g)"""


@register("rsi", f"with {BARS}, {RSI} select sym, d, round(rsi, 6) as rsi from r")
def rsi(spark, sf_dir):
    return rounded(ind.rsi_simple(bars_1d(spark, sf_dir)).select("sym", "d", "rsi"), "rsi")


@register("volatility", f"""with {BARS}, r as (select sym, d, close / nullif(lag(close) over {W}, 0) - 1 as r from bars)
select sym, d, round({full(f'stddev_samp(r) over {frame(20)}', 'r', 20)} * sqrt(252) * 100, 6) as volatility from r""")
def volatility(spark, sf_dir):
    return rounded(ind.volatility(bars_1d(spark, sf_dir)).select("sym", "d", "volatility"), "volatility")


@register("atr", f"""with {BARS}, t as (select *, lag(close) over {W} as p from bars),
r as (select sym, d, case when p is not null then greatest(high - low, abs(high - p), abs(low - p)) end as tr from t)
select sym, d, round({full(f'avg(tr) over {frame(14)}', 'tr', 14)}, 6) as atr from r""")
def atr(spark, sf_dir):
    return rounded(ind.atr(bars_1d(spark, sf_dir)).select("sym", "d", "atr"), "atr")


@register("stochastic", f"""with {BARS}, k as (select sym, d, {full(f'(close - min(low) over {frame(14)}) / nullif(max(high) over {frame(14)} - min(low) over {frame(14)}, 0) * 100', 'close', 14)} as k from bars)
select sym, d, round(k, 6) as stoch_k, round({full(f'avg(k) over {frame(3)}', 'k', 3)}, 6) as stoch_d from k""")
def stochastic(spark, sf_dir):
    return rounded(ind.stochastic(bars_1d(spark, sf_dir)).select("sym", "d", "stoch_k", "stoch_d"), "stoch_k", "stoch_d")


@register("obv", f"""with {BARS}, s as (select sym, d, coalesce(sign(close - lag(close) over {W}) * coalesce(volume, 0), 0) as s from bars)
select sym, d, sum(s) over (partition by sym order by d rows unbounded preceding)::double as obv from s""")
def obv(spark, sf_dir):
    return ind.obv(bars_1d(spark, sf_dir)).select("sym", "d", "obv")


@register("volume_spike", f"""with {BARS}, v as (select sym, d, volume, {full(f'avg(volume) over {frame(20)}', 'volume', 20)} as m from bars)
select sym, d, round(m, 6) as volume_sma, round(volume / nullif(m, 0), 6) as volume_spike from v""")
def volume_spike(spark, sf_dir):
    return rounded(ind.volume_spike(bars_1d(spark, sf_dir)).select("sym", "d", "volume_sma", "volume_spike"), "volume_sma", "volume_spike")


@register("high_low_52w", f"with {BARS} select sym, d, max(close) over {frame(252)} as high_n, min(close) over {frame(252)} as low_n from bars")
def high_low_52w(spark, sf_dir):
    return ind.high_low(bars_1d(spark, sf_dir)).select("sym", "d", "high_n", "low_n")


@register("trend", f"""with {BARS}, m as (select sym, d, close, {full(f'avg(close) over {frame(50)}', 'close', 50)} as s, {full(f'avg(close) over {frame(200)}', 'close', 200)} as l from bars)
select sym, d, case when s is null then null when l is null then (case when close > s then 'up' else 'down' end) when close > s and s > l then 'up' when close < s and s < l then 'down' end as trend from m""")
def trend(spark, sf_dir):
    return ind.trend(bars_1d(spark, sf_dir)).select("sym", "d", "trend")


@register("ema_12", f"""with recursive {BARS}, n as materialized (select sym, close, row_number() over {W} as i from bars),
e(sym, i, v) as (select sym, 12::bigint, avg(close) from n where i <= 12 group by sym having count(*) = 12
  union all select n.sym, n.i, e.v * (1 - 2.0::double / 13) + n.close * (2.0::double / 13) from e join n on n.sym = e.sym and n.i = e.i + 1)
select n.sym, round(max(case when e.i = m.m then e.v end), 6) as ema from (select distinct sym from n) n left join (select sym, max(i) as m from n group by sym) m using (sym) left join e using (sym) group by n.sym""")
def ema_12(spark, sf_dir):
    return rounded(ind.ema_latest(bars_1d(spark, sf_dir)), "ema")


@register("macd")
def macd(spark, sf_dir):
    return rounded(ind.macd_latest(bars_1d(spark, sf_dir)), "macd", "macd_signal", "macd_hist", at=4)


EWMA = f"""n as materialized (select sym, close, row_number() over (partition by sym order by d desc) as b from bars),
k as materialized (select sym, close, row_number() over (partition by sym order by b desc) as i from n where b <= 120),
r as materialized (select a.sym, a.i - 1 as i, a.close / b.close - 1 as r from k a join k b on a.sym = b.sym and b.i = a.i - 1),
e(sym, i, v) as (select sym, i, r * r from r where i = 1 union all select r.sym, r.i, 0.94::double * e.v + 0.06::double * r.r * r.r from e join r on r.sym = e.sym and r.i = e.i + 1),
vol as (select sym, case when max(i) >= 30 then sqrt(arg_max(v, i)) * 100 end as ewma_vol from e group by sym)"""


@register("ewma_volatility", f"with recursive {BARS}, {EWMA} select sym, round(ewma_vol, 6) as ewma_vol from (select distinct sym from bars) left join vol using (sym)")
def ewma_volatility(spark, sf_dir):
    return rounded(ind.ewma_volatility(bars_1d(spark, sf_dir)), "ewma_vol")


@register("price_move_alerts", f"""with recursive {BARS}, {EWMA},
m as (select sym, d, (close - lag(close) over {W}) / nullif(lag(close) over {W}, 0) * 100 as change_pct from bars)
select m.sym, m.d, round(change_pct, 6) as change_pct, round(ewma_vol, 6) as sigma_pct, coalesce(case when ewma_vol > 0 then round(abs(change_pct) / ewma_vol, 2) >= 3.0 and abs(change_pct) >= 1.5 else abs(change_pct) >= 5.0 end, false) as alert
from m left join vol using (sym) qualify row_number() over (partition by m.sym order by m.d desc) = 1""")
def price_move_alerts(spark, sf_dir):
    """The last move of each symbol against its own volatility: bars, returns, a fold and a rule in one."""
    bars = bars_1d(spark, sf_dir)
    move = prices.newest(bars.withColumn("change_pct", ind.change_pct(F.col("close"), 1)), ["sym"], [F.desc("d")])
    d = move.join(ind.ewma_volatility(bars), "sym", "left").withColumnRenamed("ewma_vol", "sigma_pct")
    move_size = F.abs("change_pct")
    # against the symbol's own volatility, with a floor; without one a fixed threshold
    alert = F.when(F.col("sigma_pct") > 0, (F.round(move_size / F.col("sigma_pct"), 2) >= 3.0) & (move_size >= 1.5)).otherwise(move_size >= 5.0)
    return d.select("sym", "d", F.round("change_pct", 6).alias("change_pct"), F.round("sigma_pct", 6).alias("sigma_pct"), F.coalesce(alert, F.lit(False)).alias("alert"))


def candles_sql(trend: int = 10, name: str = "hits") -> str:
    """CTEs up to <name>(sym, d, pattern, direction)."""
    inside = "greatest(open, close) < greatest(o1, c1) and least(open, close) > least(o1, c1) and abs(c1 - o1) >= 0.6 * (h1 - l1) and abs(close - open) < 0.6 * abs(c1 - o1) and h1 > l1"
    star = "abs(c2 - o2) >= 0.6 * (h2 - l2) and h2 > l2 and abs(c1 - o1) <= 0.3 * (h1 - l1)"
    hits = {
        ("doji", 0): "high > low and abs(close - open) <= 0.1 * (high - low)",
        ("hammer", 1): "high > low and least(open, close) - low >= 0.6 * (high - low) and high - greatest(open, close) <= 0.15 * (high - low) and rise = -1",
        ("hanging_man", -1): "high > low and least(open, close) - low >= 0.6 * (high - low) and high - greatest(open, close) <= 0.15 * (high - low) and rise = 1",
        ("inverted_hammer", 1): "high > low and high - greatest(open, close) >= 0.6 * (high - low) and least(open, close) - low <= 0.15 * (high - low) and rise = -1",
        ("shooting_star", -1): "high > low and high - greatest(open, close) >= 0.6 * (high - low) and least(open, close) - low <= 0.15 * (high - low) and rise = 1",
        ("bullish_engulfing", 1): "c1 < o1 and close > open and open <= c1 and close >= o1 and abs(close - open) > abs(c1 - o1) and rise = -1",
        ("bearish_engulfing", -1): "c1 > o1 and close < open and open >= c1 and close <= o1 and abs(close - open) > abs(c1 - o1) and rise = 1",
        ("bullish_harami", 1): f"c1 < o1 and close > open and {inside} and rise = -1",
        ("bearish_harami", -1): f"c1 > o1 and close < open and {inside} and rise = 1",
        ("morning_star", 1): f"c2 < o2 and {star} and close > open and close >= (o2 + c2) / 2 and rise = -1",
        ("evening_star", -1): f"c2 > o2 and {star} and close < open and close <= (o2 + c2) / 2 and rise = 1",
    }
    lags = ", ".join(f"lag({x}, {n}) over {W} as {x[0]}{n}" for x in ("open", "high", "low", "close") for n in (1, 2))
    return f"""{name}_m as (select *, {full(f'avg(close) over {frame(trend)}', 'close', trend)} as ma from bars),
{name}_g as (select *, {lags}, lag(ma) over {W} as m1 from {name}_m),
{name}_t as (select *, case when m1 is null then 0 when c1 > m1 then 1 when c1 < m1 then -1 else 0 end as rise from {name}_g),
{name} as materialized (""" + " union all ".join(f"select sym, d, '{p}' as pattern, {way}::int as direction from {name}_t where {ok}" for (p, way), ok in hits.items()) + ")"


HITS = candles_sql()
#: Reversals as a recursion over bars: position, bars held.
CANDLES = f"""cv as materialized (select b.sym, b.d, row_number() over (partition by b.sym order by b.d) as i, coalesce(bool_or(direction > 0), false) as bull, coalesce(bool_or(direction < 0), false) as bear
  from bars b left join (select * from hits where pattern not in ('doji', 'inverted_hammer')) h on h.sym = b.sym and h.d = b.d group by b.sym, b.d),
cb(sym, d, i, pos, held) as (select sym, d, i, case when bull then 1 when bear then -1 else 0 end, 0 from cv where i = 1
  union all select v.sym, v.d, v.i, case when p.pos = 0 then (case when v.bull then 1 when v.bear then -1 else 0 end) when (p.pos > 0 and v.bear) or (p.pos < 0 and v.bull) then -p.pos when (p.pos > 0 and v.bull) or (p.pos < 0 and v.bear) then p.pos when p.held + 1 >= 10 then 0 else p.pos end,
    case when p.pos = 0 or v.bull or v.bear or p.held + 1 >= 10 then 0 else p.held + 1 end from cb p join cv v on v.sym = p.sym and v.i = p.i + 1),
cl(sym, d, i, pos, held) as (select sym, d, i, case when bull then 1 else 0 end, 0 from cv where i = 1
  union all select v.sym, v.d, v.i, case when p.pos = 0 then (case when v.bull then 1 else 0 end) when v.bear or (case when v.bull then 0 else p.held + 1 end) >= 10 then 0 else 1 end,
    case when p.pos = 0 or v.bull then 0 else p.held + 1 end from cl p join cv v on v.sym = p.sym and v.i = p.i + 1)"""


@register("candlestick_patterns", f"with {BARS}, {HITS} select * from hits")
def candlestick_patterns(spark, sf_dir):
    return candlesticks.patterns(bars_1d(spark, sf_dir))


@register("signal_candles", f"with recursive {BARS}, {HITS}, {CANDLES} select cl.sym, cl.d, cl.pos::int as long_only, cb.pos::int as both_ways from cl join cb on cl.sym = cb.sym and cl.i = cb.i")
def signal_candles(spark, sf_dir):
    bars = bars_1d(spark, sf_dir)
    long = candlesticks.candles(bars).withColumnRenamed("signal", "long_only")
    return long.join(candlesticks.candles(bars, both_ways=True).withColumnRenamed("signal", "both_ways"), ["sym", "d"])


SMA_CROSS = f"s as (select sym, d, close, coalesce(({full(f'avg(close) over {frame(20)}', 'close', 20)}) > ({full(f'avg(close) over {frame(50)}', 'close', 50)}), false)::int as signal from bars)"
POSITIONS = f"""h as (select *, coalesce(lag(signal) over {W}, 0) as held, coalesce(close / nullif(lag(close) over {W}, 0) - 1, 0) as market from s),
p as (select *, held * market - abs(held - coalesce(lag(held) over {W}, 0)) * 5.0 / 1e4 as ret from h)"""


@register("signal_sma_cross", f"with {BARS}, {SMA_CROSS} select sym, d, signal from s")
def signal_sma_cross(spark, sf_dir):
    return bt.sma_cross(bars_1d(spark, sf_dir)).select("sym", "d", "signal")


@register("signal_momentum", f"with {BARS} select sym, d, coalesce(close > lag(close, 20) over {W}, false)::int as signal from bars")
def signal_momentum(spark, sf_dir):
    return bt.momentum(bars_1d(spark, sf_dir)).select("sym", "d", "signal")


UNTIL = "(partition by sym order by d rows unbounded preceding)"


@register("signal_rsi", f"""with {BARS}, {RSI}, e as (select sym, d, case when round(rsi, 2) > 55 then 0 when round(rsi, 2) < 30 then 1 end as e from r)
select sym, d, coalesce(last_value(e ignore nulls) over {UNTIL}, 0) as signal from e""")
def signal_rsi(spark, sf_dir):
    return bt.rsi_signal(bars_1d(spark, sf_dir)).select("sym", "d", "signal")


@register("signal_bollinger", f"""with {BARS}, m as (select sym, d, close, {full(f'avg(close) over {frame(20)}', 'close', 20)} as mid, {full(f'stddev_samp(close) over {frame(20)}', 'close', 20)} as dev from bars),
e as (select sym, d, case when close >= round(mid, 2) then 0 when close <= round(mid - 2 * dev, 2) then 1 end as e from m)
select sym, d, coalesce(last_value(e ignore nulls) over {UNTIL}, 0) as signal from e""")
def signal_bollinger(spark, sf_dir):
    return bt.bollinger_signal(bars_1d(spark, sf_dir)).select("sym", "d", "signal")


@register("backtest_sma_cross", f"""with {BARS}, {SMA_CROSS}, {POSITIONS},
q as (select *, exp(sum(ln(1 + ret)) over {UNTIL}) as equity, row_number() over {W} as n from p),
k as (select *, greatest(1.0, max(equity) over {UNTIL}) as peak from q)
select sym, count(*) as bars, round((arg_max(equity, d) - 1) * 100, 6) as total_pct, round((arg_max(close, d) / arg_min(close, d) - 1) * 100, 6) as hold_pct,
  round(avg(ret) filter (n > 1) / nullif(stddev_samp(ret) filter (n > 1), 0) * sqrt(252), 6) as sharpe,
  round(avg(ret) filter (n > 1) / nullif(sqrt(avg(power(least(ret, 0), 2)) filter (n > 1)), 0) * sqrt(252), 6) as sortino,
  round(max((peak - equity) / peak) * 100, 6) as drawdown_pct, round(avg(held) filter (n > 1) * 100, 6) as exposure_pct
from k group by sym""")
def backtest_sma_cross(spark, sf_dir):
    out = bt.report(bt.sma_cross(bars_1d(spark, sf_dir)), cost_bps=5.0)
    return rounded(out, "total_pct", "hold_pct", "sharpe", "sortino", "drawdown_pct", "exposure_pct")


@register("backtest_trades", f"""with {BARS}, {SMA_CROSS}, {POSITIONS},
t as (select *, lag(close) over {W} as prev, lag(d) over {W} as prev_d, (held <> coalesce(lag(held) over {W}, 0))::int as turn from p),
u as (select *, sum(turn) over {UNTIL} as run from t)
select sym, min(prev_d) as entry, max(d) as exit, count(*) as bars, round((arg_max(close, d) / arg_min(prev, d) - 1) * 100, 6) as pnl_pct from u where held = 1 group by sym, run""")
def backtest_trades(spark, sf_dir):
    return rounded(bt.trades(bt.sma_cross(bars_1d(spark, sf_dir))), "pnl_pct")


@register("walk_forward_folds", """select i::int as fold, (i * 60)::int as train_start, (i * 60 + 250)::int as train_end, (i * 60 + 250)::int as test_start, (i * 60 + 310)::int as test_end from range(29) t(i)""")
def walk_forward_folds(spark, sf_dir):
    d = bt.folds(spark, 2000, 250, 60)
    return d.select(*[F.col(c).cast("int").alias(c) for c in d.columns])


@register("walk_forward")
def walk_forward(spark, sf_dir):
    return rounded(bt.walk_forward(bars_1d(spark, sf_dir), [(5, 20), (10, 30), (20, 50)]), "train_ret", "test_ret")


@register("gap_guarded_returns", f"with {RETS} select sym, d, round(ret, 8) as ret from rets")
def gap_guarded_returns(spark, sf_dir):
    return rounded(stats.returns(bars_1d(spark, sf_dir)), "ret", at=8)


@register("correlation_matrix", f"""with {RETS} select a.sym as a, b.sym as b, count(*) as n, round(corr(a.ret, b.ret), 6) as r from rets a join rets b on a.d = b.d and a.sym < b.sym group by 1, 2 having count(*) >= 20""")
def correlation_matrix(spark, sf_dir):
    return rounded(stats.correlation_matrix(stats.returns(bars_1d(spark, sf_dir))), "r")


INDEX = "ix as (select o_orderdate::date as d, avg(o_totalprice) as close from orders group by 1), il as (select d, close, lag(close) over (order by d) as p, lag(d) over (order by d) as pd from ix), ir as (select d, close / p - 1 as iret from il where date_diff('day', pd, d) <= 4)"


def index_returns(spark, sf_dir):
    ix = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("close"))
    return stats.returns(ix.withColumn("sym", F.lit("index"))).select("d", F.col("ret").alias("iret"))


@register("beta", f"with {RETS}, {INDEX} select sym, count(*) as n, round(case when count(*) >= 60 and var_pop(iret) > 1e-12 then covar_pop(ret, iret) / var_pop(iret) end, 6) as beta from rets join ir using (d) group by sym")
def beta(spark, sf_dir):
    return rounded(stats.beta(stats.returns(bars_1d(spark, sf_dir)), index_returns(spark, sf_dir)), "beta")


@register("historical_var", f"""with {RETS}, k as (select *, row_number() over (partition by sym order by ret, d) as k, count(*) over (partition by sym) as n from rets)
select sym, max(n) as n, round(case when max(n) >= 20 then -quantile_cont(ret, 0.05) end, 6) as var, round(case when max(n) >= 20 then -avg(ret) filter (k <= greatest(1, round_even((1 - 0.95::double) * n, 0))) end, 6) as es from k group by sym""")
def historical_var(spark, sf_dir):
    return rounded(stats.historical_var(stats.returns(bars_1d(spark, sf_dir))), "var", "es")


@register("risk_contributions", f"""with {RETS}, w as (select distinct sym, 0.2::double as weight from bars), x as (select r.*, weight from rets r join w using (sym)),
p as (select d, sum(weight * ret) as p from x group by d having count(*) = (select count(*) from w))
select sym, round(any_value(weight) * covar_pop(ret, p) / nullif(var_pop(p), 0) * 100, 6) as share from x join p using (d) group by sym""")
def risk_contributions(spark, sf_dir):
    bars = bars_1d(spark, sf_dir)
    weights = bars.select("sym").distinct().withColumn("weight", F.lit(0.2))
    return rounded(stats.risk_contributions(stats.returns(bars), weights), "share")


@register("max_drawdown", f"""with {RETS}, e as (select sym, d, exp(sum(ln(1 + ret)) over {UNTIL}) as e from rets), k as (select *, greatest(1.0, max(e) over {UNTIL}) as peak from e)
select sym, round(max((peak - e) / peak) * 100, 6) as drawdown from k group by sym""")
def max_drawdown(spark, sf_dir):
    return rounded(stats.max_drawdown(stats.returns(bars_1d(spark, sf_dir))), "drawdown")


@register("asof_close", f"""with {BARS}, e as (select event_id, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][1 + user_id % 5] as sym, (ts - interval 9000 day)::date as d from events)
select e.event_id, e.sym, e.d, b.close as asof_close from e asof left join bars b on e.sym = b.sym and e.d > b.d""")
def asof_close(spark, sf_dir):
    """The last close strictly before each event's date, by one window over both sides."""
    names = F.array(*[F.lit(s) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    events = table(spark, sf_dir, "events").select("event_id", F.get(names, (F.col("user_id") % 5).cast("int")).alias("sym"), F.date_sub(F.to_date("ts"), 9000).alias("d"))
    return prices.asof_join(events, bars_1d(spark, sf_dir), "sym", "d", "close", strict=True)
