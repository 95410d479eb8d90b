"""Queries of parameter search and walk-forward validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import search, selection
from tessera.plans.market import BARS, W, candles_sql, frame, full, rounded
from tessera.plans.registry import register
from tessera.sources.tables import bars_1d

COST = 5.0
#: The proxy's closes jump by factors; moved up and flattened they move by percents, as prices do.
CALM = f"{BARS.replace('bars as', 'raw as', 1)}, bars as (select sym, d, 20000 + close / 100 as close from raw)"


def calm(spark, sf_dir, columns: tuple[str, ...] = ("close",)):
    return bars_1d(spark, sf_dir).select("sym", "d", *[(20000 + F.col(c) / 100).alias(c) for c in columns])


OHLC = ("open", "high", "low", "close")


B = "(partition by sym, g, fold, part order by i)"


def _signals(strategy: str, combos: list[dict]) -> str:
    """CTEs up to sg(sym, g, params, i, n, d, close, signal), each combination written out."""
    if strategy == "momentum":
        x = lambda p: f"coalesce(close > lag(close, {p['lookback']}) over {W}, false)::int"
    else:
        avg = lambda n: full(f"avg(close) over {frame(n)}", "close", n)
        x = lambda p: f"coalesce({avg(p['fast'])} > {avg(p['slow'])}, false)::int"
    parts = [f"select sym, {g} as g, '{search.label(p)}' as params, row_number() over {W} - 1 as i, count(*) over (partition by sym) as n, d, close, {x(p)} as signal from bars" for g, p in enumerate(combos)]
    return f"{CALM}, sg as materialized ({' union all '.join(parts)})"


def _band(combos: list[dict]) -> str:
    """The same for Bollinger: the last of the two events decides."""
    parts = []
    for g, p in enumerate(combos):
        n, k = p["window"], p["k"]
        mid, dev = full(f"avg(close) over {frame(n)}", "close", n), full(f"stddev_samp(close) over {frame(n)}", "close", n)
        parts.append(f"select sym, {g} as g, '{search.label(p)}' as params, d, close, case when close >= round({mid}, 2) then 0 when close <= round({mid} - {k} * {dev}, 2) then 1 end as e from bars")
    return f"""{CALM}, ev as ({' union all '.join(parts)}),
sg as materialized (select sym, g, params, row_number() over (partition by sym, g order by d) - 1 as i, count(*) over (partition by sym, g) as n, d, close,
  coalesce(last_value(e ignore nulls) over (partition by sym, g order by d rows unbounded preceding), 0) as signal from ev)"""


def _reversed(combos: list[dict]) -> str:
    """The same for candles: the last reversal of the newest `hold` bars decides."""
    trends, parts = sorted({p["trend"] for p in combos}), []
    moved = ", ".join(f"20000 + {x} / 100 as {x}" for x in OHLC)
    for g, p in enumerate(combos):
        last = f"last_value(way ignore nulls) over (partition by sym order by d rows between {p['hold'] - 1} preceding and current row)"
        parts.append(f"select sym, {g} as g, '{search.label(p)}' as params, row_number() over {W} - 1 as i, count(*) over (partition by sym) as n, d, close, coalesce({last} > 0, false)::int as signal from way{p['trend']}")
    hits = ", ".join(f"{candles_sql(t, f'hits{t}')}, way{t} as (select b.sym, b.d, b.close, max(direction) as way from bars b left join (select * from hits{t} where pattern not in ('doji', 'inverted_hammer')) h on h.sym = b.sym and h.d = b.d group by all)" for t in trends)
    return f"{BARS.replace('bars as', 'raw as', 1)}, bars as (select sym, d, {moved} from raw), {hits}, sg as materialized ({' union all '.join(parts)})"


def _head(strategy: str) -> str:
    combos = search.param_grid(search.GRIDS[strategy], search.VALID.get(strategy))
    return {"bollinger": _band, "candles": _reversed}[strategy](combos) if strategy in ("bollinger", "candles") else _signals(strategy, combos)


#: From rows w(sym, g, params, fold, part, i, close, signal) of every window, each run on its own, to m: its measures.
RUN = f"""h as (select *, coalesce(lag(signal, 1) over {B}, 0) as held, coalesce(lag(signal, 2) over {B}, 0) as before, close / nullif(lag(close) over {B}, 0) - 1 as move, row_number() over {B} as k from w),
x as (select *, case when k > 1 then held * coalesce(move, 0) - {COST} / 1e4 * abs(held - before) end as r from h),
e as (select *, exp(sum(ln(1 + coalesce(r, 0))) over {B}) as eq from x),
f as (select *, greatest(1.0, max(eq) over (partition by sym, g, fold, part order by i rows unbounded preceding)) as peak from e),
m0 as (select sym, g, params, fold, part, count(r) as n, avg(r) as mean, stddev_samp(r) as dev, sqrt(avg(case when r < 0 then r * r when r is not null then 0 end)) as down, arg_max(eq, i) as eq, max((peak - eq) / peak) as fall, min_by(close, i) as first, max_by(close, i) as last from f group by all),
m1 as (select *, round((eq - 1) * 100, 2) as total_return, case when n >= 2 and dev > 1e-15 then round(mean / dev * sqrt(252), 2) end as sharpe, case when n >= 2 and down > 1e-15 then round(mean / down * sqrt(252), 2) end as sortino,
  case when n > 0 then round((power(eq, 252.0 / n) - 1) * 100, 2) end as cagr, round(fall * 100, 2) as max_drawdown from m0),
m as (select *, case when max_drawdown > 0 then round(cagr / max_drawdown, 2) end as calmar from m1)"""


def _board(strategy: str, objective: str) -> str:
    return f"""with {_head(strategy)}, w as (select sym, g, params, 0 as fold, '' as part, i, close, signal from sg), {RUN}
select sym, (row_number() over (partition by sym order by {objective} desc nulls last, g))::int as place, params, {objective} as score, total_return, sharpe, sortino, calmar, cagr, max_drawdown from m"""


def _folds(strategy: str, objective: str, train: int, test: int, anchored: bool) -> str:
    head = _head(strategy)
    start = "0" if anchored else f"k * {test}"
    return f"""{head}, fo as (select distinct sym, unnest(range(0, greatest(0, (n - {train}) // {test}))) as k from sg),
w as (select s.sym, g, params, k as fold, 'train' as part, i, close, signal from sg s join fo on s.sym = fo.sym and i >= {start} and i < k * {test} + {train}
  union all select s.sym, g, params, k, 'test', i, close, signal from sg s join fo on s.sym = fo.sym and i >= k * {test} + {train} and i < k * {test} + {train} + {test}), {RUN},
b as (select * from m where part = 'train' qualify row_number() over (partition by sym, fold order by {objective} desc nulls last, g) = 1),
r as (select b.sym, b.fold, b.g, b.params, b.total_return as train_return_pct, t.total_return as test_return_pct, t.first, t.last from b join m t on t.part = 'test' and t.sym = b.sym and t.fold = b.fold and t.g = b.g)"""


def _folds_sql(*a) -> str:
    train, test, start = a[2], a[3], "0" if a[4] else f"fold * {a[3]}"
    return f"""with {_folds(*a)} select sym, fold::int as fold, ({start})::int as train_start, (fold * {test} + {train})::int as train_end, (fold * {test} + {train})::int as test_start,
  (fold * {test} + {train} + {test})::int as test_end, params, train_return_pct, test_return_pct from r"""


def _report_sql(*a) -> str:
    return f"""with {_folds(*a)}, z as (select x.sym, x.fold, x.i, x.r from x join r on x.part = 'test' and x.sym = r.sym and x.fold = r.fold and x.g = r.g where x.r is not null),
q as (select *, exp(sum(ln(1 + r)) over (partition by sym order by fold, i)) as eq from z),
p as (select *, greatest(1.0, max(eq) over (partition by sym order by fold, i rows unbounded preceding)) as peak from q),
o as (select sym, arg_max(eq, fold * 100000 + i) as eq, avg(r) as mean, stddev_samp(r) as dev, max((peak - eq) / peak) as fall from p group by sym),
s as (select sym, count(*)::int as folds, product(1 + train_return_pct / 100) as inside, min_by(first, fold) as a, max_by(last, fold) as z from r group by sym)
select sym, folds, round((eq - 1) * 100, 2) as oos_return_pct, round((inside - 1) * 100, 2) as is_return_pct, case when inside > 1 then round((eq - 1) / (inside - 1), 3) end as efficiency,
  case when dev > 1e-15 then round(mean / dev * sqrt(252), 2) end as oos_sharpe, round(fall * 100, 2) as oos_max_drawdown_pct, round((z / a - 1) * 100, 2) as oos_buy_hold_pct from s join o using (sym)"""


SHOWN = ("sym", "fold", "train_start", "train_end", "test_start", "test_end", "params", "train_return_pct", "test_return_pct")


@register("param_search_sma", _board("sma_cross", "sharpe"))
def param_search_sma(spark, sf_dir):
    return search.leaderboard(calm(spark, sf_dir), "sma_cross", cost_bps=COST)


@register("param_search_bollinger", _board("bollinger", "calmar"))
def param_search_bollinger(spark, sf_dir):
    return search.leaderboard(calm(spark, sf_dir), "bollinger", objective="calmar", cost_bps=COST)


@register("param_search_candles", _board("candles", "sharpe"))
def param_search_candles(spark, sf_dir):
    return search.leaderboard(calm(spark, sf_dir, OHLC), "candles", cost_bps=COST)


@register("walk_forward_candles", _folds_sql("candles", "sharpe", 120, 40, False))
def walk_forward_candles(spark, sf_dir):
    return search.walk_forward(calm(spark, sf_dir, OHLC), "candles", train=120, test=40, cost_bps=COST).select(*SHOWN)


@register("walk_forward_sma", _folds_sql("sma_cross", "sharpe", 120, 40, False))
def walk_forward_sma(spark, sf_dir):
    return search.walk_forward(calm(spark, sf_dir), "sma_cross", cost_bps=COST).select(*SHOWN)


@register("walk_forward_momentum_anchored", _folds_sql("momentum", "sortino", 100, 30, True))
def walk_forward_momentum_anchored(spark, sf_dir):
    return search.walk_forward(calm(spark, sf_dir), "momentum", train=100, test=30, objective="sortino", cost_bps=COST, anchored=True).select(*SHOWN)


@register("walk_forward_report", _report_sql("bollinger", "total_return", 120, 40, False))
def walk_forward_report(spark, sf_dir):
    d = search.report(search.walk_forward(calm(spark, sf_dir), "bollinger", objective="total_return", cost_bps=COST))
    return d.withColumn("folds", F.col("folds").cast("int"))


def _net(strategy: str) -> str:
    """rt(sym, g, params, i, ret): what each combination earns on each bar, after costs."""
    combos = search.param_grid(search.GRIDS[strategy], search.VALID.get(strategy))
    w = "(partition by sym, g order by i)"
    return f"""{_signals(strategy, combos)}, hd as (select *, coalesce(lag(signal, 1) over {w}, 0) as held, coalesce(lag(signal, 2) over {w}, 0) as before, close / lag(close) over {w} - 1 as move from sg),
rt as (select sym, g, params, i, held * coalesce(move, 0) - {COST} / 1e4 * abs(held - before) as ret from hd where i > 0)"""


def _returns(spark, sf_dir, strategy: str):
    combos = search.param_grid(search.GRIDS[strategy], search.VALID.get(strategy))
    d = search.runs(calm(spark, sf_dir), strategy, combos).where("i > 0")
    return d.select("sym", "g", "params", "i", (F.col("held") * F.col("move") - COST / 1e4 * F.col("turn")).alias("ret"))


#: The quantile of 1 - 1 / 9 and of 1 - 1 / (9 e), and the distribution by its series with logarithms of double factorials.
_PHI = "0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * sign(z) * list_sum(list_transform(range(0, 200), lambda k: case when z = 0 then 0 else exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())) end))"


@register("deflated_sharpe", f"""with {_net("sma_cross")}, m0 as (select sym, params, count(*) as n, avg(ret) as mu, stddev_samp(ret) as dev, stddev_pop(ret) as pop from rt group by 1, 2),
m as (select sym, params, m0.n, any_value(mu / nullif(dev, 0)) as sr, avg(power((ret - mu) / pop, 3)) as skew, avg(power((ret - mu) / pop, 4)) as kurt from rt join m0 using (sym, params) group by 1, 2, 3),
z as (select *, (sr - ((1 - 0.5772156649) * 1.2206403488473494 + 0.5772156649 * 1.7406155679998851) / sqrt(n - 1)) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)) as z from m)
select sym, params, n, round(sr, 8) as sharpe, round(case when sr is null then null when z > 8 then 1 when z < -8 then 0 else {_PHI} end, 5) as deflated from z""")
def deflated_sharpe(spark, sf_dir):
    d = selection.deflated(_returns(spark, sf_dir, "sma_cross").select(F.col("sym").alias("key"), F.col("params").alias("trial"), "ret"))
    return d.select(F.col("key").alias("sym"), F.col("trial").alias("params"), "n", F.round("sharpe", 8).alias("sharpe"), F.round("deflated", 5).alias("deflated"))


_CPCV = f"""{_net("momentum")}, b as (select sym || ':' || params as strategy, (i - 1) as i, ret, least((i - 1) // greatest((count(*) over (partition by sym, params)) // 6, 1), 5) as block from rt),
e as (select *, min(i) over (partition by strategy, block) as lo, max(i) over (partition by strategy, block) as hi from b),
c as (select row_number() over (order by x, y) - 1 as split, x, y from range(6) a(x), range(6) b(y) where x < y),
p as (select split, strategy, ret, block not in (x, y) as inside, i < lo + 5 as first, i > hi - 5 as last, block = 0 or ((block - 1) not in (x, y)) = (block not in (x, y)) as before, block = 5 or ((block + 1) not in (x, y)) = (block not in (x, y)) as after from e, c),
s as (select split, strategy, avg(ret) filter (inside) / nullif(stddev_samp(ret) filter (inside), 0) as inside, avg(ret) filter (not inside) / nullif(stddev_samp(ret) filter (not inside), 0) as outside from p
  where not inside or ((not first or before) and (not last or after)) group by 1, 2)"""


@register("cpcv_sharpes", f"with {_CPCV} select split::int as split, strategy, round(inside, 6) as inside, round(outside, 6) as outside from s where inside is not null and outside is not null")
def cpcv_sharpes(spark, sf_dir):
    r = _returns(spark, sf_dir, "momentum").select(F.concat_ws(":", "sym", "params").alias("strategy"), (F.col("i") - 1).alias("i"), "ret")
    return rounded(selection.cpcv(r, 6, 2, embargo=5), "inside", "outside")


@register("cpcv_overfitting", f"""with {_CPCV}, o as (select *, row_number() over (partition by split order by inside desc, strategy) as best, cume_dist() over (partition by split order by outside) as rank from s where inside is not null and outside is not null)
select round(avg((rank <= 0.5)::int::double), 6) as pbo, count(*) as splits from o where best = 1""")
def cpcv_overfitting(spark, sf_dir):
    r = _returns(spark, sf_dir, "momentum").select(F.concat_ws(":", "sym", "params").alias("strategy"), (F.col("i") - 1).alias("i"), "ret")
    return rounded(selection.cpcv_overfitting(r, 6, 2, embargo=5), "pbo")
