"""Parameter search and walk-forward validation of long/flat strategies.

A grid is rows, not runs: one pass over the bars gives the signals of all combinations (one sort by
symbol), which are then unfolded. The bars of a symbol and a combination are cut into cells at every
place where a window can begin; a cell keeps sums, growth, peak, trough and drawdown, in two forms: as the
first of a window (which starts flat, without the bar's own return) and as a later one. Statistics of
any window, rolling or anchored, are then a fold over its cells: bars are read once however many windows
hold them.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.operators.candlesticks import reversals, side
from tessera.operators.directional import ema_seeded
from tessera.operators.indicators import YEAR, bollinger, by_symbol, full, last, rsi_simple, sma

# The grids searched by default.
GRIDS: dict[str, dict[str, list]] = {
    "sma_cross": {"fast": [10, 20, 30], "slow": [50, 100, 200]},
    "momentum": {"lookback": [10, 20, 40, 60]},
    "rsi": {"low": [25, 30, 35], "high": [50, 55, 60]},
    "macd_cross": {"fast": [8, 12], "slow": [21, 26], "signal": [9]},
    "bollinger": {"window": [20, 30], "k": [2.0, 2.5, 3.0]},
    "candles": {"hold": [5, 10, 20], "trend": [10, 20]},
}
VALID: dict[str, Callable[[dict], bool]] = {
    "sma_cross": lambda p: p["fast"] < p["slow"],
    "rsi": lambda p: p["low"] < p["high"],
    "macd_cross": lambda p: p["fast"] < p["slow"],
}
OBJECTIVES = ("total_return", "sharpe", "sortino", "calmar", "cagr")


def param_grid(grid: dict[str, list], valid: Callable[[dict], bool] | None = None) -> list[dict]:
    """All combinations in the order of the grid, the last parameter fastest; an empty grid gives one without parameters."""
    rows = [dict(zip(grid, x, strict=True)) for x in product(*grid.values())]
    return [p for p in rows if valid is None or valid(p)]


def _events(d: DataFrame, rows: list[tuple[Column, Column]]) -> tuple[DataFrame, list[Column]]:
    """Signals that the last of two events decides: enter, or leave (which goes first)."""
    no = F.lit(False)
    d = d.withColumns({f"_e{g}": F.when(F.coalesce(leave, no), 0).when(F.coalesce(enter, no), 1) for g, (enter, leave) in enumerate(rows)})
    w = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return d, [F.coalesce(F.last(f"_e{g}", ignorenulls=True).over(w), F.lit(0)) for g in range(len(rows))]


def _macd(bars: DataFrame, combos: list[dict]) -> tuple[DataFrame, list[Column]]:
    """All combinations in one pass over a symbol's bars."""
    session.ship(bars.sparkSession)

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("d").reset_index(drop=True)
        found = np.zeros((len(pdf), len(combos)), np.int32)
        for g, p in enumerate(combos):
            fast, slow, signal = p.get("fast", 12), p.get("slow", 26), p.get("signal", 9)
            line = (ema_seeded(pdf["close"], fast) - ema_seeded(pdf["close"], slow)).iloc[slow - 1 :]
            found[:, g] = ((line - ema_seeded(line, signal)).reindex(pdf.index).round(2) > 0).to_numpy()
        pdf["_s"] = list(found)
        return pdf[["sym", "d", "close", "_s"]]

    d = bars.select("sym", "d", F.col("close").cast("double").alias("close")).groupBy("sym").applyInPandas(run, "sym string, d date, close double, _s array<int>")
    return d, [F.get("_s", F.lit(g)) for g in range(len(combos))]


def signals(bars: DataFrame, strategy: str, combos: list[dict]) -> tuple[DataFrame, list[Column]]:
    """bars with what the signals need, and a column of 0 or 1 for each combination."""
    c = F.col("close")
    if strategy == "sma_cross":
        return bars, [F.coalesce((sma(c, p.get("fast", 20)) > sma(c, p.get("slow", 50))).cast("int"), F.lit(0)) for p in combos]
    if strategy == "momentum":
        return bars, [F.coalesce((c > F.lag("close", p.get("lookback", 20)).over(by_symbol())).cast("int"), F.lit(0)) for p in combos]
    if strategy == "rsi":
        d = bars
        for n in sorted({p.get("window", 14) for p in combos}):
            d = rsi_simple(d, n).withColumn(f"_rsi{n}", F.round("rsi", 2)).drop("rsi")
        r = lambda p: F.col(f"_rsi{p.get('window', 14)}")
        return _events(d, [(r(p) < p.get("low", 30.0), r(p) > p.get("high", 55.0)) for p in combos])
    if strategy == "bollinger":
        d = bars
        for n in sorted({p.get("window", 20) for p in combos}):
            d = bollinger(d, n, 1.0).withColumns({f"_mid{n}": F.col("boll_mid"), f"_dev{n}": full(F.stddev_samp(c).over(last(n)), c, n)})
        mid, dev = (lambda p: F.col(f"_mid{p.get('window', 20)}")), (lambda p: F.col(f"_dev{p.get('window', 20)}"))
        return _events(d, [(c <= F.round(mid(p) - p.get("k", 2.0) * dev(p), 2), c >= F.round(mid(p), 2)) for p in combos])
    if strategy == "candles":
        if not {"open", "high", "low"} <= set(bars.columns):
            raise ValueError("strategy candles needs bars with open, high and low")
        d, trend = bars, lambda p: p.get("trend", 10)
        for n in sorted({trend(p) for p in combos}):
            d = reversals(d, n, f"_way{n}")
        d = d.withColumn("_i", F.row_number().over(by_symbol()))
        return d, [F.greatest(side(f"_way{trend(p)}", "_i", p.get("hold", 10)), F.lit(0)) for p in combos]
    if strategy == "macd_cross":
        return _macd(bars, combos)
    raise ValueError(f"no grid for strategy {strategy}; known: {', '.join(GRIDS)}")


def label(p: dict) -> str:
    return ",".join(f"{k}={v}" for k, v in p.items())


def runs(bars: DataFrame, strategy: str, combos: list[dict]) -> DataFrame:
    """(sym, g, params, d, i, bars, close, signal, held, turn, move): each bar once a combination. held is the signal of the
    bar before, turn its change, move the bar's own return (0 without a price before)."""
    d, columns = signals(bars.where("close is not null"), strategy, combos)
    d = d.withColumns({f"_s{g}": s for g, s in enumerate(columns)})  # columns of their own: windows look at the bars before
    w = by_symbol()
    past = F.lag("close").over(w)
    ago = lambda g, k: F.coalesce(F.lag(f"_s{g}", k).over(w), F.lit(0)).cast("int")
    every = [F.struct(F.lit(g).alias("g"), F.lit(label(p)).alias("params"), F.col(f"_s{g}").cast("int").alias("signal"), ago(g, 1).alias("held"), ago(g, 2).alias("before")) for g, p in enumerate(combos)]
    move = F.coalesce(F.col("close") / F.nullif(past, F.lit(0.0)) - 1, F.lit(0.0))
    count = F.count(F.lit(1)).over(Window.partitionBy("sym"))
    d = d.select("sym", "d", F.col("close").cast("double").alias("close"), (F.row_number().over(w) - 1).alias("i"), count.alias("bars"), move.alias("move"), F.array(*every).alias("_all"))
    return d.select("sym", "d", "close", "i", "bars", "move", F.explode("_all").alias("x")).select("sym", "x.g", "x.params", "d", "i", "bars", "close", "x.signal", "x.held", F.abs(F.col("x.held") - F.col("x.before")).alias("turn"), "move")


FIELDS = ("n", "s1", "s2", "d2", "grow", "top", "low", "fall")


def cells(rows: DataFrame, cell: Column, cost_bps: float) -> DataFrame:
    """(sym, g, params, cell, bars, first, last, head, tail): statistics of the cells of runs(), as the first of a window and as a later
    one: n returns, their sum and sum of squares, that of losses alone, log growth, its highest and lowest point, largest fall."""
    rate = cost_bps / 1e4
    by = Window.partitionBy("sym", "g", "cell").orderBy("i")
    d = rows.withColumn("cell", cell).withColumn("_k", F.row_number().over(by))
    later = F.col("held") * F.col("move") - rate * F.col("turn")
    first = F.when(F.col("_k") == 2, F.col("held") * F.col("move") - rate * F.col("held")).when(F.col("_k") > 2, later)
    d = d.withColumns({"_x0": first, "_x1": later})
    floor = lambda x: F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(-1 + 1e-15))))
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_g{v}": F.coalesce(F.sum(floor(F.col(f"_x{v}"))).over(run), F.lit(0.0)) for v in (0, 1)})
    d = d.withColumns({f"_p{v}": F.greatest(F.lit(0.0), F.max(f"_g{v}").over(run)) for v in (0, 1)})

    def stat(v: int) -> Column:
        x, g = F.col(f"_x{v}"), F.col(f"_g{v}")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        values = (F.count(x).cast("double"), zero(F.sum(x)), zero(F.sum(x * x)), zero(F.sum(F.pow(F.least(x, F.lit(0.0)), 2))), F.max_by(g, "i"), F.max(f"_p{v}"), F.least(F.lit(0.0), F.min(g)), F.max(1 - F.exp(g - F.col(f"_p{v}"))))
        return F.struct(*[c.alias(k) for k, c in zip(FIELDS, values, strict=True)])

    return d.groupBy("sym", "g", "params", "cell").agg(F.max("bars").alias("bars"), F.min_by("close", "i").alias("first"), F.max_by("close", "i").alias("last"), stat(0).alias("head"), stat(1).alias("tail"))


def merged(a: Column, b: Column) -> Column:
    """The statistics of a stretch followed by another."""
    out = {k: a[k] + b[k] for k in ("n", "s1", "s2", "d2", "grow")}
    out |= {"top": F.greatest(a["top"], a["grow"] + b["top"]), "low": F.least(a["low"], a["grow"] + b["low"]), "fall": F.greatest(a["fall"], b["fall"], 1 - F.exp(a["grow"] + b["low"] - a["top"]))}
    return F.struct(*[out[k].alias(k) for k in FIELDS])


def metrics(x: Column, year: int = YEAR) -> dict[str, Column]:
    """The objectives, as percentages and ratios of two places; null where undefined."""
    n, mean = x["n"], x["s1"] / F.nullif(x["n"], F.lit(0.0))
    dev = F.sqrt(F.greatest(x["s2"] - x["s1"] * mean, F.lit(0.0)) / F.nullif(n - 1, F.lit(0.0)))
    down = F.sqrt(x["d2"] / F.nullif(n, F.lit(0.0)))
    cagr = F.when(n > 0, F.round((F.exp(x["grow"] * year / n) - 1) * 100, 2))
    fall = F.round(x["fall"] * 100, 2)
    ratio = lambda d: F.when((n >= 2) & (d > 1e-15), F.round(mean / d * year**0.5, 2))
    return {"total_return": F.round((F.exp(x["grow"]) - 1) * 100, 2), "sharpe": ratio(dev), "sortino": ratio(down), "calmar": F.when(fall > 0, F.round(cagr / fall, 2)), "cagr": cagr, "max_drawdown": fall}


def _check(objective: str) -> None:
    if objective not in OBJECTIVES:
        raise ValueError(f"no objective {objective}; known: {', '.join(OBJECTIVES)}")


def leaderboard(bars: DataFrame, strategy: str, grid: dict[str, list] | None = None, objective: str = "sharpe", cost_bps: float = 0.0) -> DataFrame:
    """(sym, place, params, score, total_return, sharpe, sortino, calmar, cagr, max_drawdown): all combinations over the whole
    series, best first; undefined scores last, ties in the order of the grid. This looks ahead: see walk_forward()."""
    _check(objective)
    combos = param_grid(GRIDS[strategy] if grid is None else grid, VALID.get(strategy))
    if not combos:
        return bars.sparkSession.createDataFrame([], "sym string, place int, params string, score double, total_return double, sharpe double, sortino double, calmar double, cagr double, max_drawdown double")
    d = cells(runs(bars, strategy, combos), F.lit(0), cost_bps)
    m = metrics(F.col("head"))
    d = d.select("sym", "g", "params", m[objective].alias("score"), *[c.alias(k) for k, c in m.items()])
    place = F.row_number().over(Window.partitionBy("sym").orderBy(F.col("score").desc_nulls_last(), "g"))
    return d.select("sym", place.alias("place"), "params", "score", *m)


def walk_forward(bars: DataFrame, strategy: str, grid: dict[str, list] | None = None, train: int = 120, test: int = 40, objective: str = "sharpe", cost_bps: float = 0.0, anchored: bool = False) -> DataFrame:
    """(sym, fold, train_start, train_end, test_start, test_end, params, train_return_pct, test_return_pct, stat, first, last): on every
    fold the combination of best objective in training (undefined ones last, ties in the order of the grid) is run on the bars after
    it. Windows are half-open; stat and the first and last close belong to the test window, for report()."""
    _check(objective)
    rest = train % test
    if test < 2 or train < 2 or rest == 1 or test - rest == 1:
        raise ValueError("windows must be of two bars or more, and must not begin one bar apart")
    combos = param_grid(GRIDS[strategy] if grid is None else grid, VALID.get(strategy))
    i = F.col("i")
    per = 2 if rest else 1  # cells in the length of a test window
    cell = F.floor(i / test) if per == 1 else 2 * F.floor(i / test) + (i % test >= rest).cast("int")
    d = cells(runs(bars, strategy, combos or [{}]), cell, cost_bps)
    per_run = d.groupBy("sym", "g", "params").agg(F.max("bars").alias("bars"), F.array_sort(F.collect_list(F.struct("cell", "first", "last", "head", "tail"))).alias("cells"))
    count = F.floor((F.col("bars") - train) / test)
    per_run = per_run.where(count > 0).withColumn("fold", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    lead = per * (train // test) + (1 if rest else 0)  # cells before the first test window
    begin = F.lit(0) if anchored else F.col("fold") * per
    cut = F.col("fold") * per + lead

    def window(a: Column, z: Column) -> Column:
        return F.aggregate(F.slice("cells", a + 2, z - a - 1), F.get("cells", a)["head"], lambda s, c: merged(s, c["tail"]))

    d = per_run.select("sym", "g", "params", "fold", window(begin, cut).alias("inside"), window(cut, cut + per).alias("stat"), F.get("cells", cut)["first"].alias("first"), F.get("cells", cut + per - 1)["last"].alias("last"))
    best = Window.partitionBy("sym", "fold").orderBy(F.col("score").desc_nulls_last(), "g")
    d = d.withColumn("score", metrics(F.col("inside"))[objective]).withColumn("_k", F.row_number().over(best)).where("_k = 1")
    if not combos:
        d = d.where("false")
    start = F.col("fold") * test
    return d.select(
        "sym", "fold", (F.lit(0) if anchored else start).cast("int").alias("train_start"), (start + train).cast("int").alias("train_end"), (start + train).cast("int").alias("test_start"), (start + train + test).cast("int").alias("test_end"),
        "params", metrics(F.col("inside"))["total_return"].alias("train_return_pct"), metrics(F.col("stat"))["total_return"].alias("test_return_pct"), "stat", "first", "last",
    )


def report(folds: DataFrame) -> DataFrame:
    """(sym, folds, oos_return_pct, is_return_pct, efficiency, oos_sharpe, oos_max_drawdown_pct, oos_buy_hold_pct) of walk_forward(): the
    test windows one after another; efficiency is their growth over that of the training windows, null where that is none."""
    d = folds.groupBy("sym").agg(F.array_sort(F.collect_list(F.struct("fold", "stat", "train_return_pct", "first", "last"))).alias("f"))
    one = F.get("f", F.lit(0))
    stat = F.aggregate(F.slice("f", 2, F.greatest(F.size("f"), F.lit(1))), one["stat"], lambda s, x: merged(s, x["stat"]))
    inside = F.aggregate("f", F.lit(1.0), lambda s, x: s * (1 + x["train_return_pct"] / 100))
    d = d.select("sym", F.size("f").alias("folds"), stat.alias("stat"), inside.alias("inside"), one["first"].alias("a"), F.element_at("f", -1)["last"].alias("z"))
    m = metrics(F.col("stat"))
    return d.select(
        "sym", "folds", m["total_return"].alias("oos_return_pct"), F.round((F.col("inside") - 1) * 100, 2).alias("is_return_pct"),
        F.when(F.col("inside") > 1, F.round((F.exp(F.col("stat")["grow"]) - 1) / (F.col("inside") - 1), 3)).alias("efficiency"),
        m["sharpe"].alias("oos_sharpe"), m["max_drawdown"].alias("oos_max_drawdown_pct"), F.round((F.col("z") / F.nullif("a", F.lit(0.0)) - 1) * 100, 2).alias("oos_buy_hold_pct"),
    )
