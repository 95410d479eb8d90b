"""Search and walk-forward against plain loops over one series."""

import math
import random

import pytest

from tessera.operators import search


def sma_signal(c, fast, slow):
    return [int(i + 1 >= slow and sum(c[i + 1 - fast : i + 1]) / fast > sum(c[i + 1 - slow : i + 1]) / slow) for i in range(len(c))]


def rsi_signal(c, low, high, n=14):
    out, at = [], 0
    for i in range(len(c)):
        if i < n:
            out.append(0)
            continue
        moves = [c[j] - c[j - 1] for j in range(i - n + 1, i + 1)]
        up, down = sum(max(m, 0) for m in moves) / n, sum(max(-m, 0) for m in moves) / n
        r = round(100.0 if down == 0 else 100 - 100 / (1 + up / down), 2)
        at = 1 if at == 0 and r < low else 0 if at == 1 and r > high else at
        out.append(at)
    return out


def run(c, s, cost):
    """(returns, equity) of a window run on its own."""
    held, eq, rets = [0, *s[:-1]], [1.0], []
    for t in range(1, len(c)):
        r = held[t] * (c[t] / c[t - 1] - 1) - cost / 1e4 * (held[t] != held[t - 1])
        rets.append(r)
        eq.append(eq[-1] * (1 + r))
    return rets, eq


def fall(eq):
    peak = worst = 0.0
    for v in eq:
        peak = max(peak, v)
        worst = max(worst, (peak - v) / peak)
    return round(worst * 100, 2)


def measures(rets, eq):
    n = len(rets)
    mean = sum(rets) / n
    dev = math.sqrt(sum((r - mean) ** 2 for r in rets) / (n - 1))
    down = math.sqrt(sum(min(r, 0) ** 2 for r in rets) / n)
    cagr, worst = round((eq[-1] ** (252 / n) - 1) * 100, 2), fall(eq)
    return {
        "total_return": round((eq[-1] - 1) * 100, 2), "sharpe": round(mean / dev * 252**0.5, 2) if dev > 0 else None,
        "sortino": round(mean / down * 252**0.5, 2) if down > 0 else None, "cagr": cagr, "calmar": round(cagr / worst, 2) if worst > 0 else None,
    }


@pytest.fixture(scope="module")
def series(spark):
    rnd, c = random.Random(4), [100.0]
    for _ in range(229):
        c.append(c[-1] * (1 + rnd.gauss(0.0005, 0.02)))
    rows = [("A", i, x) for i, x in enumerate(c)] + [("short", i, 1.0 + i) for i in range(30)] + [("A", 500, None)]
    df = spark.createDataFrame(rows, "sym string, k int, close double").selectExpr("sym", "date_add(date'2020-01-01', k) as d", "close")
    return c, df.repartition(3)


SMA = {"fast": [3, 5, 9], "slow": [7, 9]}
COMBOS = [(3, 7), (3, 9), (5, 7), (5, 9)]


def close_to(a, b):
    return a == b or a is not None and b is not None and abs(a - b) < 0.0101


def test_grid():
    assert search.param_grid({}) == [{}]
    assert [tuple(p.values()) for p in search.param_grid(SMA, search.VALID["sma_cross"])] == COMBOS


@pytest.mark.parametrize("objective", search.OBJECTIVES)
def test_leaderboard(series, objective):
    c, df = series
    got = [r for r in search.leaderboard(df, "sma_cross", SMA, objective, 10.0).orderBy("sym", "place").collect() if r.sym == "A"]
    want = {f"fast={f},slow={s}": measures(*run(c, sma_signal(c, f, s), 10.0)) for f, s in COMBOS}
    order = sorted(want, key=lambda k: (want[k][objective] is not None, want[k][objective] or 0.0), reverse=True)
    assert [r.params for r in got] == order
    for r in got:
        assert r.score == r[objective] and all(close_to(r[k], v) for k, v in want[r.params].items())


@pytest.mark.parametrize(("train", "test", "anchored", "objective"), [(60, 20, False, "sharpe"), (60, 20, True, "calmar"), (50, 18, False, "sortino"), (45, 20, True, "total_return")])
def test_walk_forward(series, train, test, anchored, objective):
    c, df = series
    signals = {f"fast={f},slow={s}": sma_signal(c, f, s) for f, s in COMBOS}
    folds = search.walk_forward(df, "sma_cross", SMA, train, test, objective, 5.0, anchored)
    got = {r.fold: r for r in folds.collect()}
    assert {r.sym for r in got.values()} == {"A"} and len(got) == (len(c) - train) // test
    grow, eq, rets = 1.0, [1.0], []
    for k, r in got.items():
        a, m, z = 0 if anchored else k * test, k * test + train, k * test + train + test
        assert (r.train_start, r.train_end, r.test_start, r.test_end) == (a, m, m, z)
        scores = {p: measures(*run(c[a:m], s[a:m], 5.0)) for p, s in signals.items()}
        best = None
        for p in signals:
            if best is None or scores[p][objective] is not None and (scores[best][objective] is None or scores[p][objective] > scores[best][objective]):
                best = p
        assert r.params == best
        inside, (out, curve) = scores[best], run(c[m:z], signals[best][m:z], 5.0)
        assert close_to(r.train_return_pct, inside["total_return"]) and close_to(r.test_return_pct, round((curve[-1] - 1) * 100, 2))
    for k in sorted(got):
        out, curve = run(c[k * test + train : k * test + train + test], signals[got[k].params][k * test + train : k * test + train + test], 5.0)
        grow *= 1 + got[k].train_return_pct / 100
        rets += out
        eq += [eq[-1] * x for x in curve[1:]]
    (rep,) = search.report(folds).collect()
    assert close_to(rep.oos_return_pct, round((eq[-1] - 1) * 100, 2)) and close_to(rep.is_return_pct, round((grow - 1) * 100, 2))
    assert close_to(rep.oos_sharpe, measures(rets, eq)["sharpe"]) and close_to(rep.oos_max_drawdown_pct, fall(eq))
    assert rep.efficiency is None if grow <= 1 else abs(rep.efficiency - (eq[-1] - 1) / (grow - 1)) < 0.001


def test_other_strategies(series, spark):
    c, df = series
    d = search.runs(df.where("sym = 'A'"), "rsi", [{"low": 35, "high": 55}, {"low": 45, "high": 50}]).orderBy("i").collect()
    assert [r.signal for r in d if r.g == 0] == rsi_signal(c, 35, 55) and [r.signal for r in d if r.g == 1] == rsi_signal(c, 45, 50)
    for name in ("momentum", "bollinger", "macd_cross"):
        assert search.leaderboard(df, name).count() == 2 * len(search.param_grid(search.GRIDS[name], search.VALID.get(name)))
    with pytest.raises(ValueError):
        search.leaderboard(df, "candles", {})
    with pytest.raises(ValueError):
        search.leaderboard(df, "sma_cross", objective="luck")
    with pytest.raises(ValueError):
        search.walk_forward(df, "sma_cross", train=41, test=40)
    assert search.leaderboard(df, "sma_cross", {"fast": [9], "slow": [7]}).collect() == []
    assert search.walk_forward(df, "sma_cross", {"fast": [9], "slow": [7]}).collect() == []
    assert search.walk_forward(df.limit(0), "sma_cross").collect() == [] and search.report(search.walk_forward(df.limit(0), "sma_cross")).collect() == []


def test_one_scan_whatever_the_grid(series):
    _, df = series
    plan = search.leaderboard(df, "sma_cross")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
