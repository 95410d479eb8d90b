"""Portfolios against the rules stepped one owner at a time."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tessera.operators import portfolio as pf

DAY = dt.date(2024, 1, 1)
VALUED = "owner int, asset string, sector string, qty double, price double, avg_price double, value double, pnl_pct double, is_cash boolean, weight double"


def weighted(spark, rows):
    return spark.createDataFrame([(o, a, None, 1.0, 1.0, None, w, None, cash, w) for o, a, w, cash in rows], VALUED)


def returns(spark, rets, key="asset"):
    rows = [(a, d, r) for a, days in rets.items() for d, r in days.items()]
    return spark.createDataFrame(rows, f"{key} string, d date, ret double")


def stepped(weights, rets, min_points, window):
    """The book of one owner: the shortest history leaves until enough dates are common."""
    use = {a: rets[a] for a in weights if weights[a] and rets.get(a)}
    while use:
        common = set.intersection(*(set(r) for r in use.values()))
        if len(common) >= min_points:
            break
        del use[min(sorted(use), key=lambda a: len(use[a]))]
    if not use:
        return {}, set()
    total = sum(weights[a] for a in use)
    return {d: sum(weights[a] / total * use[a][d] for a in use) for d in sorted(common)[-window:]}, set(use)


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(5)
    rets = {f"a{k}": {DAY + dt.timedelta(i): r.gauss(0, 0.02) for i in range(80) if r.random() < p} for k, p in enumerate([0.99, 0.9, 0.8, 0.7, 0.5, 0.3, 0.1, 0.02])}
    rets["b0"] = {d: r.gauss(0, 0.01) for d in rets["a1"]}  # as long as a1
    fx = {"USD": {DAY + dt.timedelta(i): r.gauss(0, 0.01) for i in range(40)}}
    rows = []
    for o in range(25):
        names = r.sample(sorted(rets) + ["nothing"], r.randint(1, 7)) + r.choice([[], ["USD"], ["RUB", "USD"]])
        rows += [(o, a, r.choice([0.0, 0.2, 0.5, 1.3]) if a != "USD" else 0.4, a in ("USD", "RUB")) for a in names]
    return rets, fx, rows


@pytest.mark.parametrize(("min_points", "window"), [(20, 250), (5, 30), (60, 250)])
def test_book_equals_the_rule(spark, case, min_points, window):
    rets, fx, rows = case
    d = weighted(spark, rows)
    s = pf.series(d, returns(spark, rets), returns(spark, fx, "currency")).cache()
    book = pf.book(s, min_points, window).cache()
    got, gone = {}, {}
    for x in book.collect():
        got.setdefault(x.owner, {})[x.d] = x.ret
    for x in pf.excluded(s, d, book).collect():
        gone.setdefault(x.owner, set()).add(x.asset)
    shares = {(x.owner, x.asset): x.share_pct for x in pf.risk_shares(s, book, min_points).collect()}
    seen = 0
    for o in {r[0] for r in rows}:
        w = {a: v for k, a, v, _ in rows if k == o}
        mine = {a: rets[a] for a in w if a in rets}
        dates = {x for a in mine if w[a] for x in mine[a]}
        for c in ("RUB", "USD"):
            if c in w and dates:
                mine[c] = {x: fx.get(c, {}).get(x, 0.0) for x in dates}
        # cash is never shorter than a position and leaves after it
        want, members = stepped({("~" if a in ("RUB", "USD") else "") + a: v for a, v in w.items()}, {("~" if a in ("RUB", "USD") else "") + a: r for a, r in mine.items()}, min_points, window)
        assert set(got.get(o, {})) == set(want)
        assert all(math.isclose(got[o][x], want[x], abs_tol=1e-12) for x in want)
        assert gone.get(o, set()) == {a for a in w if a not in {m.lstrip("~") for m in members}}
        if want:
            p = np.array([want[x] for x in sorted(want)])
            whole = {a: v for a, v in w.items() if v and a in mine and all(x in mine[a] for x in want)}
            if p.var() > 0:
                for a, v in whole.items():
                    x = np.array([mine[a][x] for x in sorted(want)])
                    assert abs(shares[o, a] - v / sum(whole.values()) * ((x - x.mean()) * (p - p.mean())).mean() / p.var() * 100) < 0.0501
                    seen += 1
    assert seen > 20


def test_risk_and_values(spark, case):
    rets, fx, rows = case
    s = pf.series(weighted(spark, rows), returns(spark, rets), returns(spark, fx, "currency"))
    book = pf.book(s, 5, 250).cache()
    worth = spark.createDataFrame([(o, 1000.0 + o, None) for o in range(25)], "owner int, total double, cost double")
    risk = {r.owner: r for r in pf.risk(book, worth).collect()}
    values = {}
    for r in pf.value_series(book, worth).collect():
        values.setdefault(r.owner, []).append((r.d, r.value))
    for o, r in risk.items():
        ret = [x.ret for x in book.where(f"owner = {o}").orderBy("d").collect()]
        eq = np.cumprod([1.0] + [1 + x for x in ret])
        assert r.n == len(ret) and abs(r.drawdown_pct - max(1 - eq / np.maximum.accumulate(eq)) * 100) < 0.0051
        assert sorted(values[o])[-1][1] == 1000.0 + o and abs(sorted(values[o])[0][1] - (1000 + o) * eq[1] / eq[-1]) < 0.0051
        if len(ret) < 20:
            assert r.vol_pct is None and r.var95_pct is None and r.es95_pct is None
        else:
            assert abs(r.vol_pct - np.std(ret, ddof=1) * 100) < 0.0051 and abs(r.var95_pct + np.percentile(ret, 5) * 100) < 0.0051 and abs(r.var99_pct + np.percentile(ret, 1) * 100) < 0.0051
            assert abs(r.var95 + np.percentile(ret, 5) * (1000 + o)) < 0.0051


def test_value_of_positions_and_cash(spark):
    pos = spark.createDataFrame([(1, "x", "s", 2.0, 50.0), (1, "y", None, 1.0, 0.0), (1, "gone", "s", 3.0, 9.0), (2, "gone", "s", 1.0, 1.0), (4, "x", "s", 1.0, 200.0)], "owner int, asset string, sector string, qty double, avg_price double").withColumn("price", pos_note())
    price = spark.createDataFrame([("x", 100.0), ("y", 50.0)], "asset string, price double")
    live = spark.createDataFrame([("x", 110.0)], "asset string, price double")
    cash = spark.createDataFrame([(1, "RUB", 30.0), (1, "USD", 1.005), (1, "XAU", 7.0), (3, "RUB", -5.0)], "owner int, currency string, amount double")
    rates = spark.createDataFrame([("USD", 90.0), ("RUB", 55.0)], "currency string, rate double")
    d = pf.valued(pos, price, cash, rates, live).cache()
    got = {(r.owner, r.asset): r for r in d.collect()}
    assert set(got) == {(1, "x"), (1, "y"), (1, "gone"), (1, "RUB"), (1, "USD"), (4, "x")}  # owners 2 and 3 have nothing of worth
    assert got[1, "x"].value == 220.0 and got[1, "x"].pnl_pct == 120.0 and got[1, "y"].pnl_pct is None and got[4, "x"].pnl_pct == -45.0
    assert got[1, "RUB"].value == 30.0 and got[1, "USD"].value == 90.45 and got[1, "gone"].weight is None
    assert math.isclose(sum(r.weight or 0 for k, r in got.items() if k[0] == 1), 1.0)
    worth = {r.owner: (r.total, r.cost) for r in pf.totals(d).collect()}
    assert worth == {1: (390.45, 100.0 + 0 + 27.0 + 30.0 + 90.45), 4: (110.0, 200.0)}
    shares = {(r.owner, r.sector): r.weight_pct for r in pf.allocation(d).collect()}
    assert shares[1, "cash"] == 30.9 and shares[1, "s"] == 56.4 and shares[1, "-"] == 12.8 and (2, "s") not in shares
    plain = {(r.owner, r.asset): r.value for r in pf.valued(pos, price, cash, rates).collect()}
    assert plain[1, "x"] == 200.0


def pos_note():
    from pyspark.sql import functions as F

    return F.lit("a column that clashes")


def test_snapshots_beat_the_book(spark):
    book = spark.createDataFrame([(o, DAY + dt.timedelta(i), 0.1, 1) for o in (1, 2, 3) for i in range(2)] + [(4, DAY, -1.0, 1)], "owner int, d date, ret double, members int")
    worth = spark.createDataFrame([(o, 121.0, None) for o in (1, 2, 3, 4)], "owner int, total double, cost double")
    snaps = spark.createDataFrame([(1, DAY + dt.timedelta(i), 100.0 + i, 90.0 if i else None) for i in range(4)] + [(2, DAY, 5.0, 5.0)], "owner int, d date, total double, cost double")
    got = sorted(map(tuple, pf.value_series(book, worth, snaps, window=3).collect()))
    assert [(o, v, p, s) for o, _, v, p, s in got] == [(1, 101.0, 11.0, "snapshots"), (1, 102.0, 12.0, "snapshots"), (1, 103.0, 13.0, "snapshots")] + [(o, v, None, "reconstructed") for o in (2, 3) for v in (110.0, 121.0)]


def test_correlation_scale_and_factors(spark):
    corr = spark.createDataFrame([("a", "b", 0.9), ("a", "c", -0.7), ("b", "c", 0.59), ("a", "d", None)], "a string, b string, r double")
    held = spark.createDataFrame([(1, "b", 10.0), (1, "c", 0.0), (2, "a", -3.0), (3, "a", 5.0)], "owner int, asset string, value double")
    entries = spark.createDataFrame([(1, "a", 1), (1, "a", -1), (1, "b", 1), (2, "c", 1), (2, "b", 1), (3, "a", 1), (3, "d", 1), (9, "a", 1)], "owner int, asset string, direction int")
    got = {(r.owner, r.asset, r.direction): r.scale for r in pf.correlation_scale(entries, held, corr).collect()}
    assert got == {(1, "a", 1): 0.5, (1, "a", -1): 1.0, (1, "b", 1): 1.0, (2, "c", 1): 0.5, (2, "b", 1): 1.0, (3, "a", 1): 1.0, (3, "d", 1): 1.0, (9, "a", 1): 1.0}
    w = weighted(spark, [(1, "a", 0.5, False), (1, "b", 0.5, False), (2, "z", 1.0, False)])
    betas = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 0.5), ("b", "o", -0.25)], "asset string, factor string, beta double")
    assert {(r.owner, r.factor): r.exposure for r in pf.factor_exposure(w, betas).collect()} == {(1, "m"): 0.75, (1, "o"): -0.125}
    fits = spark.createDataFrame([("a", 0.4), ("z", 0.1)], "asset string, r2 double")
    assert {r.owner: r.avg_r2 for r in pf.mean_r2(w, fits).collect()} == {1: 0.4, 2: 0.1}
    days = returns(spark, {"a": {DAY: 0.0, DAY + dt.timedelta(5): 0.0}, "b": {DAY + dt.timedelta(9): 0.0}})
    assert [tuple(r) for r in pf.settled_day(days, returns(spark, {"m": {DAY: 1.0, DAY + dt.timedelta(1): 1.0}})).collect()] == [("a", DAY)]


def test_nothing(spark):
    s = pf.series(weighted(spark, []), returns(spark, {}), returns(spark, {}, "currency"))
    worth = spark.createDataFrame([], "owner int, total double, cost double")
    book = pf.book(s)
    assert book.count() == pf.risk(book, worth).count() == pf.risk_shares(s, book).count() == pf.value_series(book, worth).count() == 0
