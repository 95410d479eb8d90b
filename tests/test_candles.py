"""Candle positions against the rule stepped bar by bar."""

import datetime as dt
import random

import pytest

from tessera.operators import candlesticks as cs
from tessera.operators import search

UP = [(100 + 2 * i, 101.2 + 2 * i, 99.8 + 2 * i, 101 + 2 * i) for i in range(14)]
DOWN = [(140 - 2 * i, 140.2 - 2 * i, 138.8 - 2 * i, 139 - 2 * i) for i in range(14)]


def frame(spark, rows, sym="a"):
    day = dt.date(2024, 1, 1)
    rows = [(sym, day + dt.timedelta(i), *map(float, x), 1) for i, x in enumerate(rows)]
    return spark.createDataFrame(rows, "sym string, d date, open double, high double, low double, close double, volume long")


def stepped(ways, hold, both):
    at, age, out = 0, 0, []
    for w in ways:
        if at == 0:
            at, age = (w if both or w > 0 else 0), 0
        elif w == -at:
            at, age = (-at if both else 0), 0
        elif w == at:
            age = 0
        else:
            age += 1
            at = 0 if age >= hold else at
        out.append(at)
    return out


def walk(seed, n=400):
    r, last, rows = random.Random(seed), 100.0, []
    for _ in range(n):
        o = last + r.choice([-1, 0, 0, 1]) * r.random()
        c = o + r.choice([-2, -1, -0.1, 0, 0.1, 1, 2]) * r.random()
        rows.append((o, max(o, c) + r.choice([0, 0.1, 2]) * r.random(), min(o, c) - r.choice([0, 0.1, 2]) * r.random(), c))
        last = c
    return rows


@pytest.mark.parametrize("hold", [1, 3, 10])
def test_positions_equal_the_rule(spark, hold):
    bars = frame(spark, walk(1)).unionByName(frame(spark, walk(2), "b")).cache()
    hits = cs.patterns(bars).collect()
    assert len({h.pattern for h in hits}) >= 9 and len(hits) > 100
    days = sorted({r.d for r in bars.collect()})
    for both in (False, True):
        got = {(r.sym, r.d): r.signal for r in cs.candles(bars, hold, both_ways=both).collect()}
        for sym in ("a", "b"):
            ways = {h.d: h.direction for h in hits if h.sym == sym and h.pattern not in cs.UNTRADED}
            assert [got[sym, d] for d in days] == stepped([ways.get(d, 0) for d in days], hold, both)


def test_one_shape_means_two_things(spark):
    hammer, star = (0.9, 1.01, 0.0, 1.0), (0.1, 1.0, -0.01, 0.0)

    def after(rows, shape):
        base = rows[-1][3]
        return {(h.pattern, h.direction) for h in cs.patterns(frame(spark, [*rows, tuple(base + x for x in shape)])).collect() if h.d == dt.date(2024, 1, 15)}

    assert ("hammer", 1) in after(DOWN, hammer) and ("hanging_man", -1) in after(UP, hammer)
    assert ("inverted_hammer", 1) in after(DOWN, star) and ("shooting_star", -1) in after(UP, star)


def test_flat_empty_and_extra_columns(spark):
    flat = frame(spark, [(5, 5, 5, 5)] * 12)
    assert {r.signal for r in cs.candles(flat, both_ways=True).collect()} == {0}
    assert cs.candles(flat.limit(0)).collect() == []
    extra = flat.withColumn("hits_of", flat["close"])
    assert cs.candles(extra).count() == 12


def test_closes_alone(spark):
    closes = frame(spark, walk(3, 60)).select("sym", "d", "close")
    assert {r.signal for r in cs.candles(closes, both_ways=True).collect()} == {0}
    with pytest.raises(ValueError, match="open, high and low"):
        search.leaderboard(closes, "candles")
