"""Edges of sessions, agreement with the market, and correlation with peers, against plain recomputation."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import futures, news, stats

MON, SAT = dt.date(2024, 1, 8), dt.date(2024, 1, 13)


def flags(spark, times, **how):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, ts timestamp_ntz")
    return futures.session_flags(d, **how).orderBy("i").collect()


def at(day, h, m=0, s=0):
    return dt.datetime.combine(day, dt.time(h, m, s))


def test_edges_of_the_day(spark):
    times = [at(MON, 8, 59), at(MON, 9), at(MON, 13, 55), at(MON, 14), at(MON, 14, 5), at(MON, 14, 10), at(MON, 18, 29, 59), at(MON, 18, 30), at(MON, 18, 45), at(SAT, 12), None]
    r = flags(spark, times)
    assert [x.in_session for x in r] == [False, True, True, False, True, True, True, True, False, False, None]
    assert [x.clearing for x in r] == [False, False, True, True, True, False, False, False, True, False, None]
    assert [x.force_flat for x in r] == [True, False, False, False, False, False, False, True, True, True, None]
    assert [x.entry_allowed for x in r] == [False, True, False, False, False, True, True, False, False, False, None]
    assert [x.thin for x in r] == [False] * 9 + [True, None] and r[7].to_close == 15.0 and r[8].to_close == 0.0


def test_evening_and_weekend(spark):
    times = [at(MON, 18, 44), at(MON, 18, 45), at(MON, 18, 59), at(MON, 19), at(MON, 19, 10), at(MON, 23, 35), at(SAT, 12), at(SAT, 23, 34, 59)]
    r = flags(spark, times, evening=True, weekend=True)
    assert [x.in_session for x in r] == [True, False, False, True, True, True, True, True]
    assert [x.entry_allowed for x in r] == [False, False, False, False, True, False, True, True]
    assert [x.thin for x in r] == [False, True, True, True, True, True, True, True]


def test_market_agreement(spark):
    rows = [(0.35, 1.0), (0.35, -1.0), (0.9, 0.99), (0.34, -5.0), (0.1, 0.0), (None, 9.0), (0.9, None)]
    d = spark.createDataFrame(rows, "significance double, move double")
    assert [tuple(r) for r in news.market_agreement(d).collect()] == [(5, 3, 3, 2 / 3, 2 / 3)]
    none = news.market_agreement(d.where("significance < 0.2")).first()
    assert tuple(none) == (1, 0, 0, None, None)
    assert news.market_agreement(d.withColumn("k", F.lit("x")), keys=("k",)).first().k == "x"


def test_correlations_with_peers_and_factors(spark):
    r, days = random.Random(9), [MON + dt.timedelta(i) for i in range(60)]
    sector = {"a": "s", "b": "s", "c": "s", "d": "s", "e": "t", "f": "t", "alone": "u"}
    rets = {s: {d: r.gauss(0, 1) for d in days if r.random() < 0.8} for s in sector}
    rets["f"] = {d: 0.0 for d in days}
    d = spark.createDataFrame([(s, x, v) for s, m in rets.items() for x, v in m.items()], "sym string, d date, ret double")
    got = {x.sym: (x.n, x.r) for x in stats.peer_correlations(d, spark.createDataFrame(list(sector.items()), "sym string, sector string")).collect()}
    want = {}
    for s, of in sector.items():
        peers = [p for p in sector if sector[p] == of and p != s]
        need = max(1, -(-len(peers) * 6 // 10))
        pairs = [(rets[s][x], np.mean([rets[p][x] for p in peers if x in rets[p]])) for x in rets[s] if sum(x in rets[p] for p in peers) >= need]
        if len(pairs) >= 20 and np.var([p[0] for p in pairs]) > 0 and np.var([p[1] for p in pairs]) > 1e-20:
            want[s] = (len(pairs), np.corrcoef(np.array(pairs).T)[0, 1])
    assert set(want) <= {"a", "b", "c", "d"} and len(want) == 4 and {k for k in got if k not in want} <= {"e"}
    assert all(got[k][0] == n and abs(got[k][1] - v) < 1e-9 for k, (n, v) in want.items())
    f = d.where("sym in ('b', 'f')").withColumnRenamed("sym", "factor")
    x = {(y.sym, y.factor): y.r for y in stats.factor_correlations(d, f).collect()}
    assert abs(x["b", "b"] - 1) < 1e-9 and ("a", "f") not in x and ("f", "b") not in x
    lv = spark.createDataFrame([("USD", days[0], 90.0), ("EUR", days[0], 100.0), ("USD", days[1], 91.0), ("EUR", days[2], 99.0), ("USD", days[3], 1.0), ("EUR", days[3], 0.0)], "currency string, d date, close double")
    assert [tuple(y) for y in stats.cross_levels(lv, "USD", "EUR").collect()] == [(days[0], 0.9)]
