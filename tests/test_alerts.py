"""Alert rules against plain recomputation, and what makes them harmless to repeat."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import alerts

D = dt.date(2024, 1, 5)
LINK = "scope string, sym string, bucket string, story_key long, negative boolean, significance double"


def test_negative_scopes_count_stories(spark):
    r = random.Random(3)
    rows = []
    for _ in range(3000):
        sym = r.choice(["A", "B", "C", "D"])
        scope = r.choice([("MARKET", None), ("sector:1", None), (sym, sym)])
        rows.append((*scope, f"2024-01-{r.randint(1, 9):02}", r.choice([r.randint(-6, -1), r.randint(0, 12)]), r.choice([True, False, False, None]), r.choice([None, 0.2, 0.35, 0.9])))
    want = {}
    for scope, _, bucket, story, neg, sig in rows:
        if sig is not None and sig >= 0.35:
            want.setdefault((scope, bucket), {}).setdefault(story, []).append(bool(neg))
    want = {k: (sum(map(any, v.values())), len(v)) for k, v in want.items()}
    want = {k: v for k, v in want.items() if v[0] >= 3 and v[0] / v[1] >= 0.5}
    got = {(x.scope_of, x.bucket): (x.negative, x.total) for x in (type("R", (), {"scope_of": a.dedup_key[4:].rsplit(":", 1)[0], **a.asDict()}) for a in alerts.negative_scopes(spark.createDataFrame(rows, LINK)).collect())}
    assert got == want and 5 < len(want) < 54
    for a in alerts.negative_scopes(spark.createDataFrame(rows, LINK)).collect():
        assert a.sym == (a.dedup_key.split(":")[1] if a.dedup_key[4] in "ABCD" else None) and a.severity == "warning" and a.ratio == round(a.negative / a.total, 3)
    assert alerts.negative_scopes(spark.createDataFrame([], LINK)).count() == 0


def test_story_key_keeps_articles_apart(spark):
    d = spark.createDataFrame([(7, 3), (3, None), (8, None), (None, None)], "id int, story int")
    assert [r[0] for r in d.select(alerts.story_key()).collect()] == [3, -3, -8, None]


def test_new_events(spark):
    e = [(1, "sanctions", 0.5), (2, "noise", 0.9), (3, "geopolitics", 0.9), (4, "geopolitics", 0.4), (5, None, 0.35), (6, "macro", 0.34), (7, "macro", None), (None, "macro", 0.9), (8, "merger", 0.8), (8, "merger", 0.8)]
    i = [(1, "B", 0.2), (1, "A", 0.2), (1, "C", 0.7), (1, "C", 0.1), (4, "Z", 0.1), (2, "A", 1.0), (9, "A", 1.0)]
    d = spark.createDataFrame(e, "event_id int, event_type string, significance double").withColumn("sym", F.lit("clash"))
    got = {r.event_id: r for r in alerts.new_events(d, spark.createDataFrame(i, "event_id int, sym string, magnitude double")).collect()}
    assert set(got) == {1, 4, 5, 8}  # 3 has no asset to value it by
    assert got[1].syms == ["C", "A", "B"] and got[1].sym == "C" and got[1].severity == "critical" and got[1].dedup_key == "event:1"
    assert got[4].sym == "Z" and got[5].event_type == "other" and got[5].sym is None and got[5].syms == [] and got[8].severity == "warning"
    every = alerts.new_events(d, spark.createDataFrame(i, "event_id int, sym string, magnitude double"), need_impact=())
    assert {r.event_id for r in every.collect()} == {1, 3, 4, 5, 8}


def test_combos_need_both(spark):
    moves = spark.createDataFrame([("A", "d1", -6.0), ("A", "d2", 7.0), ("B", "d1", -5.5), ("C", "d1", -9.0)], "sym string, bucket string, change_pct double")
    neg = [("A", "A", "d1"), ("A", "A", "d2"), ("B", "B", "d2"), ("MARKET", None, "d1")]
    spikes = alerts.negative_scopes(spark.createDataFrame([(s, y, b, k, True, 1.0) for s, y, b in neg for k in range(4)], LINK))
    assert [(r.sym, r.bucket, r.change_pct, r.negative, r.total, r.severity, r.dedup_key) for r in alerts.combos(moves, spikes).collect()] == [("A", "d1", -6.0, 4, 4, "critical", "combo:A:d1")]


def test_calendar_window(spark):
    days = lambda n: D + dt.timedelta(n)
    items = [("cbr_rate_meeting", None, days(0)), ("dividend_cutoff", "A", days(1)), ("split", "B", days(1)), ("dividend_cutoff", "C", days(2)), ("dividend_cutoff", "D", days(-1)), (None, "E", days(0)), ("", "E", days(0)), ("split", "F", None)]
    d = spark.createDataFrame(items, "kind string, sym string, event_date date")
    got = {r.dedup_key: (r.severity, r.days_left) for r in alerts.calendar(d, "2024-01-05").collect()}
    assert got == {"cal:cbr_rate_meeting:MKT:2024-01-05": ("warning", 0), "cal:dividend_cutoff:A:2024-01-06": ("info", 1), "cal:split:B:2024-01-06": ("info", 1)}


def test_portfolios_at_the_limits(spark):
    risk = spark.createDataFrame([(1, 10.0), (2, 9.99), (3, None), (None, 50.0)], "owner int, drawdown_pct double")
    held = spark.createDataFrame([(1, "A", -15.0), (1, "B", -14.99), (2, "A", -80.0), (None, "A", -20.0), (3, "C", None)], "owner int, asset string, pnl_pct double")
    got = sorted((r.dedup_key, r.sym, r.kind, r.value) for r in alerts.portfolios(risk, held, "b").collect())
    assert got == [("portfolio:drawdown:b", None, "drawdown", 50.0), ("portfolio:drawdown:u1:b", None, "drawdown", 10.0), ("portfolio:holding:A:b", "A", "holding", -20.0), ("portfolio:holding:A:u1:b", "A", "holding", -15.0), ("portfolio:holding:A:u2:b", "A", "holding", -80.0)]


def test_crosses_and_fresh(spark):
    r = random.Random(1)
    closes = [100 + 10 * r.random() + (i // 9 % 2) * 8 for i in range(60)]
    bars = spark.createDataFrame([("a", D + dt.timedelta(i), c) for i, c in enumerate(closes)], "sym string, d date, close double")
    mean = lambda i, n: sum(closes[i + 1 - n : i + 1]) / n if i + 1 >= n else None
    want = {}
    for i in range(20, 60):
        f, s, f1, s1 = mean(i, 5), mean(i, 20), mean(i - 1, 5), mean(i - 1, 20)
        if f1 <= s1 and f > s:
            want[D + dt.timedelta(i)] = "golden_cross"
        elif f1 >= s1 and f < s:
            want[D + dt.timedelta(i)] = "death_cross"
    found = alerts.crosses(bars, 5, 20).cache()
    assert {x.d: x.kind for x in found.collect()} == want and len(set(want.values())) == 2
    stored = found.limit(1)
    left = alerts.fresh(found.unionByName(found), stored)
    assert left.count() == len(want) - 1 and left.columns == found.columns
    assert alerts.fresh(found, found).count() == 0
