"""Queries of the payload parsers. Payloads are written from rows of the supplied tables, some records broken on purpose; the SQL
says from the same rows what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import register
from tessera.sources import payloads
from tessera.sources.tables import table


#: Keys of a payload: a feed is asked for one stretch after the other.
STRETCH = 1 << 14


def _joined(d, key: str, order: str, record: str, head: str, tail: str, sep: str = ""):
    """(id, payload): the records of each key, in order, between head and tail, a payload for each stretch of the order. All of a key in one payload would be too
    large for a task, and beyond 2 GB for Spark."""
    rows = d.select(F.expr(key).alias("id"), F.expr(order).alias("o"), F.expr(record).alias("r"))
    rows = rows.groupBy("id", F.floor(F.col("o") / STRETCH)).agg(F.array_sort(F.collect_list(F.struct("o", "r"))).alias("rs"))
    return rows.select("id", F.concat(F.lit(head), F.array_join(F.transform("rs", lambda x: x["r"]), sep), F.lit(tail)).alias("payload"))


@register("fx_payloads", "select o_custkey % 40 as id, o_orderdate::date as d, o_totalprice as value from orders where o_orderkey % 7 not in (1, 2, 3)")
def fx_payloads(spark, sf_dir):
    record = """case o_orderkey % 7 when 1 then '<Record Date="45.13.2026"><VunitRate>1</VunitRate></Record>' when 2 then concat('<Record Date="', date_format(o_orderdate, 'dd.MM.yyyy'), '"><Value>1</Value></Record>')
      when 3 then '<Record><VunitRate>7,5</VunitRate></Record>' else concat('<Record Date="', date_format(o_orderdate, 'dd.MM.yyyy'), '" Id="R01235"><Nominal>1</Nominal><VunitRate>', replace(cast(cast(o_totalprice as decimal(14, 2)) as string), '.', ','), '</VunitRate></Record>') end"""
    return payloads.fx_rates(_joined(table(spark, sf_dir, "orders"), "o_custkey % 40", "o_orderkey", record, '<?xml version="1.0"?><ValCurs>', "</ValCurs>"))


@register("metal_payloads", "select o_custkey % 30 as id, ['gold', 'silver', 'platinum', 'palladium'][(o_orderkey % 6)::int] as indicator, o_orderdate::date as d, o_totalprice as value from orders where o_orderkey % 6 between 1 and 4")
def metal_payloads(spark, sf_dir):
    record = """concat('<Record Date="', date_format(o_orderdate, 'dd.MM.yyyy'), '" Code="', o_orderkey % 6, '"><Buy>1</Buy><Sell>', replace(cast(cast(o_totalprice as decimal(14, 2)) as string), '.', ','), '</Sell></Record>')"""
    return payloads.metal_prices(_joined(table(spark, sf_dir, "orders"), "o_custkey % 30", "o_orderkey", record, "<Metall>", "</Metall>"))


@register("observation_payloads", "select user_id % 25 as id, ts::date as d, value from events where event_id % 5 not in (1, 2)")
def observation_payloads(spark, sf_dir):
    record = """case event_id % 5 when 1 then '{"date": "2024-01-05", "value": "."}' when 2 then '{"date": "soon", "value": "5"}' else concat('{"date": "', date_format(ts, 'yyyy-MM-dd'), '", "value": "', cast(value as string), '"}') end"""
    return payloads.observations(_joined(table(spark, sf_dir, "events"), "user_id % 25", "event_id", record, '{"count": 1, "observations": [', "]}", ", "))


@register("depth_payloads", """with e as (select event_id as id, case when event_id % 3 = 0 then null else value end as bid, case when event_id % 3 = 1 then null else value + 1 end as ask, case when event_id % 4 = 0 then 0.25 end as sp, case when event_id % 5 <> 0 then event_id % 90 end as bv, case when event_id % 5 <> 1 then event_id % 70 end as av from events where event_id % 11 <> 0)
select id, bid as best_bid, ask as best_ask, round(coalesce(sp, ask - bid), 6) as spread, bv::double as bid_vol, av::double as ask_vol, round(case when bv + av > 0 then (bv - av)::double / (bv + av) end, 6) as imbalance, (id % 13)::int as levels from e""")
def depth_payloads(spark, sf_dir):
    say = lambda c: f"coalesce(cast({c} as string), 'null')"
    cells = ["event_id % 13", say("case when event_id % 3 <> 0 then value end"), say("case when event_id % 3 <> 1 then value + 1 end"), say("case when event_id % 4 = 0 then 0.25D end"), say("case when event_id % 5 <> 0 then event_id % 90 end"), say("case when event_id % 5 <> 1 then event_id % 70 end")]
    row = "concat('{\"marketdata\": {\"columns\": [\"SECID\", \"NUMBIDS\", \"BID\", \"OFFER\", \"SPREAD\", \"BIDDEPTHT\", \"OFFERDEPTHT\"], \"data\": [[\"X\", ', " + ", ', ', ".join(cells) + ", ']]}}')"
    d = table(spark, sf_dir, "events").selectExpr("event_id as id", f"case when event_id % 11 = 0 then '{{\"marketdata\": {{\"columns\": [], \"data\": []}}}}' else {row} end as payload")
    out = payloads.depth(d)
    return out.withColumns({c: F.round(c, 6) for c in ("spread", "imbalance")})


@register("channel_payloads", "select user_id as id, 'chan/' || event_id as post_id, event_type || ' & ' || chr(10) || '«' || user_id || '»' as text, ts as published from events where event_id % 6 not in (0, 1) union all select user_id, 'chan/' || event_id, 'Я', null from events where event_id % 6 = 1")
def channel_payloads(spark, sf_dir):
    record = """concat('<div data-post="chan/', event_id, '">', case event_id % 6 when 0 then '<div class="photo"></div>' when 1 then '<div class="tgme_widget_message_text">&#1071;</div><time datetime="soon">'
      else concat('<div class="tgme_widget_message_text js"><b>', event_type, '</b> &amp; <br/>&laquo;', user_id, '&raquo; </div><time datetime="', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '+00:00">') end, '</div>')"""
    d = payloads.channel_posts(_joined(table(spark, sf_dir, "events"), "user_id", "event_id", record, "<html>", "</html>"))
    return d.withColumn("published", F.col("published").cast("timestamp_ntz"))


@register("report_payloads", """with s as (select s_suppkey as id, round(s_acctbal, 2)::decimal(14, 2) as a, s_suppkey % 4 as k from supplier), y(y, f) as (values (2022, 1), (2023, 2)), v as (select id, a * f as a, k, y::varchar as period from s, y),
f as (select id, 'revenue' as metric, a::double * 1000000000 as value, 'RUB' as unit, period from v where k <> 3 union all select id, 'net_profit', (a - 1)::double * 1000000, 'USD', period from v union all select id, 'roe', (id % 50)::double + 0.5, 'pct', period from v union all select id, 'eps', (id % 9)::double, 'RUB', period from v where period = '2023')
select * from f union all select id, 'net_margin', round((a - 1)::double * 1000000 / (a::double * 1000000000) * 100, 2), 'pct', period from v where k <> 3 and a <> 0""")
def report_payloads(spark, sf_dir):
    a = "cast(round(s_acctbal, 2) as decimal(14, 2))"
    money = lambda x: f"replace(cast({x} as string), '.', ',')"
    page = f"""concat('<table><tr><th></th><td class="chartrow"></td><td>2022</td><td>2023</td><td>LTM</td></tr><tr field="revenue"><th>x<span>млрд руб</span></th><td class="chartrow"></td><td>',
      case when s_suppkey % 4 = 3 then '-' else {money(a)} end, '</td><td>', case when s_suppkey % 4 = 3 then '' else {money(f"{a} * 2")} end, '</td><td>7</td></tr><tr field="net_income"><th><span>млн долл</span></th><td>', {money(f"{a} - 1")}, '</td><td>', {money(f"{a} * 2 - 1")},
      '</td></tr><tr field="roe"><th><span>%</span></th><td>', s_suppkey % 50, ',5%</td><td>', s_suppkey % 50, '.5 %</td></tr><tr field="eps"><th><span>руб/акцию</span></th><td>—</td><td>', s_suppkey % 9, '</td></tr><tr field="none"><td>1</td><td>2</td></tr><tr><td></td></tr></table>') as payload"""
    return payloads.yearly_reports(table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", page))
