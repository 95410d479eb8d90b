"""Queries of alerts on scopes, events, combinations, the calendar and portfolios, all with the keys that make them once-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import alerts
from tessera.operators import indicators as ind
from tessera.operators import portfolio as pf
from tessera.plans import portfolio
from tessera.plans.market import BARS, W, frame, full
from tessera.plans.news import ART, SALIENT, SYMS, articles
from tessera.plans.registry import register
from tessera.sources.tables import bars_1d, table

TYPES = ("sanctions", "dividends", "merger", "regulation", "earnings", "macro", "geopolitics", "other", "noise")
KINDS = ("cbr_rate_meeting", "dividend_cutoff", "report")

_SYM = "['" + "', '".join(SYMS) + "']"
#: Every article counts for the market, a sector and its symbol; background mentions are not negative for a symbol.
LINKS = f"""ln as (select 'MARKET' as scope, null as sym, id, ts, story, score < 0 as negative, significance from art
  union all select 'sector:' || asset_id % 7, null, id, ts, story, score < 0, significance from art
  union all select {_SYM}[1 + asset_id % 5], {_SYM}[1 + asset_id % 5], id, ts, story, score < 0 and {SALIENT}, significance from art),
lk as (select scope, sym, (ts - interval 9000 day)::date as bucket, case when story % 4 = 0 then -id else story end as story_key, negative, significance from ln where significance >= 0.02),
ng as (select scope, any_value(sym) as sym, bucket, count(distinct story_key) filter (negative) as negative, count(distinct story_key) as total from lk group by scope, bucket having count(distinct story_key) filter (negative) >= 3 and count(distinct story_key) filter (negative) / count(distinct story_key) >= 0.5)"""


def spikes(spark, sf_dir):
    a = articles(spark, sf_dir)
    sym = F.get(F.array(*[F.lit(s) for s in SYMS]), (F.col("asset_id") % 5).cast("int"))
    neg, none = F.col("score") < 0, F.lit(None).cast("string")
    scopes = F.array(
        F.struct(F.lit("MARKET").alias("scope"), none.alias("sym"), neg.alias("negative")),
        F.struct(F.concat(F.lit("sector:"), (F.col("asset_id") % 7).cast("string")).alias("scope"), none.alias("sym"), neg.alias("negative")),
        F.struct(sym.alias("scope"), sym.alias("sym"), (neg & F.coalesce("salient", F.lit(True))).alias("negative")),
    )
    d = a.withColumn("story", F.when(F.col("story") % 4 != 0, F.col("story"))).withColumn("story_key", alerts.story_key())
    d = d.select(F.explode(scopes).alias("x"), F.date_sub(F.to_date("ts"), 9000).alias("bucket"), "story_key", "significance")
    return alerts.negative_scopes(d.select("x.*", "bucket", "story_key", "significance"), min_significance=0.02)


@register("negative_scope_alerts", f"with {ART}, {LINKS} select 'neg_spike' as alert_type, sym, 'warning' as severity, 'neg:' || scope || ':' || bucket as dedup_key, bucket, negative, total, round(negative / total, 3) as ratio from ng")
def negative_scope_alerts(spark, sf_dir):
    return spikes(spark, sf_dir)


@register("combo_alerts", f"""with {ART}, {BARS}, {LINKS}, mv as (select sym, d as bucket, (close - lag(close) over {W}) / nullif(lag(close) over {W}, 0) * 100 as change_pct from bars)
select 'combo' as alert_type, sym, 'critical' as severity, 'combo:' || sym || ':' || bucket as dedup_key, bucket, round(change_pct, 6) as change_pct, negative, total from mv join ng using (sym, bucket) where change_pct <= -5""")
def combo_alerts(spark, sf_dir):
    moves = bars_1d(spark, sf_dir).select("sym", F.col("d").alias("bucket"), ind.change_pct(F.col("close"), 1).alias("change_pct")).where(F.abs("change_pct") >= 5)
    return alerts.combos(moves, spikes(spark, sf_dir)).withColumn("change_pct", F.round("change_pct", 6))


_TYPE = "['" + "', '".join(TYPES) + "']"


@register("new_event_alerts", f"""with e as (select event_id, coalesce(case when event_id % 11 <> 0 then {_TYPE}[1 + event_id % 9] end, 'other') as event_type from events where value / 100 >= 0.35),
i as (select event_id, {_SYM}[1 + (event_id + j * j) % 5] as sym, max(((event_id * 7 + j * 3) % 10) / 10.0::double) as m from events, (values (0), (1), (2), (3)) v(j) where j < event_id % 4 group by 1, 2),
s as (select event_id, list(sym order by m desc, sym) as syms from i group by 1)
select 'new_event' as alert_type, syms[1] as sym, case when event_type in ('sanctions', 'geopolitics') then 'critical' else 'warning' end as severity, 'event:' || event_id as dedup_key, event_id, event_type, array_to_string(coalesce(syms, []), ',') as syms
from e left join s using (event_id) where event_type <> 'noise' and (event_type <> 'geopolitics' or syms is not null)""")
def new_event_alerts(spark, sf_dir):
    """Events of nine types, up to three of whose four assets come twice or not at all."""
    key, pick = F.col("event_id"), lambda names, at: F.get(F.array(*[F.lit(x) for x in names]), at.cast("int"))
    t = table(spark, sf_dir, "events")
    events = t.select(key, F.when(key % 11 != 0, pick(TYPES, key % 9)).alias("event_type"), (F.col("value") / 100).alias("significance"))
    links = t.select(key, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).where("j < event_id % 4")
    links = links.select("event_id", pick(SYMS, (key + F.col("j") * F.col("j")) % 5).alias("sym"), ((key * 7 + F.col("j") * 3) % 10 / 10.0).alias("magnitude"))
    return alerts.new_events(events, links).withColumn("syms", F.concat_ws(",", "syms"))


@register("calendar_alerts", """with c as (select ['cbr_rate_meeting', 'dividend_cutoff', 'report'][1 + o_orderkey % 3] as kind, case when o_orderkey % 3 <> 0 then o_orderpriority end as sym, o_orderdate::date as event_date from orders)
select 'calendar' as alert_type, sym, case kind when 'cbr_rate_meeting' then 'warning' else 'info' end as severity, 'cal:' || kind || ':' || coalesce(sym, 'MKT') || ':' || event_date as dedup_key, kind, event_date, (event_date - date '1998-01-01')::int as days_left, count(*) as n
from c where event_date between date '1998-01-01' and date '1998-01-03' group by all""")
def calendar_alerts(spark, sf_dir):
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), (F.col("o_orderkey") % 3).cast("int"))
    items = table(spark, sf_dir, "orders").select(kind.alias("kind"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("sym"), F.to_date("o_orderdate").alias("event_date"))
    d = alerts.calendar(items, "1998-01-01", 2)
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))


@register("portfolio_alerts", f"""with {portfolio.BOOK}, eq as (select *, exp(sum(ln(1 + ret)) over (partition by owner order by d)) as e from bk), pk as (select *, greatest(1, max(e) over (partition by owner order by d)) as peak from eq),
dd as (select owner, round(max((peak - e) / peak) * 100, 2) as x from pk group by 1)
select 'portfolio' as alert_type, null::varchar as sym, 'warning' as severity, 'portfolio:drawdown:u' || owner || ':2024-01-30' as dedup_key, owner, 'drawdown' as kind, x as value from dd where x >= 10
union all select 'portfolio', asset, 'warning', 'portfolio:holding:' || asset || ':u' || owner || ':2024-01-30', owner, 'holding', pnl_pct from va where pnl_pct <= -15""")
def portfolio_alerts(spark, sf_dir):
    rows = portfolio.valued(spark, sf_dir)
    return alerts.portfolios(pf.risk(pf.book(portfolio.series(spark, sf_dir)), pf.totals(rows)), rows, "2024-01-30")


@register("sma_cross_alerts", f"""with {BARS}, m as (select sym, d, {full(f'avg(close) over {frame(50)}', 'close', 50)} as f, {full(f'avg(close) over {frame(200)}', 'close', 200)} as s from bars), q as (select *, lag(f) over {W} as f1, lag(s) over {W} as s1 from m),
k as (select sym, d, case when f1 <= s1 and f > s then 'golden_cross' when f1 >= s1 and f < s then 'death_cross' end as kind from q)
select 'technical' as alert_type, sym, 'warning' as severity, 'tech:' || sym || ':' || kind || ':' || d as dedup_key, d, kind from k where kind is not null""")
def sma_cross_alerts(spark, sf_dir):
    return alerts.crosses(bars_1d(spark, sf_dir))
