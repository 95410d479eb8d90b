"""Queries of portfolios: nations hold symbols listed at different times, suppliers' balances are their cash.

Levels are those of the daily bars from six listing dates on (so histories differ in length), currencies are the mean
order of a day by status. Some positions have no price, no price paid or no sector; one currency has no rate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import exposure as ex
from tessera.operators import portfolio as pf
from tessera.operators import prices, stats
from tessera.plans.market import BARS, INDEX, index_returns
from tessera.plans.news import SYMS
from tessera.plans.registry import register
from tessera.sources.tables import bars_1d, table

LISTED = ("1992-01-01", "1993-07-01", "1995-01-01", "1996-07-01", "1998-01-01", "1998-07-15")
CURRENCIES = ("RUB", "USD", "EUR", "XAU")

_SYM = "['" + "', '".join(SYMS) + "']"
_CCY = "['" + "', '".join(CURRENCIES) + "']"
LEVELS = f"""{BARS}, lv as (select sym || '/' || k as asset, d, close::double as close from bars join (values {", ".join(f"({k}, date '{d}')" for k, d in enumerate(LISTED))}) s(k, since) on d >= since),
fl as (select case o_orderstatus when 'F' then 'USD' else 'EUR' end as currency, o_orderdate::date as d, 60 + avg(o_totalprice)::double / 1e4 as close from orders where o_orderstatus in ('F', 'O') group by 1, 2),
lr as (select asset, d, close / lag(close) over w - 1 as ret, date_diff('day', lag(d) over w, d) as gap from lv window w as (partition by asset order by d)), ar as (select asset, d, ret from lr where gap <= 4 and ret is not null),
fr as (select currency, d, ret from (select currency, d, close / lag(close) over w - 1 as ret, date_diff('day', lag(d) over w, d) as gap from fl window w as (partition by currency order by d)) where gap <= 4)"""
VALUED = f"""po as (select c_nationkey as owner, case when c_custkey % 17 = 0 then 'delisted' else {_SYM}[1 + c_custkey % 5] || '/' || (c_custkey // 5 % 6) end as asset, case when c_custkey % 9 <> 0 then c_mktsegment end as sector,
  (1 + c_custkey % 7)::double as qty, case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then 0 else 50000 + abs(c_acctbal)::double * 10 end as avg_price from customer),
ca as (select s_nationkey as owner, {_CCY}[1 + s_suppkey % 4] as currency, s_acctbal::double as amount from supplier),
v0 as (select owner, asset, sector, qty, price, avg_price, price * qty as value, round((price / nullif(avg_price, 0) - 1) * 100, 2) as pnl_pct, false as is_cash from po left join (select asset, arg_max(close, d) as price from lv group by 1) using (asset)
  union all select owner, currency, 'cash', amount, coalesce(rate, 1), null, round(case when currency = 'RUB' then amount else amount * rate end, 2), null, true from ca left join (select currency, arg_max(close, d) as rate from fl group by 1) using (currency) where currency = 'RUB' or rate is not null),
va as (select *, value / sum(value) over (partition by owner) as weight from v0 qualify sum(value) over (partition by owner) > 0),
tt as (select owner, round(sum(value), 2) as total, round(case when count(*) filter (not is_cash) > 0 and count(*) filter (not is_cash and avg_price is null) = 0 then sum(case when is_cash then coalesce(value, 0) else avg_price * qty end) end, 2) as cost from va group by 1)"""
#: The greatest number of first places with 20 common dates, each number tried on its own.
BOOK = f"""{LEVELS}, {VALUED},
wt as (select owner, asset, is_cash, sum(weight) as weight from va where weight is not null group by all having sum(weight) <> 0),
pl as (select owner, asset, is_cash, weight, row_number() over (partition by owner order by is_cash desc, n desc, asset desc) as place from (select w.*, case when is_cash then 0 else n end as n from wt w left join (select asset, count(*) as n from ar group by 1) using (asset)) where n is not null),
st as (select owner, asset, weight, place, d, ret from pl join ar using (asset) where not is_cash),
sr as materialized (select * from st union all select owner, asset, weight, place, d, case when asset = 'RUB' then 0 else coalesce(ret, 0) end from pl join (select distinct owner, d from st) using (owner) left join (select currency as asset, d, ret from fr) using (asset, d) where is_cash),
cn as (select owner, m, count(*) as c from (select p.owner, p.place as m, d from pl p join sr s on s.owner = p.owner and s.place <= p.place group by 1, 2, 3 having count(*) = p.place) group by 1, 2),
mm as (select owner, max(m) as members from cn where c >= 20 group by 1),
bk as materialized (select owner, d, sum(weight * ret) / sum(weight) as ret, any_value(members) as members from sr join mm using (owner) where place <= members group by 1, 2 having count(*) = any_value(members) qualify row_number() over (partition by owner order by d desc) <= 250)"""


def levels(spark, sf_dir):
    since = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).cast("date").alias("since")) for k, d in enumerate(LISTED)])
    d = bars_1d(spark, sf_dir).select("sym", "d", F.col("close").cast("double").alias("close"), F.explode(since).alias("x")).where("d >= x.since")
    return d.select(F.concat_ws("/", "sym", "x.k").alias("asset"), "d", "close")


def fx_levels(spark, sf_dir):
    d = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    d = d.groupBy(F.when(F.col("o_orderstatus") == "F", "USD").otherwise("EUR").alias("currency"), F.to_date("o_orderdate").alias("d"))
    return d.agg((60 + F.avg("o_totalprice").cast("double") / 1e4).alias("close"))


def valued(spark, sf_dir):
    key, pick = F.col("c_custkey"), lambda names, at: F.get(F.array(*[F.lit(x) for x in names]), at.cast("int"))
    asset = F.when(key % 17 == 0, "delisted").otherwise(F.concat_ws("/", pick(SYMS, key % 5), (F.floor(key / 5) % 6).cast("int")))
    paid = F.when(key % 13 == 0, 0.0).otherwise(50000 + F.abs(F.col("c_acctbal").cast("double")) * 10)
    held = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner"), asset.alias("asset"), F.when(key % 9 != 0, F.col("c_mktsegment")).alias("sector"), (1 + key % 7).cast("double").alias("qty"), F.when(key % 11 != 0, paid).alias("avg_price"))
    cash = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("owner"), pick(CURRENCIES, F.col("s_suppkey") % 4).alias("currency"), F.col("s_acctbal").cast("double").alias("amount"))
    last = lambda d, k, to: prices.newest(d, [k], [F.desc("d")]).select(k, F.col("close").alias(to))
    return pf.valued(held, last(levels(spark, sf_dir), "asset", "price"), cash, last(fx_levels(spark, sf_dir), "currency", "rate"))


def series(spark, sf_dir):
    rets = stats.returns(levels(spark, sf_dir), "asset")
    return pf.series(valued(spark, sf_dir), rets, stats.returns(fx_levels(spark, sf_dir), "currency"))


@register("portfolio_positions", f"with {LEVELS}, {VALUED} select owner, asset, sector, qty, round(price, 4) as price, round(value, 2) as value, round(weight * 100, 2) as weight_pct, pnl_pct from va")
def portfolio_positions(spark, sf_dir):
    d = valued(spark, sf_dir)
    return d.select("owner", "asset", "sector", "qty", F.round("price", 4).alias("price"), F.round("value", 2).alias("value"), F.round(F.col("weight") * 100, 2).alias("weight_pct"), "pnl_pct")


@register("portfolio_totals", f"with {LEVELS}, {VALUED} select owner, total, cost from tt")
def portfolio_totals(spark, sf_dir):
    return pf.totals(valued(spark, sf_dir))


@register("portfolio_sectors", f"with {LEVELS}, {VALUED} select owner, coalesce(sector, '-') as sector, round(sum(round(weight * 100, 2)::decimal(14, 2)), 1)::double as weight_pct from va where weight is not null group by all")
def portfolio_sectors(spark, sf_dir):
    return pf.allocation(valued(spark, sf_dir))


@register("portfolio_returns", f"with {BOOK} select owner, d, round(ret, 8) as ret, members::int as members from bk")
def portfolio_returns(spark, sf_dir):
    return pf.book(series(spark, sf_dir)).withColumn("ret", F.round("ret", 8))


@register("portfolio_excluded", f"with {BOOK} select distinct owner, asset from va where weight is not null and (owner, asset) not in (select (owner, asset) from sr join mm using (owner) where place <= members)")
def portfolio_excluded(spark, sf_dir):
    rows = series(spark, sf_dir)
    return pf.excluded(rows, valued(spark, sf_dir), pf.book(rows))


@register("portfolio_risk", f"""with {BOOK}, eq as (select *, exp(sum(ln(1 + ret)) over (partition by owner order by d)) as e, row_number() over (partition by owner order by ret, d) as k, count(*) over (partition by owner) as n from bk),
pk as (select *, greatest(1, max(e) over (partition by owner order by d)) as peak from eq)
select owner, max(d) as day, count(*) as n, round(stddev_samp(ret) * 100, 2) as vol_pct, round(-quantile_cont(ret, 0.05) * 100, 2) as var95_pct, round(-quantile_cont(ret, 0.01) * 100, 2) as var99_pct,
  round(-avg(ret) filter (k <= greatest(1, round_even((1 - 0.95::double) * n, 0))) * 100, 2) as es95_pct, round(-quantile_cont(ret, 0.05) * any_value(total), 2) as var95, round(max((peak - e) / peak) * 100, 2) as drawdown_pct from pk join tt using (owner) group by owner""")
def portfolio_risk(spark, sf_dir):
    return pf.risk(pf.book(series(spark, sf_dir)), pf.totals(valued(spark, sf_dir)))


@register("portfolio_risk_shares", f"""with {BOOK}, c as (select s.owner, asset, any_value(weight) as weight, covar_pop(s.ret, b.ret) as cov, var_pop(b.ret) as var from sr s join bk b on s.owner = b.owner and s.d = b.d group by s.owner, asset having count(*) = (select count(*) from bk x where x.owner = s.owner))
select owner, asset, round(weight / sum(weight) over (partition by owner) * cov / var * 100, 1) as share_pct from c where var > 0 qualify sum(weight) over (partition by owner) > 0""")
def portfolio_risk_shares(spark, sf_dir):
    rows = series(spark, sf_dir)
    return pf.risk_shares(rows, pf.book(rows))


@register("portfolio_values", f"""with {BOOK}, eq as (select *, sum(ln(1 + ret)) over (partition by owner order by d) as e from bk) select owner, d, round(exp(e - arg_max(e, d) over (partition by owner)) * total / 1e6, 2) as value_m from eq join tt using (owner)""")
def portfolio_values(spark, sf_dir):
    """In millions: cents of such sums lie beyond a double's digits."""
    d = pf.value_series(pf.book(series(spark, sf_dir)), pf.totals(valued(spark, sf_dir)))
    return d.select("owner", "d", F.round(F.col("value") / 1e6, 2).alias("value_m"))


FITTED = f"""{INDEX}, fc as (select 'market' as factor, d, iret as f from ir union all select 'usd', d, ret from fr where currency = 'USD'),
bt as (select asset, factor, covar_pop(ret, f) / var_pop(f) as beta from ar join fc using (d) group by 1, 2 having count(*) >= 60 and var_pop(f) > 1e-12)"""


def fitted(spark, sf_dir):
    """(asset, factor, beta) of each asset on the market and on the dollar, fitted on the dates that both have."""
    rets = stats.returns(levels(spark, sf_dir), "asset").withColumnRenamed("asset", "sym")
    usd = stats.returns(fx_levels(spark, sf_dir), "currency").where("currency = 'USD'").select("d", F.col("ret").alias("iret"))
    one = lambda f, x: stats.beta(rets, x).where("beta is not null").select(F.col("sym").alias("asset"), F.lit(f).alias("factor"), "beta")
    return one("market", index_returns(spark, sf_dir)).unionByName(one("usd", usd))


@register("portfolio_factors", f"with {LEVELS}, {VALUED}, {FITTED} select owner, factor, round(sum(weight * beta), 3) as exposure from va join bt using (asset) where weight is not null group by all")
def portfolio_factors(spark, sf_dir):
    return pf.factor_exposure(valued(spark, sf_dir), fitted(spark, sf_dir))


@register("portfolio_whatif", f"""with {LEVELS}, {VALUED}, {FITTED}, mv as (select asset, coalesce(round(sum(round(beta * shock, 2)), 2), 0) as move from bt left join (values ('market', -5.0::double), ('usd', 3.3)) s(factor, shock) using (factor) group by 1)
select owner, coalesce(round(sum(weight * move), 2), 0) as move_pct from va left join mv using (asset) where weight is not null group by owner""")
def portfolio_whatif(spark, sf_dir):
    shocks = spark.createDataFrame([("market", -5.0), ("usd", 3.3)], "factor string, shock double")
    weights = valued(spark, sf_dir).where("weight is not null").select("owner", "asset", "weight")
    return ex.portfolio_move(weights, ex.scenario(fitted(spark, sf_dir), shocks))


@register("correlation_scale", f"""with {LEVELS}, {VALUED}, c as (select a.asset as a, b.asset as b, corr(a.ret, b.ret) as r from ar a join ar b on a.d = b.d and a.asset < b.asset group by 1, 2 having count(*) >= 20),
en as (select c_custkey as id, c_nationkey as owner, {_SYM}[1 + c_custkey % 5] || '/' || (c_custkey % 6) as asset, case when c_custkey % 3 = 0 then -1 else 1 end::int as direction from customer), o as (select owner, asset, sum(case when qty > 4 then -qty else qty end) * any_value(price) as x from va where not is_cash group by 1, 2)
select id, owner, asset, direction, case when exists (select 1 from o join c on (c.a = o.asset and c.b = en.asset) or (c.b = o.asset and c.a = en.asset) where o.owner = en.owner and o.x <> 0 and o.asset <> en.asset and abs(r) >= 0.6 and (case when r > 0 then 1 else -1 end) * (case when x > 0 then 1 else -1 end) = direction) then 0.5 else 1.0 end::double as scale from en""")
def correlation_scale(spark, sf_dir):
    key = F.col("c_custkey")
    names = F.get(F.array(*[F.lit(x) for x in SYMS]), (key % 5).cast("int"))
    entries = table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_nationkey").alias("owner"), F.concat_ws("/", names, (key % 6).cast("int")).alias("asset"), F.when(key % 3 == 0, -1).otherwise(1).alias("direction"))
    net = F.sum(F.when(F.col("qty") > 4, -F.col("qty")).otherwise(F.col("qty")))  # of quantities, so that equal ones cancel
    open_ = valued(spark, sf_dir).where("not is_cash").groupBy("owner", "asset").agg((net * F.first("price")).alias("value"))
    corr = stats.correlation_matrix(stats.returns(levels(spark, sf_dir), "asset").withColumnRenamed("asset", "sym"))
    return pf.correlation_scale(entries, open_, corr)


@register("factor_correlations", f"""with {LEVELS}, cr as (select a.d, a.close / b.close as close from fl a join fl b on a.d = b.d and a.currency = 'USD' and b.currency = 'EUR' where b.close <> 0),
fa as (select 'usd_rub' as factor, d, ret from fr where currency = 'USD' union all select 'usd_eur', d, ret from (select d, close / lag(close) over w - 1 as ret, date_diff('day', lag(d) over w, d) as gap from cr window w as (order by d)) where gap <= 4),
x as (select asset, factor, ar.ret as a, fa.ret as b from ar join fa using (d)
  union all select a.asset, 'sector_peers', any_value(a.ret), avg(p.ret) from ar a join ar p on a.d = p.d and a.asset <> p.asset and split_part(a.asset, '/', 2) = split_part(p.asset, '/', 2) group by a.asset, a.d having count(*) >= 3)
select asset as sym, factor, count(*) as n, round(corr(a, b), 6) as r from x group by 1, 2 having count(*) >= 20 and var_pop(a) > 0 and var_pop(b) > 0""")
def factor_correlations(spark, sf_dir):
    """With the dollar, the dollar in euros, and the other symbols listed on the same date."""
    rets = stats.returns(levels(spark, sf_dir), "asset").withColumnRenamed("asset", "sym")
    fx = fx_levels(spark, sf_dir)
    cross = stats.returns(stats.cross_levels(fx, "USD", "EUR").withColumn("currency", F.lit("usd_eur")), "currency")
    usd = stats.returns(fx.where("currency = 'USD'"), "currency").withColumn("currency", F.lit("usd_rub"))
    factors = usd.unionByName(cross).withColumnRenamed("currency", "factor")
    sectors = rets.select("sym").distinct().withColumn("sector", F.split("sym", "/")[1])
    return stats.factor_correlations(rets, factors).unionByName(stats.peer_correlations(rets, sectors)).withColumn("r", F.round("r", 6))
