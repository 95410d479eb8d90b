"""News analytics over articles (id, ts, type, score, significance, asset_id, salient)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of an event type in an impact.
TYPE_WEIGHT = {"purchase": 0.9, "error": 0.7, "signup": 0.5, "click": 0.3, "view": 0.2}


def salient(c: str = "salient") -> Column:
    """Not false: null counts as salient."""
    return F.coalesce(F.col(c), F.lit(True))


def daily_sentiment(articles: DataFrame) -> DataFrame:
    """(scope, key, d, mean, breadth, dispersion, n, weight): one pass; an article counts for the market and,
    if salient, for its asset."""
    scopes = F.array(F.struct(F.lit("market").alias("scope"), F.lit("").alias("key")), F.when(salient(), F.struct(F.lit("asset").alias("scope"), F.col("asset_id").cast("string").alias("key"))))
    d = articles.select(F.to_date("ts").alias("d"), "score", "significance", F.explode(F.filter(scopes, lambda s: s.isNotNull())).alias("s"))
    breadth = F.avg(F.when(F.col("score") > 0.05, 1.0).when(F.col("score") < -0.05, -1.0).otherwise(0.0))
    return d.groupBy("s.scope", "s.key", "d").agg(F.avg("score").alias("mean"), breadth.alias("breadth"), F.stddev_pop("score").alias("dispersion"), F.count(F.lit(1)).alias("n"), F.sum("significance").alias("weight"))


def ewma(daily: DataFrame, keys: list[str], value: str, span: int = 14) -> DataFrame:
    """daily with ewma over a key's days in order, alpha 2 / (span + 1), started at the first value."""
    alpha = 2.0 / (span + 1)
    xs = daily.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", F.col(value).alias("v")))).alias("xs"))
    step = lambda out, x: F.concat(out, F.array(F.struct(x["d"].alias("d"), (F.element_at(out, -1)["v"] * (1 - alpha) + x["v"] * alpha).alias("v"))))
    out = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.slice("xs", 1, 1), step)
    return xs.select(*keys, F.explode(out).alias("x")).select(*keys, "x.d", F.col("x.v").alias("ewma"))


def pressure(articles: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(asset_id, pressure): significance of salient links in the window before as_of, per day."""
    end = F.lit(as_of).cast("timestamp")
    d = articles.where(salient() & (F.col("ts") > end - F.expr(f"interval {days} days")) & (F.col("ts") <= end))
    return d.groupBy("asset_id").agg((F.sum("significance") / days).alias("pressure"))


def impacts(articles: DataFrame, *keep: str) -> DataFrame:
    """(id, asset_id, direction, magnitude, and the columns to keep) of salient links: min(1, type weight * max(|score| or .3, .2)), 3 places."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHT.items() for x in kv]), F.col("type")), F.lit(0.3))
    strength = F.greatest(F.when(F.col("score") == 0, 0.3).otherwise(F.abs(F.coalesce("score", F.lit(0.3)))), F.lit(0.2))
    way = F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative").otherwise("neutral")
    return articles.where(salient()).select("id", "asset_id", way.alias("direction"), F.round(F.least(F.lit(1.0), w * strength), 3).alias("magnitude"), *keep)


def outcomes(events: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """events (id, sym, d, ...) with ret_h: move from the last bar strictly before d to h bars later; null while pending."""
    from tessera.operators.prices import asof_join

    w = Window.partitionBy("sym").orderBy("d")
    row = F.struct("close", *[F.lead("close", h).over(w).alias(f"c{h}") for h in horizons])
    d = asof_join(events, bars.select("sym", "d", row.alias("bar")), "sym", "d", "bar", strict=True)
    base = F.col("asof_bar.close")
    return d.select(*events.columns, *[((F.col(f"asof_bar.c{h}") / F.nullif(base, F.lit(0.0)) - 1) * 100).alias(f"ret_{h}") for h in horizons])


#: When the main session of the exchange ends, and its time zone.
CLOSE, ZONE = "18:50:00", "Europe/Moscow"


def trading_date(ts: Column) -> Column:
    """The trading date of a time: the exchange's date, from after the close on the next one."""
    local = F.from_utc_timestamp(ts, ZONE)
    return F.date_add(F.to_date(local), (F.date_format(local, "HH:mm:ss.SSSSSS") > f"{CLOSE}.000000").cast("int"))


def abnormal_outcomes(events: DataFrame, bars: DataFrame, index: DataFrame, horizons: tuple[int, ...] = (1, 3, 5), window: int = 250, min_obs: int = 60) -> DataFrame:
    """events (sym, d, ...) with status, base_date, beta, ret_h and abn_h (percent, 4 places).

    The base is the last bar strictly before d; ret_h is its move to h bars later, abn_h that less beta times the move of
    the index (d, close; the newest at or before each of the two dates). beta is the slope over the daily returns of the last
    `window` bars up to the base whose dates and the dates before them are the index's too; null with fewer than
    min_obs of these or an index that stands still, and then 1 is taken. status: labeled; pending while the longest horizon is
    not reached; no_history without a bar before d.

    Sums of n, x, y, xx and xy run along each symbol, and the window's are differences of two of them: one pass over
    the bars whatever the window. Rows of null status fields keep their events."""
    from tessera.operators.prices import asof_join, filled_days

    w = Window.partitionBy("sym").orderBy("d")
    until = bars.agg(F.max("d").alias("d")).first().d
    days = filled_days(index.select(F.lit("index").alias("name"), F.col("d"), F.col("close").alias("value")), until)
    b = bars.select("sym", "d", F.col("close").cast("double").alias("close")).join(days.select(F.col("day").alias("d"), F.col("value").alias("ix"), (F.col("at") == F.col("day")).alias("same")), "d", "left")
    b = b.withColumn("on", F.when(F.col("same"), F.col("ix")))
    past = lambda c: F.lag(c).over(w)
    b = b.withColumns({"y": F.col("close") / F.nullif(past("close"), F.lit(0.0)) - 1, "x": F.col("on") / F.nullif(past("on"), F.lit(0.0)) - 1})
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    parts = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y")}
    b = b.withColumns({k: F.sum(F.when(both, c).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k, c in parts.items()})
    b = b.withColumns({k: F.col(k) - F.coalesce(F.lag(k, window).over(w), F.lit(0.0)) for k in parts})
    var = F.col("sxx") - F.col("sx") * F.col("sx") / F.nullif("n", F.lit(0.0))
    beta = F.when((F.col("n") >= min_obs) & (var > 1e-12), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / var)
    ahead = [F.lead(c, h).over(w).alias(f"{c}_{h}") for h in horizons for c in ("close", "ix")]
    bar = F.struct("d", "close", "ix", beta.alias("beta"), *ahead)
    d = asof_join(events, b.select("sym", "d", bar.alias("bar")), "sym", "d", "bar", strict=True)
    x = lambda f: F.col(f"asof_bar.{f}")
    ripe = x(f"close_{max(horizons)}").isNotNull() & (x("close") != 0)
    out = {"status": F.when(x("d").isNull(), "no_history").when(F.coalesce(ripe, F.lit(False)), "labeled").otherwise("pending"), "base_date": F.when(ripe, x("d")), "beta": F.when(ripe, x("beta"))}
    out |= {f"ret_{h}": F.when(ripe, F.round((x(f"close_{h}") / x("close") - 1) * 100, 4)) for h in horizons}
    d = d.select(*events.columns, "asof_bar", *[c.alias(k) for k, c in out.items()])
    move = {h: (x(f"ix_{h}") / F.nullif(x("ix"), F.lit(0.0)) - 1) * 100 for h in horizons}
    return d.withColumns({f"abn_{h}": F.round(F.col(f"ret_{h}") - F.coalesce("beta", F.lit(1.0)) * move[h], 4) for h in horizons}).drop("asof_bar")


def unconfounded(rows: DataFrame, key: str = "asset_id", at: str = "base_date", days: int = 0) -> DataFrame:
    """Rows (key, at, type, ...) of an asset that has no row of another type within so many days of theirs: one window, no pairs."""
    w = Window.partitionBy(key).orderBy(F.datediff(at, F.lit("1970-01-01"))).rangeBetween(-days, days)
    return rows.withColumns({"_a": F.min("type").over(w), "_b": F.max("type").over(w)}).where("_a = _b or type is null and _a is null").drop("_a", "_b")


def event_study(rows: DataFrame, horizons: tuple[int, ...] = (1, 3, 5), min_n: int = 5, hit: float = 2.0) -> DataFrame:
    """(type, n, aar_h, mean_abs_h, hit_rate, weight) of outcomes: mean and mean size of abnormal moves (raw ones where there is
    none), share of first horizons of at least `hit` percent, and the size at the last horizon over the largest one (null if that is 0).
    Types below min_n rows are left out. Rows are aggregated first; weights are taken over a row a type."""
    v = {h: F.coalesce(f"abn_{h}", f"ret_{h}") for h in horizons}
    first, last = v[horizons[0]], f"mean_abs_{horizons[-1]}"
    means = [x for h, c in v.items() for x in (F.round(F.avg(c), 3).alias(f"aar_{h}"), F.round(F.avg(F.abs(c)), 3).alias(f"mean_abs_{h}"))]
    d = rows.where("type is not null").groupBy("type").agg(F.count(first).alias("n"), *means, F.round(F.avg((F.abs(first) >= hit).cast("double")), 3).alias("hit_rate"))
    top = F.max(last).over(Window.partitionBy(F.lit(1)))
    return d.where(F.col("n") >= min_n).withColumn("weight", F.when(top > 0, F.round(F.col(last) / top, 3)))


def reliability(rows: DataFrame, prior: float = 0.5, strength: float = 20.0) -> DataFrame:
    """(source, n, hits, reliability) of (source, score, move): directional hits shrunk to a prior."""
    d = rows.where((F.abs("score") > 0) & (F.abs("move") >= 0.5))
    d = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.signum("score") == F.signum("move")).alias("hits"))
    return d.withColumn("reliability", F.round((F.col("hits") + strength * prior) / (F.col("n") + strength), 4))


def market_agreement(rows: DataFrame, gate: float = 0.35, move_pct: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(<keys>, n, flagged, moved, precision, recall) of rows (significance, move) by keys: how far what the gate lets pass
    and what moved by move_pct or more agree. Rows without either value do not count; a measure without a denominator is null."""
    d = rows.where("significance is not null and move is not null").withColumns({"_f": F.col("significance") >= gate, "_m": F.abs("move") >= move_pct})
    d = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("_f").alias("flagged"), F.count_if("_m").alias("moved"), F.count_if(F.col("_f") & F.col("_m")).alias("_tp"))
    share = lambda of: F.col("_tp") / F.nullif(F.col(of), F.lit(0))
    return d.select(*keys, "n", "flagged", "moved", share("flagged").alias("precision"), share("moved").alias("recall"))
