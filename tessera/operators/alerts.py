"""Alert rules as filters; keys make repeated evaluation harmless."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.indicators import by_symbol, sma


def negative_spikes(articles: DataFrame, since: str, min_count: int = 3, min_ratio: float = 0.5) -> DataFrame:
    """(asset_id, negative, total) with enough distinct negative stories since a time; salience gates the negative count alone."""
    d = articles.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    neg = (F.col("score") < 0) & F.coalesce("salient", F.lit(True))
    d = d.groupBy("asset_id").agg(F.count_distinct(F.when(neg, F.col("story"))).alias("negative"), F.count_distinct("story").alias("total"))
    return d.where((F.col("negative") >= min_count) & (F.col("negative") >= min_ratio * F.col("total")))


def technical(rows: DataFrame, low: float = 30.0, high: float = 70.0, spike: float = 3.0) -> DataFrame:
    """(sym, d, kind): one row for each condition that (rsi, close, high_n, low_n, volume_spike) meets."""
    kinds = {"rsi_low": F.col("rsi") <= low, "rsi_high": F.col("rsi") >= high, "high_52w": F.col("close") >= F.col("high_n"), "low_52w": F.col("close") <= F.col("low_n"), "volume": F.col("volume_spike") >= spike}
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    return rows.select("sym", "d", F.explode(hits).alias("kind"))


def unmuted(alerts: DataFrame, mutes: DataFrame, now: str) -> DataFrame:
    """alerts (sym, kind, ...) that no active rule (scope, value, until) names by sym, kind or sym:kind.

    The OR of three matches is one equality join: an alert offers its three names, rules are met by name."""
    active = mutes.where(F.col("until").isNull() | (F.col("until") > F.lit(now).cast("timestamp"))).select("scope", "value").distinct()
    names = F.explode(F.array(F.struct(F.lit("ticker").alias("scope"), F.col("sym").alias("value")), F.struct(F.lit("type").alias("scope"), F.col("kind").alias("value")), F.struct(F.lit("pair").alias("scope"), F.concat_ws(":", "sym", "kind").alias("value"))))
    hit = alerts.select("sym", "kind").distinct().select("sym", "kind", names.alias("x")).select("sym", "kind", "x.*").join(active, ["scope", "value"], "left_semi")
    return alerts.join(hit.select("sym", "kind").distinct(), ["sym", "kind"], "left_anti")


# The levels alerts come with, and event types that are never or only with an asset worth one.
CRITICAL_EVENTS = ("sanctions", "geopolitics")
NOISE_EVENT = "noise"
NEED_IMPACT = ("geopolitics",)
CALENDAR_SEVERITY = {"cbr_rate_meeting": "warning", "dividend_cutoff": "info"}

def _alerts(rows: DataFrame, kind: str, key: Column, severity: Column, sym: Column, *payload: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("alert_type"), sym.alias("sym"), severity.alias("severity"), key.alias("dedup_key"), *payload)


def story_key(story: str = "story", article: str = "id") -> Column:
    """One key a story; an article without one is its own, below 0 so that keys do not meet."""
    return F.coalesce(F.col(story).cast("long"), -F.col(article).cast("long"))


def negative_scopes(links: DataFrame, min_count: int = 3, min_ratio: float = 0.5, min_significance: float = 0.35, *, bucket: str = "bucket") -> DataFrame:
    """Alerts (.., negative, total, ratio) of scopes and buckets whose stories are negative often enough.

    links (scope, sym, <bucket>, story_key, negative, significance): a row for each scope that an article counts for; sym
    is null but for assets. Articles of less or unknown significance do not count. Stories are merged before scopes are,
    so a scope that holds all articles is no task of its own."""
    d = links.where(F.col("significance") >= min_significance).groupBy("scope", bucket, "story_key")
    d = d.agg(F.max("sym").alias("sym"), F.max(F.coalesce("negative", F.lit(False))).alias("negative"))
    d = d.groupBy("scope", bucket).agg(F.max("sym").alias("sym"), F.count_if("negative").alias("negative"), F.count(F.lit(1)).alias("total"))
    d = d.where((F.col("negative") >= min_count) & (F.col("negative") / F.col("total") >= min_ratio)).withColumn("ratio", F.round(F.col("negative") / F.col("total"), 3))
    return _alerts(d, "neg_spike", F.concat_ws(":", F.lit("neg"), "scope", bucket), F.lit("warning"), F.col("sym"), bucket, "negative", "total", "ratio")


def new_events(events: DataFrame, impacts: DataFrame, need_impact: tuple[str, ...] = NEED_IMPACT, min_significance: float = 0.35) -> DataFrame:
    """Alerts (.., event_id, event_type, syms) of events (event_id, event_type, significance), with the assets of impacts
    (event_id, sym, magnitude), greatest first (of equals the lesser name).

    Noise and events of less or unknown significance give none, nor do types of need_impact without an asset. An event
    without a type is 'other'; an event given twice alerts once."""
    syms = impacts.groupBy("event_id", "sym").agg(F.max("magnitude").alias("m")).groupBy("event_id")
    syms = syms.agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "sym"))).alias("_x"))
    d = events.select("event_id", F.coalesce("event_type", F.lit("other")).alias("event_type"), "significance").where(F.col("event_id").isNotNull() & (F.col("significance") >= min_significance) & (F.col("event_type") != NOISE_EVENT))
    d = d.groupBy("event_id").agg(F.min("event_type").alias("event_type"))
    d = d.join(syms, "event_id", "left").withColumn("syms", F.coalesce(F.col("_x.sym"), F.array().cast("array<string>")))
    d = d.where((F.size("syms") > 0) | ~F.col("event_type").isin(*need_impact))
    severity = F.when(F.col("event_type").isin(*CRITICAL_EVENTS), "critical").otherwise("warning")
    return _alerts(d, "new_event", F.concat(F.lit("event:"), F.col("event_id").cast("string")), severity, F.get("syms", F.lit(0)), "event_id", "event_type", "syms")


def combos(moves: DataFrame, spikes: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Alerts (.., change_pct, negative, total) of assets that fell (moves: sym, <bucket>, change_pct, those that alert) and
    have a negative spike (rows of negative_scopes) in the same bucket."""
    neg = spikes.where("sym is not null").select("sym", bucket, "negative", "total")
    d = moves.where("change_pct < 0").select("sym", bucket, "change_pct").join(neg, ["sym", bucket])
    return _alerts(d, "combo", F.concat_ws(":", F.lit("combo"), "sym", bucket), F.lit("critical"), F.col("sym"), bucket, "change_pct", "negative", "total")


def calendar(items: DataFrame, today: str, days: int = 1) -> DataFrame:
    """Alerts (.., kind, event_date, days_left) of items (kind, sym, event_date) from today to `days` ahead; rows without
    a kind or date give none. A date is announced once, whatever the day it is seen."""
    left = F.datediff("event_date", F.lit(today).cast("date"))
    d = items.where(F.col("kind").isNotNull() & (F.col("kind") != "") & left.between(0, days)).select("kind", F.col("sym").alias("_s"), "event_date", left.alias("days_left"))
    severity = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CALENDAR_SEVERITY.items() for x in kv]), F.col("kind")), F.lit("info"))
    return _alerts(d, "calendar", F.concat_ws(":", F.lit("cal"), "kind", F.coalesce("_s", F.lit("MKT")), F.col("event_date").cast("string")), severity, F.col("_s"), "kind", "event_date", "days_left")


def portfolios(risk: DataFrame, positions: DataFrame, bucket: str, drawdown_pct: float = 10.0, loss_pct: float = 15.0) -> DataFrame:
    """Alerts (.., owner, kind, value): the largest fall of an owner's book (risk: owner, drawdown_pct) and the loss of a
    position (positions: owner, asset, pnl_pct) at the limits or beyond. Rows without an owner are everybody's."""
    key = lambda *x: F.concat_ws(":", F.lit("portfolio"), *x, F.concat(F.lit("u"), F.col("owner").cast("string")), F.lit(bucket))
    a = risk.where(F.col("drawdown_pct") >= drawdown_pct).select("owner", F.lit("drawdown").alias("kind"), F.col("drawdown_pct").alias("value"))
    b = positions.where(F.col("pnl_pct") <= -loss_pct).select("owner", "asset", F.lit("holding").alias("kind"), F.col("pnl_pct").alias("value"))
    a = _alerts(a, "portfolio", key(F.lit("drawdown")), F.lit("warning"), F.lit(None).cast("string"), "owner", "kind", "value")
    return a.unionByName(_alerts(b, "portfolio", key(F.lit("holding"), F.col("asset")), F.lit("warning"), F.col("asset"), "owner", "kind", "value"))


def crosses(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Alerts (.., d, kind) of bars (sym, d, close) where the fast mean has passed the slow one since the bar before."""
    w = by_symbol()
    c = F.col("close")
    d = bars.select("sym", "d", sma(c, fast).alias("f"), sma(c, slow).alias("s"))
    d = d.withColumns({"f1": F.lag("f").over(w), "s1": F.lag("s").over(w)})
    up, down = (F.col("f1") <= F.col("s1")) & (F.col("f") > F.col("s")), (F.col("f1") >= F.col("s1")) & (F.col("f") < F.col("s"))
    d = d.withColumn("kind", F.when(up, "golden_cross").when(down, "death_cross")).where("kind is not null")
    return _alerts(d, "technical", F.concat_ws(":", F.lit("tech"), "sym", "kind", F.col("d").cast("string")), F.lit("warning"), F.col("sym"), "d", "kind")


def fresh(alerts: DataFrame, stored: DataFrame) -> DataFrame:
    """alerts whose dedup_key is not in stored (dedup_key); of rows that share one, the first by severity (as text), then sym."""
    one = Window.partitionBy("dedup_key").orderBy("severity", F.col("sym").asc_nulls_last())
    d = alerts.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")
    return d.join(stored.select("dedup_key").distinct(), "dedup_key", "left_anti").select(*alerts.columns)
