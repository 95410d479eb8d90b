"""Cross-section scores of fundamentals (asset_id, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zscores(values: DataFrame, limit: float = 3.0) -> DataFrame:
    """values with z by metric: population deviation, cut at the limit; 0 without spread.

    The metric's mean and deviation are one row a metric, aggregated first and joined back, so a metric
    that all assets have is not gathered in one task."""
    s = values.groupBy("metric").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = (F.col("value") - F.col("m")) / F.nullif("s", F.lit(0.0))
    return values.join(F.broadcast(s), "metric").withColumn("z", F.when(z.isNull(), 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))).drop("m", "s")


def percentiles(values: DataFrame) -> DataFrame:
    """values with pct = 100 i / (n - 1) in ascending order, ties by asset; 50 where there is one."""
    w = Window.partitionBy("metric")
    i, n = F.row_number().over(w.orderBy("value", "asset_id")) - 1, F.count(F.lit(1)).over(w)
    return values.withColumn("pct", F.when(n == 1, 50.0).otherwise(100.0 * i / F.nullif(n - 1, F.lit(0))))


def composite(scored: DataFrame) -> DataFrame:
    return scored.groupBy("asset_id").agg(F.avg("z").alias("score"), F.count(F.lit(1)).alias("metrics"))


def fair_value(rows: DataFrame, min_peers: int = 3, clamp: float = 50.0) -> DataFrame:
    """rows (asset_id, sector, ratio) with upside percent: sector median over own ratio, less 1."""
    m = rows.where("ratio > 0").groupBy("sector").agg(F.median("ratio").alias("mid"), F.count(F.lit(1)).alias("peers"))
    up = (F.col("mid") / F.col("ratio") - 1) * 100
    return rows.join(m, "sector", "left").select("asset_id", "sector", F.when((F.col("peers") >= min_peers) & (F.col("ratio") > 0), F.greatest(F.lit(-clamp), F.least(F.lit(clamp), up))).alias("upside_pct"))


def stance(score: str = "score"):
    """Five words for a score in [-1, 1]."""
    s = F.col(score)
    return F.when(s >= 0.45, "strong_buy").when(s >= 0.15, "buy").when(s <= -0.45, "strong_sell").when(s <= -0.15, "sell").otherwise("hold")
