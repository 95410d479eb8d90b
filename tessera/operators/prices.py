"""Bars: resampling, newest rows per key, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resample(bars: DataFrame, period: str) -> DataFrame:
    """Bars of ISO weeks ('week') or months ('month'): first open, extremes, last close, summed volume
    (null only if all are), d the last date of the bucket."""
    out = bars.groupBy("sym", F.date_trunc(period, "d").cast("date").alias("bucket")).agg(
        F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume"), F.max("d").alias("d"),
    )
    return out.select("sym", "bucket", "d", "open", "high", "low", "close", "volume")


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by the given order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _bucket(df: DataFrame, at: str) -> Column:
    """The month of a time; of a number, its four thousand."""
    kind = df.schema[at].dataType.simpleString()
    return F.date_trunc("month", at) if kind.startswith(("date", "timestamp")) else F.floor(F.col(at) / 4096)


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, strict: bool = False, bucket: Column | None = None) -> DataFrame:
    """left with `value` of the newest right row of the key at or before (strict: before) left's time; null without one.

    Both sides meet in one window by key and bucket of time (a month, or what `bucket` says, which must rise
    with time): right rows carry their value forward. The newest value of each bucket, one row a bucket, is carried
    over to the buckets after it. So no pairs are made, and no task holds the whole history of a key. Right
    rows with a null key, time or value count for nothing; left rows with a null key or time get null.
    """
    name = f"asof_{value}"
    cols = left.columns
    side = F.lit(0 if strict else 1)
    a = left.select(*cols, F.lit(None).cast(right.schema[value].dataType).alias(name), side.alias("_side"), F.lit(True).alias("_left"))
    b = right.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    b = b.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(value).alias(name), F.lit(1 if strict else 0).alias("_side"), F.lit(False).alias("_left"))
    both = a.unionByName(b)
    both = both.withColumn("_bucket", _bucket(both, at) if bucket is None else bucket)
    last = both.groupBy(key, "_bucket").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col(at))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(key, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy(key, "_bucket").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(name, F.last(name, ignorenulls=True).over(w)).where("_left").join(last, [key, "_bucket"], "left")
    return found.select(*cols, F.coalesce(name, "_carried").alias(name))


def filled_days(series: DataFrame, until, max_age: int | None = None) -> DataFrame:
    """(name, day, at, value): the newest value of series (name, d, value) at or before every day up to `until` (a date), and
    its own day; with max_age not longer than so many days. Of values of one day the largest counts.

    A row a day and name: what is joined to it needs no window of its own, only the day."""
    d = series.where("name is not null and d is not null and value is not null").groupBy("name", "d").agg(F.max("value").alias("value"))
    end = F.coalesce(F.date_sub(F.lead("d").over(Window.partitionBy("name").orderBy("d")), 1), F.greatest(F.lit(until).cast("date"), F.col("d")))
    if max_age is not None:
        end = F.least(end, F.date_add("d", max_age))
    d = d.withColumn("_end", end)
    return d.select("name", F.explode(F.sequence("d", "_end")).alias("day"), F.col("d").alias("at"), "value")


def asof_features(left: DataFrame, series: DataFrame, names: list[str], at: str, strict: bool = True, max_age: int | None = None) -> DataFrame:
    """left with a column for each of the names: the newest value of that series (name, d, value) at or before the day of
    `at` (strict: before that day, as a day's figures are not known within it), null if older than max_age days.

    All series together are one table of a row a day, and one join by day serves them all."""
    until = left.agg(F.to_date(F.max(at)).alias("d")).first().d
    age = None if max_age is None else max_age
    days = filled_days(series.where(F.col("name").isin(*names)), until, age).groupBy("day").pivot("name", names).agg(F.first("value"))
    want = F.date_sub(F.to_date(at), 1) if strict else F.to_date(at)
    return left.withColumn("_day", want).join(days.withColumnRenamed("day", "_day"), "_day", "left").select(*left.columns, *[F.col(f"`{n}`") for n in names])
