"""Day snapshots that replace themselves: a table partitioned by day whose days are rewritten whole, and never in part."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that spark.checkpoint.dir names; a folder of its own in a local session without one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tessera-shared-')}"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replace_days(rows: DataFrame, path: str, days: Iterable[date], day: str = "d") -> None:
    """The given days of the table at path become the rows of these days, whatever they were; a day without rows is emptied, other
    days stay. Rows of other days, and of none, are not written.

    Spark stages the new files and swaps partitions in when the job has ended: a job that fails leaves the table as it was, one that
    runs again gives the same table. Days that have no rows are removed after that, by name."""
    spark = rows.sparkSession
    wanted = sorted({f"{d:%Y-%m-%d}" for d in days})
    if not wanted:
        return
    mine = rows.where(F.col(day).cast("date").cast("string").isin(*wanted)).withColumn(day, F.col(day).cast("date"))
    # a day's rows go to a few tasks, so that a day is a few files
    mine.repartition(day, F.pmod(F.xxhash64(*[c for c in rows.columns if c != day]), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    # parts that this job did not write, of days that it was to write
    full = {r[0] for r in mine.select(F.col(day).cast("string")).distinct().collect()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for d in wanted:
        if d not in full:
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={d}")
            p.getFileSystem(conf).delete(p, True)


def read_days(spark: SparkSession, path: str, schema: str, since: date | None = None, until: date | None = None, day: str = "d") -> DataFrame:
    """The table, from one day to another (both included): the bounds prune partitions. A table that was never written is empty."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    d = spark.read.schema(schema).parquet(path)
    if since is not None:
        d = d.where(F.col(day) >= F.lit(since))
    return d if until is None else d.where(F.col(day) <= F.lit(until))


def record_sentiment(daily: DataFrame, path: str, days: Iterable[date], span: int = 14) -> None:
    """Write the daily sentiment (scope, key, d, mean, n) of the given days with its EWMA (alpha 2 / (span + 1)): each day's from the value that the table
    holds for the last day before it, or, without one, from the day's mean. Days are written in their order; each replaces itself."""
    spark, alpha = daily.sparkSession, 2.0 / (span + 1)
    schema = "scope string, key string, mean double, n long, ewma double, d date"
    for d in sorted(set(days)):
        held = read_days(spark, path, schema).where(F.col("d") < F.lit(d)).groupBy("scope", "key").agg(F.max_by("ewma", "d").alias("before"))
        rows = daily.where(F.col("d") == F.lit(d)).join(held, ["scope", "key"], "left")
        ewma = F.when(F.col("before").isNull(), F.col("mean")).otherwise(F.col("before") * (1 - alpha) + F.col("mean") * alpha)
        replace_days(rows.select("scope", "key", "mean", F.col("n").cast("long").alias("n"), ewma.alias("ewma"), "d"), path, [d])
