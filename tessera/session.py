"""Session defaults shared by tests, bench and interactive use."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(app: str = "tessera", cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session; on a cluster, pass the master and sizes by spark-submit instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context: they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='tessera-ship-')}/tessera_pkg.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._tessera_shipped = True
