"""Shared helpers: places for intermediate tables, text rules, edges to components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, one is made for a local session
    (tests); a cluster must name one, as executors do not see the driver's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tessera-ckpt-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and a lost
    executor costs nothing that was written. paths, if given, collects the place for drop_paths()."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most so many rows for what runs inside: whole texts can be long, and a batch is
    held on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def whole_groups(batches, keys: int):
    """Tables of whole groups of rows that stand together (equal first columns), with the group starts."""
    import numpy as np
    import pyarrow as pa

    held = None

    def cuts(t):
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for c in range(keys):
            v = t.column(c).to_numpy()
            new |= v[1:] != v[:-1]
        return np.flatnonzero(np.r_[True, new])

    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            at = cuts(held)
            if len(at) > 1:
                yield held.slice(0, int(at[-1])).combine_chunks(), at[:-1]
                held = held.slice(int(at[-1]))
    if held is not None and held.num_rows:
        yield held, cuts(held)


#: Edges that one task finishes in memory (16 bytes each); more are contracted over the cluster first.
LOCAL_EDGES = 500_000


def _forest(batches):
    """(id, at) of every vertex of the edges (u, v): at the smallest id of its component."""
    import numpy as np
    import pyarrow as pa

    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
    if not parts:
        return
    ids, e = np.unique(np.concatenate(parts), return_inverse=True)
    e = e.reshape(-1, 2)
    at = np.arange(len(ids))
    while True:  # hook roots to smaller roots, then shorten all paths
        a, b = at[e[:, 0]], at[e[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(at, np.maximum(a, b), np.minimum(a, b))
        while (at[at] != at).any():
            at = at[at]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[at])], ["id", "at"])


def components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of an undirected edge table: (id, component_id), component_id the
    smallest id reachable; ids without edges do not appear.

    Randomised contraction: while more than local_edges edges are left, every vertex hooks to the
    neighbour (itself included) of smallest keyed hash, edges move to the hooks, loops and repeats go.
    The number of vertices shrinks by a constant factor a round whatever the graph, long paths
    included; every round is cut into the shared folder and nothing is collected. What is left, a
    bounded number of edges, is finished by one task. Null ends are ignored; an empty table gives an
    empty result.
    """
    spark = edges.sparkSession
    paths: list[str] = []
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = cut(e.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges", paths)
    hops: list[DataFrame] = []
    while e.count() > local_edges:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c, r=len(hops): F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("id"))
        hook = both.groupBy("u").agg(F.min(rank("v")).alias("n")).select(F.col("u").alias("id"), F.least(F.col("n"), rank("u"))["id"].alias("to"))
        hook = cut(hook, "cc-hook", paths)
        hops.append(hook)
        left = e.join(hook.select(F.col("id").alias("u"), F.col("to").alias("tu")), "u")
        left = left.join(hook.select(F.col("id").alias("v"), F.col("to").alias("tv")), "v").where("tu != tv")
        e = cut(left.select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct(), "cc-edges", paths)
    last = cut(e.coalesce(1).mapInArrow(_forest, "id long, at long"), "cc-last", paths)
    if not hops:
        out = cut(last.select("id", F.col("at").alias("component_id")), "cc")
    else:
        at = hops[0].withColumnRenamed("to", "at")
        for hop in [*hops[1:], last.withColumnRenamed("at", "to")]:
            at = at.join(hop.select(F.col("id").alias("at"), "to"), "at", "left").select("id", F.coalesce("to", "at").alias("at"))
        at = cut(at, "cc-at", paths)
        least = at.groupBy("at").agg(F.min("id").alias("component_id"))
        out = cut(at.join(least, "at").select("id", "component_id"), "cc")
    drop_paths(spark, paths)
    return out
