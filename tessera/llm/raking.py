"""Mixing to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted once into cells (one for each combination of the margins' values). The token
weight of the cells is raked: sweep by sweep and margin by margin, weights are multiplied until each
margin's shares meet their targets. A document of a cell with factor w is kept with probability
p = min(1, c * w), c chosen so that the expected tokens are the wanted fraction of all; its weight
w / p makes the sample's weighted margins unbiased, also where p is capped. Cells are collected up
to MAX_LOCAL_CELLS (a checked bound); with more, the same sweeps run on the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_paths

MAX_LOCAL_CELLS = 100_000
SWEEPS = 30
#: A cell table of at most this many rows is broadcast to the documents.
BROADCAST_CELLS = 100_000
#: Stands for null in a margin.
NULL = "\u0000null"

WORD = r"[^\x20\x09-\x0D]+"
#: A margin's target: shares by value (others keep their own share, all is scaled to 1), or a power of the own shares.
Target = Mapping[str, float] | float


def tokens(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from what a text holds; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains("License") | t.contains("Copyright") | t.contains("rights reserved"), "legal")
        .when(t.contains("!!") | t.contains("***") | t.contains("%%%"), "noise")
        .when(t.contains(" | "), "table")
        .when(t.contains("@"), "contact")
        .when(F.length(t) < 600, "note")
        .otherwise("prose")
    )


def uniform(id: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a keyed hash of the id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def shares(own: Mapping[str, float], target: Target) -> dict[str, float]:
    total = sum(own.values())
    if isinstance(target, Mapping):
        want = {v: float(target.get(v, t / total)) for v, t in own.items()}
    else:
        want = {v: (t / total) ** float(target) for v, t in own.items()}
    scale = sum(want.values())
    return {v: x / scale if scale else 0.0 for v, x in want.items()}


def _calibrate(w: np.ndarray, t: np.ndarray, fraction: float) -> float:
    """c with sum(min(1, c w) t) = fraction * sum(t)."""
    order = np.argsort(-w, kind="stable")
    w, t = w[order], t[order]
    full = np.r_[0.0, np.cumsum(t)]
    rest = np.r_[np.cumsum((w * t)[::-1])[::-1], 0.0]
    goal = fraction * full[-1]
    for k in range(len(w)):
        c = (goal - full[k]) / rest[k] if rest[k] > 0 else 0.0
        if c * w[k] <= 1:
            return max(c, 0.0)
    return 1 / w[-1] if len(w) and w[-1] > 0 else 0.0


def _local(cells: DataFrame, margins: Mapping[str, Target], fraction: float, sweeps: int) -> DataFrame:
    spark, dims = cells.sparkSession, list(margins)
    rows = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in dims))
    t = np.array([float(r.t) for r in rows])
    w = np.ones(len(rows))
    at, want = {}, {}
    for d in dims:
        values = sorted({r[d] for r in rows})
        where = {v: i for i, v in enumerate(values)}
        at[d] = np.array([where[r[d]] for r in rows], int)
        own = np.bincount(at[d], t, len(values))
        s = shares(dict(zip(values, own, strict=True)), margins[d])
        want[d] = np.array([s[v] for v in values]) * t.sum()
    for _ in range(sweeps):
        for d in dims:
            now = np.bincount(at[d], w * t, len(want[d]))
            w = w * np.divide(want[d], now, out=np.zeros_like(now), where=now > 0)[at[d]]
    c = _calibrate(w, t, fraction)
    out = [(*[r[d] for d in dims], float(x), float(min(1.0, c * x))) for r, x in zip(rows, w, strict=True)]
    return spark.createDataFrame(out, ", ".join(f"`{d}` string" for d in dims) + ", w double, p double")


def _spread(cells: DataFrame, margins: Mapping[str, Target], fraction: float, sweeps: int) -> DataFrame:
    """The same on the cluster: each step is one aggregation by a margin and a join of its factors."""
    paths: list[str] = []
    dims = list(margins)
    total = float(cells.agg(F.sum("t")).first()[0])
    want = {}
    for d in dims:
        own, target = cells.groupBy(d).agg(F.sum("t").cast("double").alias("own")), margins[d]
        if isinstance(target, Mapping):
            given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in target.items()], f"`{d}` string, given double")
            own = own.join(given, d, "left").withColumn("s", F.coalesce("given", F.col("own") / total))
        else:
            own = own.withColumn("s", F.pow(F.col("own") / total, F.lit(float(target))))
        scale = own.agg(F.sum("s")).first()[0]
        want[d] = cut(own.select(d, (F.col("s") / (scale or 1.0) * total).alias("want")), "rake-want", paths)
    rows = cells.withColumn("w", F.lit(1.0))
    for _ in range(sweeps):
        for d in dims:
            f = rows.groupBy(d).agg(F.sum(F.col("w") * F.col("t")).alias("now")).join(want[d], d)
            rows = rows.join(f.select(d, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(0.0).alias("f")), d).withColumn("w", F.col("w") * F.col("f")).drop("f")
        rows = cut(rows, "rake-sweep", paths)
    # c by section: 64 places a pass over the cells
    top = rows.agg(F.min(F.when(F.col("w") > 0, F.col("w")))).first()[0] or 1.0
    lo, hi = 0.0, 1 / top
    for _ in range(10):
        grid = [lo + (hi - lo) * i / 64 for i in range(65)]
        got = rows.agg(*[F.sum(F.least(F.lit(1.0), F.lit(c) * F.col("w")) * F.col("t")).alias(f"g{i}") for i, c in enumerate(grid)]).first()
        i = next((i for i in range(1, 65) if got[i] >= fraction * total), 64)
        lo, hi = grid[i - 1], grid[i]
    out = cut(rows.select(*dims, "w", F.least(F.lit(1.0), F.lit(hi) * F.col("w")).alias("p")), "rake-cells")
    drop_paths(cells.sparkSession, paths)
    return out


def rake(docs: DataFrame, margins: Mapping[str, tuple[Column, Target]], size: Column, id: Column, fraction: float = 1.0, seed: int = 7, sweeps: int = SWEEPS, max_local_cells: int = MAX_LOCAL_CELLS) -> DataFrame:
    """docs with columns rake_factor, rake_p, rake_weight and rake_kept.

    margins: name -> (column, target). Rows whose margin is null form a value of their own; a value
    whose target is 0 is never kept. size is the token weight of a row; rows of size 0 take their cell's
    probability, and a cell without any tokens has factor 1. Rows that repeat an id are kept or left
    together. An empty table gives an empty result. Columns of docs with these names are replaced.
    """
    dims = {d: f"__m{i}" for i, d in enumerate(margins)}
    new = ("rake_factor", "rake_p", "rake_weight", "rake_kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    rows = docs.select(row.alias("row"), uniform(id, seed).alias("u"), size.alias("t"), *[F.coalesce(c.cast("string"), F.lit(NULL)).alias(dims[d]) for d, (c, _) in margins.items()])
    paths: list[str] = []
    cells = cut(rows.groupBy(*dims.values()).agg(F.sum("t").alias("t")).where("t > 0"), "rake-count", paths)
    n = cells.count()
    targets = {dims[d]: t for d, (_, t) in margins.items()}
    if n:
        fitted = (_local if n <= max_local_cells else _spread)(cells, targets, fraction, sweeps)
        if n <= BROADCAST_CELLS:
            fitted = F.broadcast(fitted)
        rows = rows.join(fitted, list(dims.values()), "left")
    else:
        rows = rows.withColumns({"w": F.lit(None).cast("double"), "p": F.lit(None).cast("double")})
    w, p = F.coalesce("w", F.lit(1.0)), F.coalesce("p", F.lit(float(min(1.0, fraction))))
    return rows.select("row.*", w.alias("rake_factor"), p.alias("rake_p"), F.when(p > 0, w / p).alias("rake_weight"), (F.col("u") < p).alias("rake_kept"))
