"""Regions of the unit sphere around pivots, with bounds that hold for certain.

Every vector belongs to the pivot it is nearest to by angle; a region's reach is the largest angle of its
vectors to the pivot. Angles obey the triangle inequality, so nothing of a region is nearer to q than
angle(q, pivot) - reach, and no two vectors of two regions are nearer than the angle of their pivots less
both reaches. Pivots are chosen, far from one another, from a bounded sample (the smallest keyed hashes of
the ids); they decide where vectors are kept, not whether they are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many pivots, chosen among at most SAMPLE vectors.
PIVOTS, SAMPLE = 512, 4096
#: Rounding of angles; never prunes what exact arithmetic would keep.
SLACK = 1e-6


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): rows that take part: an id, and a vector that is not null, empty or zero and has only finite components."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return df.select(F.col(f"`{id}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) for x in column]) if len(column) else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def angles(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Angles of the unit rows of u and p."""
    return np.arccos(np.clip(u @ p.T, -1, 1))


def exact(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of rows in double precision, summed from the first component on."""
    out = np.empty(len(i))
    for at in range(0, len(i), 200_000):
        p, q = x[i[at : at + 200_000]], y[j[at : at + 200_000]]
        dot, a, b = (np.zeros(len(p)) for _ in range(3))
        for c in range(x.shape[1]):
            dot += p[:, c] * q[:, c]
            a += p[:, c] * p[:, c]
            b += q[:, c] * q[:, c]
        out[at : at + 200_000] = dot / (np.sqrt(a) * np.sqrt(b))
    return out


def pivots(rows: DataFrame, count: int) -> np.ndarray:
    """At most count unit vectors of rows (id, v), each the farthest of the sample from those before it."""
    count = max(1, min(count, PIVOTS))
    few = rows.orderBy(F.xxhash64("id", F.lit(29)), "id").limit(1 if count == 1 else min(SAMPLE, 8 * count)).select("v").toArrow()
    u = unit(matrix(few.column("v").combine_chunks()))
    chosen = [0]
    nearest = angles(u, u[:1])[:, 0]
    while len(chosen) < count and nearest.max() > SLACK:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, angles(u, u[chosen[-1:]])[:, 0])
    return u[chosen]


def deal(rows: DataFrame, p: np.ndarray) -> DataFrame:
    """Rows (id, v, ...) with region and far, the angle to its pivot, in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = angles(unit(matrix(b.column(1))), p)
                near = a.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(a[np.arange(len(a)), near]), *b.columns], ["region", "far", *b.schema.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"region int, far double, {fields}")


def stats(dealt: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, reach) of every region: one row a pivot reaches the driver. An empty region has reach -inf."""
    n, reach = np.zeros(count, np.int64), np.full(count, -np.inf)
    for r in dealt.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        n[r.region], reach[r.region] = r.n, r.far
    return n, reach
