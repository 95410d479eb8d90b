"""Near-duplicate vectors by binary codes of random rotations.

Code: a seeded random rotation turns the unit vector x into Px; its signs, scaled to length 1, are the
code b, and f = <b, Px> is stored as the correction factor. For any unit q, <b, Pq> / f estimates <q, x>
without bias. f is the cosine of the angle between Px and b, so no x within the threshold of q has an
estimate below cos(arccos f + arccos threshold) / f: pairs below that are dropped by their code, for
certain and not only with high probability, and all others are recomputed exactly.

Which pairs are looked at: equal vectors collapse first. The others lie in regions around pivots (see
regions), cut into blocks of a bounded number of bytes. Two blocks meet in one cell, a task's unit of work,
unless the angle of their pivots less both reaches is above the threshold: then none of their pairs can
link, for certain. A cell gives the links of each of its rows and a spanning forest of the links it found.
Nothing is left to chance and nothing passes through the driver. Where vectors cluster, work grows with
the clusters; where they have no structure at all no bound can part them, and it grows with the square of
the number of distinct vectors.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm.common import _forest, components, cut, drop_paths, whole_groups
from tessera.llm.regions import PIVOTS, SLACK, angles, deal, exact, matrix, pivots, stats, unit, usable

THRESHOLD = 0.9
EPS = 5.0
#: Bytes of the vectors of one block, and rows of either side of a tile inside a cell.
BLOCK_BYTES = 16 << 20
TILE = 2048
SEED = 20240501
#: Parts over which the rows of a vector that many share are dealt.
SALT = 16


@functools.cache
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix; the same for the same arguments on every machine."""
    g = np.random.Generator(np.random.PCG64([SEED, dim, number])).standard_normal((dim, dim))
    q, r = np.linalg.qr(g)
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as packed bits, correction factors) of the rows."""
    y = unit(x) @ rotation(x.shape[1], 0).T
    return np.packbits(y >= 0, axis=1), np.abs(y).sum(1) / math.sqrt(x.shape[1])


def estimate(q: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of the unit rows of q with the coded vectors, and half the width of their bounds."""
    dim = q.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    y = (unit(q) @ rotation(dim, 0).T).astype(np.float32)
    est = (y @ signs.T) / math.sqrt(dim) / factor[None, :]
    return est, EPS * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, dim - 1))


def least(factor: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """The smallest estimate that a coded vector within the threshold can show, less the rounding of estimates."""
    turn = np.arccos(np.minimum(1, factor)) + math.acos(threshold)
    return (np.cos(np.minimum(turn, math.pi)) - 1e-5 - 2e-7 * dim) / factor


def links(q: np.ndarray, x: np.ndarray, codes: np.ndarray, factor: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of rows of q and x with cosine >= threshold."""
    est, _ = estimate(q, codes, factor)
    i, j = np.nonzero(est >= least(factor, q.shape[1], threshold)[None, :].astype(np.float32))
    ok = exact(q, i, x, j) >= threshold
    return i[ok], j[ok]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, far, id, v, weight) with code and factor."""
    for b in batches:
        if b.num_rows:
            codes, factor = encode(matrix(b.column(3)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor)], CODED.replace(",", "").split()[0::2])


CODED = "region int, far double, id long, v array<double>, weight long, code binary, factor double"
MET = "a long, b long, links long"


def _cells(threshold: float):
    """Of (lo, hi, side, id, v, weight, code, factor) sorted by cell: (a, b, links): the links of a inside the cell, by
    weight (b null), and a forest of links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, 2):
            for lo, hi in zip(starts, [*starts[1:], t.num_rows], strict=True):
                own = t.slice(int(lo), int(hi - lo)).combine_chunks()
                col = lambda c: own.column(c).chunk(0)  # noqa: B023, E731
                side, ids, weight, factor = (col(c).to_numpy() for c in (2, 3, 5, 7))
                x = matrix(col(4))
                codes = np.frombuffer(b"".join(col(6).to_pylist()), np.uint8).reshape(len(ids), -1)
                alone = own.column(0)[0] == own.column(1)[0]
                here, there = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
                total, found = np.zeros(len(ids), np.int64), [np.empty((0, 2), np.int64)]
                for p in range(0, len(here), TILE):
                    i0 = here[p : p + TILE]
                    for q in range(p if alone else 0, len(there), TILE):
                        j0 = there[q : q + TILE]
                        i, j = links(x[i0], x[j0], codes[j0], factor[j0], threshold)
                        i, j = i0[i], j0[j]
                        if alone and p == q:
                            once = i < j
                            i, j = i[once], j[once]
                        np.add.at(total, i, weight[j])
                        np.add.at(total, j, weight[i])
                        if len(i):
                            found.append(np.stack([ids[i], ids[j]], 1))
                            if sum(map(len, found)) > 1_000_000:
                                found = [_thinned(found)]
                some, edges = np.flatnonzero(total), _thinned(found)
                cols = np.r_[ids[some], edges[:, 0]], np.r_[np.zeros(len(some), np.int64), edges[:, 1]], np.r_[total[some], np.zeros(len(edges), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], mask=np.arange(len(cols[0])) < len(some)), pa.array(cols[2])], ["a", "b", "links"])

    return run


def _thinned(edges: list[np.ndarray]) -> np.ndarray:
    """Fewer edges of the same components: each vertex to the smallest one of its component."""
    e = np.concatenate(edges)
    for out in _forest([pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])]):
        ids, at = out.column(0).to_numpy(), out.column(1).to_numpy()
        return np.stack([ids, at], 1)[ids != at]
    return e


def _met(own: DataFrame, n: int, dim: int, threshold: float, block_bytes: int, paths: list[str]) -> DataFrame:
    """MET for the distinct vectors own (id, v, weight)."""
    spark = own.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(256, block_bytes // (8 * dim))
    p = pivots(own, min(PIVOTS, -(-n // size)))
    data = cut(deal(own, p).mapInArrow(_encode, CODED), "rq-data", paths)
    count, reach = stats(data, len(p))
    cuts = -(-count // size)
    first = np.cumsum(cuts) - cuts
    # which regions can hold links of a region: one row a pair of pivots, at most PIVOTS squared of them
    near = angles(p, p) - reach[:, None] - reach[None, :] <= math.acos(threshold) + SLACK
    i, j = np.nonzero(near & (cuts > 0)[:, None] & (cuts > 0)[None, :])
    table = pa.table({"region": i.astype(np.int32), "own": cuts[i], "first": first[i], "to": first[j], "many": cuts[j]})
    meets = F.broadcast(spark.createDataFrame(table))
    rows = data.join(meets, "region").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("own")))
    rows = rows.withColumn("other", F.explode(F.sequence("to", F.col("to") + F.col("many") - 1)))
    rows = rows.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "v", "weight", "code", "factor")
    cells = int(cuts.sum()) ** 2 // 2 + 1
    rows = rows.repartition(min(20_000, max(parts, cells)), "lo", "hi").sortWithinPartitions("lo", "hi")
    return cut(rows.mapInArrow(_cells(threshold), MET), "rq-links", paths)


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of vectors: id column, n_links (other vectors linked directly), component_id
    (smallest id reachable), kept (id = component_id).

    Vectors that are null, zero, or hold null or non-finite components, and null ids, link with nothing
    (component: their own id). All vectors must have one length. Rows that repeat an id share a vertex:
    their links are added up. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    session.ship(spark)
    paths: list[str] = []
    rows = usable(vectors, id, vector).withColumn("given", F.col("id"))
    # vectors that share an id go by a hash of id and vector until the end
    again = cut(rows.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id", F.lit(True).alias("again")), "rq-again", paths)
    repeated = not again.isEmpty()
    if repeated:
        rows = rows.join(again, "id", "left").withColumn("id", F.when(F.col("again"), -1 - F.shiftrightunsigned(F.xxhash64("id", "v"), 1)).otherwise(F.col("id"))).drop("again")
    rows = cut(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "rq-vectors", paths)
    # equal vectors: sums ahead of the shuffle; rows are joined to groups of several rows alone, salted
    same = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")), "rq-same", paths)
    salted = same.where("weight > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(salted, ["h1", "h2", "salt"], "left")
    rows = cut(rows.select("given", "id", "v", F.coalesce("rep", "id").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight")), "rq-rows", paths)
    own = cut(rows.where("id = rep").dropDuplicates(["id"]).select("id", "v", "weight"), "rq-reps", paths)
    size = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    met = _met(own, size.n, size.dim, threshold, block_bytes, paths) if size.n else spark.createDataFrame([], MET)
    label = components(met.where("b is not null"))
    count = cut(met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links")), "rq-counts", paths)
    # what links with others or holds several rows; all else keeps its own id and no links
    about = count.join(label.withColumnRenamed("id", "rep"), "rep", "full").join(same.where("weight > 1").select("rep", "weight"), "rep", "full")
    about = about.select("rep", (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    about = cut(about, "rq-about", paths).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    per = rows.select(F.col("given").alias("id"), "rep", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt")).join(about, ["rep", "salt"], "left")
    per = per.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    if repeated:  # an id that several vectors share joins their components
        label = components(per.select(F.col("id").alias("a"), (-1 - F.abs(F.xxhash64("component_id"))).alias("b")))
        per = per.drop("component_id").join(label, "id", "left")
        least = per.groupBy("component_id").agg(F.min("id").alias("least"))
        per = per.join(least, "component_id").select("id", "n_links", F.col("least").alias("component_id"))
    again = cut(per.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "rq-ids")
    drop_paths(spark, paths)
    out = vectors.select(F.col(f"`{id}`").cast("long").alias(id)).withColumn("k", F.col(id))
    out = out.join(again.select(F.col("id").alias("k"), "n_links", "component_id"), "k", "left")
    comp = F.coalesce("component_id", F.col(id))
    return out.select(F.col(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col(id) == comp).alias("kept"))
