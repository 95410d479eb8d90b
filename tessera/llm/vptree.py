"""Nearest neighbours by cosine: one vantage-point tree a shard, searched for blocks of queries.

Vectors are scaled to length 1, where the smallest Euclidean distance is the largest cosine. A node
holds a vantage point and the median distance of its vectors to it; the triangle inequality bounds the
distance of a query to anything on the other side of the median by |d - median|. A side is skipped when
factor * |d - median| exceeds the distance of the k-th best so far: factor 1 is exact, larger ones skip
more. All queries of a block go down a tree together, those on the same side of a median in one step.

Shards are parts, of about SHARD vectors, of regions around pivots (see regions). A query first meets the
shards of its own region; the distance of its k-th best there is its radius. It then goes to those other
regions alone whose bound, times factor, is within the radius, and takes the radius along. Trees stay where
they are: queries are dealt to them, a shard with very many queries over several copies of its tree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.llm.common import cut, drop_paths
from tessera.llm.regions import SLACK, angles, deal, exact, matrix, pivots, stats, unit, usable

SHARD = 8192
LEAF = 128
MAX_DEPTH = 48
BLOCK = 1024
#: Queries that meet one copy of a tree in one task.
QUERIES = 8192


@dataclass
class Tree:
    """Nodes in arrays; a leaf has point -1 and the rows first:last."""

    ids: np.ndarray
    x: np.ndarray
    point: np.ndarray
    median: np.ndarray
    first: np.ndarray
    last: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        u = unit(x)
        at = np.arange(len(ids))
        point, median, first, last, inner, outer = [], [], [], [], [], []

        def node(a: int, z: int, depth: int = 0) -> int:
            me = len(point)
            for column, v in ((point, -1), (median, 0.0), (first, a), (last, z), (inner, -1), (outer, -1)):
                column.append(v)
            if z - a <= leaf or depth == MAX_DEPTH:  # many equal distances can part badly
                return me
            rows = at[a:z]
            # a point far from the middle parts best; the choice follows from the rows alone
            p = rows[np.argmax(((u[rows] - u[rows].mean(0)) ** 2).sum(1))]
            d = np.sqrt(np.maximum(0, 2 - 2 * (u[rows] @ u[p])))
            m = float(np.median(d))
            near = d <= m
            if near.all():  # ties: nothing to part
                return me
            at[a:z] = np.concatenate([rows[near], rows[~near]])
            mid = a + int(near.sum())
            point[me], median[me] = int(p), m
            inner[me] = node(a, mid, depth + 1)
            outer[me] = node(mid, z, depth + 1)
            return me

        node(0, len(ids))
        vantage = np.array(point)
        put = np.empty_like(at)
        put[at] = np.arange(len(at))
        vantage[vantage >= 0] = put[vantage[vantage >= 0]]
        return Tree(ids[at], x[at], vantage, np.array(median), np.array(first), np.array(last), np.array(inner), np.array(outer))

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k nearest rows of other ids, nearest first, ties to the smaller id; -inf where there are
        fewer. Rows count one by one: an id that several rows share can come several times. within, if given, is a
        cosine for each query below which nothing is wanted: what is below may be left out."""
        none = np.iinfo(np.int64).max
        scores, found = np.full((len(q), k), -np.inf), np.full((len(q), k), none)
        u, unit_x = unit(q), unit(self.x)
        floor = np.full(len(q), -np.inf) if within is None else within

        def worst(rows: np.ndarray) -> np.ndarray:
            """Cosine below which nothing changes the k best."""
            return np.maximum(scores[rows, -1], floor[rows])

        def reach(rows: np.ndarray) -> np.ndarray:
            s = worst(rows)
            return np.where(np.isinf(s), np.inf, np.sqrt(np.maximum(0, 2 - 2 * s)) + SLACK)

        def look(n: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if self.point[n] < 0:
                for at in range(self.first[n], self.last[n], 4 * LEAF):
                    own = slice(at, min(self.last[n], at + 4 * LEAF))
                    s = u[rows] @ unit_x[own].T
                    s[qids[rows][:, None] == self.ids[own][None, :]] = -np.inf
                    # exact cosines for those alone that can be among the k best
                    least = worst(rows)
                    if s.shape[1] > k:
                        least = np.maximum(least, np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k])
                    r, c = np.nonzero((s >= least[:, None] - SLACK * SLACK) & (s > -2))
                    if not len(r):
                        continue
                    hit = np.unique(r)
                    score = exact(q, rows[r], self.x, c + at)
                    # all that ties with the k-th stays in play, then ids decide
                    mine = rows[hit]
                    all_r = np.r_[np.repeat(mine, k), rows[r]]
                    all_s = np.r_[scores[mine].ravel(), score]
                    all_i = np.r_[found[mine].ravel(), self.ids[c + at]]
                    order = np.lexsort((all_i, -all_s, all_r))
                    all_r, all_s, all_i = all_r[order], all_s[order], all_i[order]
                    start = np.flatnonzero(np.r_[True, all_r[1:] != all_r[:-1]])
                    top = start[:, None] + np.arange(k)
                    scores[all_r[start]], found[all_r[start]] = all_s[top], all_i[top]
                return
            d = np.sqrt(np.maximum(0, 2 - 2 * (u[rows] @ unit_x[self.point[n]])))
            gap = factor * np.abs(d - self.median[n])
            near = d <= self.median[n]
            look(self.inner[n], rows[near])
            look(self.outer[n], rows[~near])
            look(self.outer[n], rows[near & (gap <= reach(rows))])
            look(self.inner[n], rows[~near & (gap <= reach(rows))])

        look(0, np.arange(len(q)))
        return scores, found


INDEX = "shard long, tree binary"
FOUND = "query_id long, query_row long, vec_id long, score double"
#: A shard number is the region times this, and the part of the region.
PARTS = 1 << 32


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, tree) of rows (shard, id, v) sorted by shard."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        tree = Tree.build(np.array([i for _, i, _ in held], np.int64), np.stack([v for _, _, v in held]))
        return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary())], ["shard", "tree"])

    for b in batches:
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), matrix(b.column(2)), strict=True):
            if held and held[0][0] != row[0]:
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


def _meet(k: int, factor: float):
    """Of rows (shard, salt, tree, id, row, v, within) sorted by shard and salt, the tree ahead of its queries: what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own, held = None, None, []

        def flush() -> pa.RecordBatch:
            ids, row, v, least = (np.array(c) for c in zip(*held, strict=True))
            held.clear()
            scores, found = tree.search(ids.astype(np.int64), v.astype(np.float64), k, factor, least.astype(np.float64))
            keep = ~np.isinf(scores)
            each = lambda x: pa.array(np.broadcast_to(x[:, None], scores.shape)[keep].astype(np.int64))
            return pa.RecordBatch.from_arrays([each(ids), each(row), pa.array(found[keep]), pa.array(scores[keep])], ["query_id", "query_row", "vec_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                key = (b.column(0)[r].as_py(), b.column(1)[r].as_py())
                if b.column(2)[r].is_valid:
                    if held:
                        yield flush()
                    tree, own = pickle.loads(b.column(2)[r].as_py()), key
                elif key == own:
                    held.append((b.column(3)[r].as_py(), b.column(4)[r].as_py(), matrix(b.column(5).slice(r, 1))[0], b.column(6)[r].as_py()))
                    if len(held) == BLOCK:
                        yield flush()
        if held:
            yield flush()

    return run


def _visit(index: DataFrame, asked: DataFrame, k: int, factor: float, shards: int) -> DataFrame:
    """FOUND for asked (shard, id, row, v, within)."""
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("copies"))
    salt = F.pmod(F.xxhash64("id", "row"), F.col("copies").cast("long")).cast("int")
    queries = asked.join(copies, "shard").select("shard", salt.alias("salt"), F.lit(None).cast("binary").alias("tree"), "id", "row", "v", "within")
    trees = index.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "tree", *[F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("row", "long"), ("v", "array<double>"), ("within", "double"))])
    rows = trees.unionByName(queries).repartition(min(4096, max(n, shards)), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("tree").isNull())
    return rows.mapInArrow(_meet(k, factor), FOUND)


def _best(found: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", factor: float = 1.0, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query; rows of the query's own id are left out.

    Vectors that are null, zero, or hold null or non-finite components take no part on either side; nor do
    null ids. All vectors must have one length. Fewer than k candidates: all of them. Ties go to the
    smaller id. Candidates are rows: an id that several rows share can come several times. Query rows that
    share an id are one query whose answer is the k best of all their answers. score is the cosine of the
    original vectors in double precision. An empty table on either side gives an empty result.

    Of rows with the very same vector those of the k + 1 smallest ids are indexed, k rows an id at most: the
    others are behind them for every query.
    """
    spark = vectors.sparkSession
    session.ship(spark)
    paths: list[str] = []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = usable(vectors, id, vector).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # rank filters go ahead of the shuffle, so a vector that very many rows share sends k + 1 rows a task
    same = Window.partitionBy("h1", "h2").orderBy("id")
    rows = given.withColumn("d", F.dense_rank().over(same)).where(F.col("d") <= k + 1)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("d"))).where(F.col("n") <= k).select("id", "v")
    rows = cut(rows, "vp-vectors", paths)
    n = rows.count()
    asked = cut(usable(queries, id, vector).withColumn("row", F.monotonically_increasing_id()), "vp-queries", paths)
    if n == 0 or asked.isEmpty():
        drop_paths(spark, paths)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    p = pivots(rows, -(-n // shard))
    dealt = cut(deal(rows, p), "vp-regions", paths)
    count, far = stats(dealt, len(p))
    cuts = np.maximum(1, -(-count // shard)).tolist()
    sizes = F.element_at(F.array(*[F.lit(int(c)) for c in cuts]), F.col("region") + 1) if len(cuts) > 1 else F.lit(cuts[0])
    number = F.col("region").cast("long") * PARTS + F.pmod(F.xxhash64("id"), sizes.cast("long"))
    shards = sum(cuts)
    index = dealt.select(number.alias("shard"), "id", "v").repartition(max(parts, min(4096, shards)), "shard").sortWithinPartitions("shard")
    index = cut(index.mapInArrow(_build, INDEX), "vp-index", paths)

    def route(home: bool):
        """Of (id, row, v, within): the shards each query has to meet, at home or elsewhere."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                least = b.column(3).to_numpy()
                a = angles(unit(matrix(b.column(2))), p)
                near = a.argmin(1)
                own = np.arange(len(p))[None, :] == near[:, None]
                # the second bound: what a region holds is nearer to its pivot than to the query's
                bound = np.maximum(a - far[None, :], (a - a.min(1)[:, None]) / 2)
                radius = np.where(np.isinf(least), np.pi, np.arccos(np.clip(least, -1, 1)))
                go = (own if home else ~own & (factor * bound <= radius[:, None] + SLACK)) & (count > 0)[None, :]
                r, g = np.nonzero(go)
                many = np.array(cuts)[g]
                r, g = np.repeat(r, many), np.repeat(g, many)
                part = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
                for at in range(0, len(r), 20_000):
                    take = slice(at, at + 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array(g[take].astype(np.int64) * PARTS + part[take]), *[c.take(pa.array(r[take])) for c in b.columns]], ["shard", *b.schema.names])

        return run

    routed = "shard long, id long, row long, v array<double>, within double"
    first = asked.select("id", "row", "v", F.lit(float("-inf")).alias("within"))
    at_home = cut(_visit(index, first.mapInArrow(route(True), routed), k, factor, shards), "vp-home", paths)
    best = _best(at_home, k, "query_row")
    kth = best.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    then = asked.join(kth.withColumnRenamed("query_row", "row"), "row", "left").select("id", "row", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("within"))
    away = _visit(index, then.mapInArrow(route(False), routed), k, factor, shards)
    out = cut(_best(at_home.unionByName(away), k, "query_id").select("query_id", "rank", "vec_id", "score"), "vp-found")
    drop_paths(spark, paths)
    return out
