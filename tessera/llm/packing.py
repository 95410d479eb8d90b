"""Best-fit packing of documents into bins of a fixed number of tokens, with conflicts.

No bin holds two documents of one source, nor two of one cluster of duplicates. A document longer than
a bin is cut: full pieces are bins of their own, the rest is packed. Items are dealt over shards of
about SHARD items by a hash of the row (so no source or cluster gathers in one), and each shard packs
its items, largest first, with open bins ordered by residual, each with a bitmap of its sources and one
of its clusters. The search starts at the smallest residual that holds the item and goes on to the next
ones until a bin has neither bit set; that is the tightest compatible bin. If there is none, a bin opens.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm.common import ascii_lower, cut

CAPACITY = 2048
SHARD = 20_000


def copy_cluster(text: Column) -> Column:
    """Equal for texts that differ in A-Z case and ASCII white space alone."""
    return F.md5(F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def pack_shard(sizes: list[int], sources: list[str | None], clusters: list[str | None], capacity: int) -> list[tuple[int, int]]:
    """(bin, tokens before it in the bin) of every item, items in the order given. A null source or cluster conflicts with nothing."""
    many = {c for c, n in Counter(clusters).items() if n > 1 and c is not None}
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c in many))}
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_map: list[int] = []
    cluster_map: list[int] = []
    held: list[list[str]] = []  # the sources of a bin
    having: Counter[str] = Counter()  # open bins that hold a source
    smallest = min(sizes, default=0)
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        found = None
        if not s or having[source] < len(open_bins):  # else every open bin holds the source
            for at in range(bisect_left(open_bins, (size, -1)), len(open_bins)):
                b = open_bins[at][1]
                if not (source_map[b] & s or cluster_map[b] & c):
                    found = at
                    break
        if found is None:
            residual, b = capacity, len(source_map)
            source_map.append(0)
            cluster_map.append(0)
            held.append([])
        else:
            residual, b = open_bins.pop(found)
            having.subtract(held[b])
        out.append((b, capacity - residual))
        source_map[b] |= s
        cluster_map[b] |= c
        if s:
            held[b].append(source)
        if residual - size >= max(1, smallest):
            insort(open_bins, (residual - size, b))
            having.update(held[b])
    return out


OUT = "row long, shard int, bin int, at int"


def _pack(capacity: int):
    """Of rows (shard, row, size, source, cluster) sorted by shard and size: where each is put."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        where = pack_shard([h[2] for h in held], [h[3] for h in held], [h[4] for h in held], capacity)
        cols = [[h[1] for h in held], [h[0] for h in held], [w[0] for w in where], [w[1] for w in where]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), *[pa.int32()] * 3], strict=True)], ["row", "shard", "bin", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][0] != x[0]:
                    yield flush(held)
                    held = []
                held.append(x)
        if held:
            yield flush(held)

    return run


def pack(docs: DataFrame, id: str, size: Column, source: Column, cluster: Column, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row a piece: id column, piece, token_start and n_tokens (its part of the document), bin_id and
    bin_start (tokens before it in the bin).

    Pieces of a document cover it without gap or overlap. A document without tokens has one piece of 0
    tokens and no bin (null). Rows that repeat an id are packed each for itself; null ids are packed too.
    An empty table gives an empty result.
    """
    session.ship(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = docs.select(F.col(f"`{id}`").alias("id"), size.cast("long").alias("size"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    items = cut(items.withColumn("row", F.monotonically_increasing_id()), "pack-items")  # written once: row numbers stay
    rest = F.pmod("size", F.lit(capacity)).cast("int")
    tails = items.where(rest > 0)
    shards = max(1, -(-tails.count() // shard))
    tails = tails.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", rest.alias("size"), "source", "cluster")
    tails = tails.repartition(max(n, shards) if shards > 1 else 1, "shard").sortWithinPartitions("shard", F.desc("size"), "row")
    put = cut(tails.mapInArrow(_pack(capacity), OUT), "pack-bins")
    # bin ids: shard and number for packed bins, the row and piece for full ones
    packed = items.join(put, "row").select("id", F.floor(F.col("size") / capacity).cast("int").alias("piece"), (F.col("size") - rest).alias("token_start"), rest.cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("p"), "shard", "bin").alias("bin_id"), F.col("at").cast("long").alias("bin_start"))
    full = items.where(F.col("size") >= capacity).select("id", "row", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / capacity).cast("int") - 1)).alias("piece"))
    full = full.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("token_start"), F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("f"), "row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("bin_start"))
    none = items.where(F.coalesce("size", F.lit(0)) <= 0).select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_start"))
    return packed.unionByName(full).unionByName(none).withColumnRenamed("id", id)
