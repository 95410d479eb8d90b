"""Benchmark decontamination by a positional inverted index over the training documents.

index() cuts the documents into segments of about SEGMENT bytes of text and stores, for each segment, one
row a distinct word with the positions of that word (counted through the segment's documents), and one row a
document with its range of positions. It is written once, as Parquet in the shared folder, and serves any
number of searches.

search() takes items in blocks of about BLOCK words. Every distinct window of a block (10 words; shorter items
are one window) is met with every segment that holds all of its words: the positions of the word that is
rarest in the whole index, less its place in the window, are where the window may begin; the lists of the
other words, less their places, are intersected with these from the rarest on. What is left is an exact
phrase. With slop, a word may stand up to so many places from where the phrase has it: a proximity match, which
spans the nearest such occurrence of each word (the earlier one of two).

Only posting lists of the block's words leave the index, and they are dealt by segment: a segment's lists are
bounded by its text, and a word that is everywhere is spread over all segments. Windows meet a segment as a
broadcast bounded by BLOCK, words as 64-bit hashes. A document is never split, so memory follows the longest text.

Words: A-Z in lower case, then `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. Nulls and texts without words: a document without
hits; an item without windows. A null item id marks words, but is not counted or listed. Rows that repeat a document id
are documents of their own; rows that repeat an item id are one item. Empty tables: no hits, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import words
from tessera.llm.common import cut, small_batches, whole_groups

WINDOW = 10
#: Bytes of text in a segment; words of items in a block; candidates that a task holds at a time.
SEGMENT, BLOCK, HELD = 4 << 20, 1 << 18, 1 << 20


def pack(places: np.ndarray, cuts: np.ndarray) -> pa.BinaryArray:
    """Lists of ascending positions, one behind the other and cut at cuts, as differences of four bytes; a list has
    all its lowest bytes first: those of higher order are mostly zero."""
    n, size = len(places), np.diff(cuts, append=len(places))
    steps = np.diff(places, prepend=0)
    steps[cuts] = places[cuts]
    steps = steps.astype("<i4").view(np.uint8).reshape(-1, 4)
    start, size = np.repeat(cuts, size), np.repeat(size, size)
    at = 3 * start + np.arange(n)
    out = np.empty(4 * n, np.uint8)
    for k in range(4):
        out[at + k * size] = steps[:, k]
    ends = np.r_[4 * cuts, 4 * n].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel(), dtype=np.int64)


def index(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SEGMENT) -> DataFrame:
    """(segment, term, ord, id, start, n, positions): rows of documents have a null term, ord their place in the
    segment and n words from position start on; rows of words have n positions."""
    session.ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["segment", "term", "ord", "id", "start", "n", "positions"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def close(ids: list[pa.Array], hashes: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            segment, made = (task << 32) + made, made + 1
            h, count = np.concatenate(hashes), np.concatenate(counts)
            k = len(count)
            none = lambda n, t: pa.nulls(n, t)
            who = pa.concat_arrays(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, segment)), none(k, pa.int64()), pa.array(np.arange(k, dtype=np.int32)), who, pa.array((np.cumsum(count) - count).astype(np.int32)), pa.array(count.astype(np.int32)), none(k, pa.binary())], names
            )
            order = np.argsort(h, kind="stable")
            s = h[order]
            cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
            k = len(cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, segment)), pa.array(s[cuts].view(np.int64)), none(k, pa.int32()), none(k, who.type), none(k, pa.int32()), pa.array(np.diff(cuts, append=len(s)).astype(np.int32)), pack(order, cuts)], names
            )

        ids, hashes, counts, full = [], [], [], 0
        for b in batches:
            done = 0
            for texts in words.chunks(b.column(1), 1 << 20):
                w = words.cut(texts, words.ALNUM, lower=True)
                ids.append(b.column(0).slice(done, len(texts)))
                hashes.append(words.hashes(w))
                counts.append(w.count)
                done, full = done + len(texts), full + len(w.raw)
                if full >= size:
                    yield from close(ids, hashes, counts)
                    ids, hashes, counts, full = [], [], [], 0
        if ids:
            yield from close(ids, hashes, counts)

    with small_batches(docs.sparkSession):
        return cut(rows.mapInArrow(write, f"segment long, term long, ord int, id {kind}, start int, n int, positions binary"), "postings")


def terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, terms): the distinct rows of items that have words, as the hashes of these."""
    session.ship(items.sparkSession)
    rows = items.select(F.col(f"`{id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in words.chunks(b.column(1), 1 << 20):
                w = words.cut(texts, words.ALNUM, lower=True)
                ends = np.r_[0, np.cumsum(w.count)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.hashes(w).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(texts)), lists], ["item", "terms"])
                done += len(texts)

    return rows.mapInArrow(read, "item string, terms array<long>").where("size(terms) > 0").distinct()


class Block(NamedTuple):
    """The distinct windows of some items."""

    vocabulary: np.ndarray  #: hashes of all words, sorted
    windows: np.ndarray  #: a row a window: numbers of its words in the vocabulary, -1 behind its end
    order: np.ndarray  #: a row a window: its places from the rarest word on, -1 behind its end
    holders: np.ndarray  #: numbers of the items that hold a window, window after window
    first: np.ndarray  #: where a window's holders begin; one more at the end
    items: list[str | None]


def block(rows: list[tuple[str | None, np.ndarray]], frequency: dict[int, int], size: int = WINDOW) -> Block:
    """The windows of items (id, hashes of the words); frequency: how often the index holds a word."""
    vocabulary = np.unique(np.concatenate([t for _, t in rows]))
    names = sorted({i for i, _ in rows}, key=lambda i: (i is None, i or ""))
    number = {i: k for k, i in enumerate(names)}
    made, owner = [], []
    for i, t in rows:
        w = np.lib.stride_tricks.sliding_window_view(np.searchsorted(vocabulary, t), min(size, len(t)))
        made.append(np.pad(w, ((0, 0), (0, size - w.shape[1])), constant_values=-1))
        owner.append(np.full(len(w), number[i]))
    windows, which = np.unique(np.concatenate(made), axis=0, return_inverse=True)
    held = np.unique(np.stack([which.ravel(), np.concatenate(owner)], 1), axis=0)
    often = np.array([frequency.get(int(t), 0) for t in vocabulary.view(np.int64)] + [np.iinfo(np.int64).max])
    order = np.argsort(often[windows], axis=1, kind="stable")  # places behind the end come last
    order[np.take_along_axis(windows, order, 1) < 0] = -1
    return Block(vocabulary, windows.astype(np.int32), order.astype(np.int8), held[:, 1], np.searchsorted(held[:, 0], np.arange(len(windows) + 1)), names)


def meet(b: Block, hashes: np.ndarray, lists: list[np.ndarray], start: np.ndarray, stop: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(window, low, high, exact) of the matches in a segment: hashes of its words among the vocabulary, their
    positions, and the ranges of positions of its documents that have words."""
    code = np.searchsorted(b.vocabulary, hashes)
    by = np.argsort(code)
    count = np.zeros(len(b.vocabulary) + 1, np.int64)  # the last one stands for the places behind a window's end
    count[code] = [len(x) for x in lists]
    offset = np.cumsum(count) - count
    place = np.concatenate([lists[i] for i in by])
    keys = (np.repeat(code[by], count[code[by]]) << 32) + place
    whole = np.flatnonzero(((count[b.windows] > 0) | (b.windows < 0)).all(1))
    rarest = b.windows[whole, b.order[whole, 0]]
    far = np.cumsum(count[rarest]) // HELD
    for part in np.split(np.arange(len(whole)), np.flatnonzero(far[1:] != far[:-1]) + 1) if len(whole) else ():
        n = count[rarest[part]]
        win = np.repeat(whole[part], n)
        anchor = place[np.arange(len(win)) + np.repeat(offset[rarest[part]] - (np.cumsum(n) - n), n)]
        doc = np.searchsorted(start, anchor, "right") - 1
        begin, low, high = anchor - b.order[win, 0], anchor.copy(), anchor.copy()
        exact = np.ones(len(win), bool)
        for r in range(1, b.windows.shape[1]):
            j = b.order[win, r]
            due = np.flatnonzero(j >= 0)
            word = b.windows[win[due], j[due]].astype(np.int64)
            want = begin[due] + j[due]
            key = (word << 32) + np.clip(want, 0, None)
            at = np.searchsorted(keys, key)
            near = lambda k: keys[np.clip(k, 0, len(keys) - 1)] - (word << 32)  # noqa: E731, B023
            fits = lambda x: (np.abs(x - want) <= slop) & (x >= start[doc[due]]) & (x < stop[doc[due]])  # noqa: E731, B023
            after, before = near(at), near(at - 1)
            good_after, good_before = fits(after) & (at < len(keys)), fits(before) & (at > 0)
            earlier = good_before & (~good_after | (want - before <= after - want))
            x = np.where(earlier, before, after)
            left = np.ones(len(win), bool)
            left[due] = good_after | good_before
            low[due], high[due] = np.minimum(low[due], x), np.maximum(high[due], x)
            exact[due] &= x == want
            win, begin, low, high, exact, doc = win[left], begin[left], low[left], high[left], exact[left], doc[left]
        yield win, low, high + 1, exact, doc


def _merged(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the ranges of each group (a number): group, low, high."""
    o = np.lexsort((low, group))
    group, low, high = group[o], low[o], high[o]
    reach = np.maximum.accumulate((np.cumsum(np.r_[False, group[1:] != group[:-1]]) << 32) + high) & 0xFFFFFFFF
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (low[1:] > reach[:-1])]) if len(group) else np.empty(0, np.int64)
    return group[new], low[new], np.maximum.reduceat(high, new) if len(new) else high


FOUND = "segment long, ord int, item string, exact boolean, start long, length long"


def _search(held, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = held.value
        for table, first in whole_groups(batches, 1):
            for a, z in zip(first.tolist(), [*first[1:].tolist(), table.num_rows], strict=True):
                rows = table.slice(a, z - a)
                word = np.flatnonzero(rows.column("term").is_valid())
                docs = rows.filter(pc.is_null(rows.column("term"))).filter(pc.field("n") > 0)
                if not len(word) or not docs.num_rows:
                    continue
                rows = rows.take(word)
                start, n, places = (docs.column(c).to_numpy().astype(np.int64) for c in ("start", "n", "ord"))
                o = np.argsort(start)
                start, n, places = start[o], n[o], places[o]
                hashes = rows.column("term").to_numpy().view(np.uint64)
                lists = [unpack(x.as_buffer()) for x in rows.column("positions")]
                for win, low, high, exact, doc in meet(b, hashes, lists, start, start + n, slop):
                    # a window's match is one of each item that holds it
                    k = b.first[win + 1] - b.first[win]
                    each = np.repeat(np.arange(len(win)), k)
                    item = b.holders[np.arange(len(each)) + np.repeat(b.first[win] - (np.cumsum(k) - k), k)]
                    group = ((doc[each] * len(b.items)) + item) * 2 + exact[each]
                    g, lo, hi = _merged(group, low[each], high[each])
                    d, i = g // 2 // len(b.items), g // 2 % len(b.items)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(g), rows.column("segment")[0].as_py())), pa.array(places[d].astype(np.int32)), pa.array(np.array(b.items, object)[i], pa.string()), pa.array(g % 2 == 1), pa.array(lo - start[d]), pa.array(hi - lo)],
                        ["segment", "ord", "item", "exact", "start", "length"],
                    )

    return run


def search(postings: DataFrame, items: DataFrame, id: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = 0, size: int = BLOCK) -> DataFrame:
    """(segment, ord, item, exact, start, length): the words start .. start + length - 1 of a document (counted from
    its first) that windows of an item match; overlapping matches of the same kind are mostly joined, not always."""
    spark = postings.sparkSession
    session.ship(spark)
    held = cut(terms(items, id, text), "items")
    total = held.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // size))
    dealt = held.withColumn("block", F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)))
    parts = []
    for k in range(blocks):
        rows = dealt.where(F.col("block") == k).select("item", "terms").toArrow()
        if not rows.num_rows:
            continue
        found = [(i, np.array(t, np.int64).view(np.uint64)) for i, t in zip(rows["item"].to_pylist(), rows["terms"].to_pylist(), strict=True)]
        vocabulary = F.broadcast(dealt.where(F.col("block") == k).select(F.explode("terms").alias("term")).distinct())
        often = postings.select("term", "n").join(vocabulary, "term").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        b = block(found, dict(zip(often["term"].to_pylist(), often["n"].to_pylist(), strict=True)), window)
        asked = postings.join(vocabulary.withColumn("asked", F.lit(True)), "term", "left").where("asked or term is null")
        asked = asked.select("segment", "term", "ord", "start", "n", "positions").repartition("segment").sortWithinPartitions("segment")
        parts.append(asked.mapInArrow(_search(spark.sparkContext.broadcast(b), slop), FOUND))
    out = spark.createDataFrame([], FOUND) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(postings: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) of every document: words inside any match, and the sorted distinct
    ids of the items that match."""
    # words covered so far, and how far: spans in order
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("far"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["far"], x["start"]))).alias("n"), F.greatest(s["far"], x["stop"]).alias("far"))
    per = found.groupBy("segment", "ord").agg(F.aggregate(spans, zero, step)["n"].alias("hit"), F.array_sort(F.collect_set("item")).alias("items"))
    docs = postings.where("term is null").select("segment", "ord", "id", "n")
    out = docs.join(per, ["segment", "ord"], "left")
    hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select("id", F.col("n").cast("long").alias("n_words"), hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))
