"""Periodic runs of words, and texts with each run collapsed to its first period.

A run is a stretch of words with smallest period q (words q apart are equal), at least min_length words and
exponent periods long, that no neighbouring word extends. It overlaps itself, shifted by q, in its length
less q words; the least such overlap over all q is k. So each word of a run lies in a k-gram that occurs
twice in the document: words outside all repeated k-grams of their document are masked, and only the
segments between masked words are searched.

Segments are searched by Main and Lorentz's divide and conquer, all segments of a chunk of texts at a time:
blocks of 8, 16, 32, ... words have a middle; a run lies in a smallest block and crosses its middle there.
For a middle and a period, one of the run's halves holds exponent / 2 periods, which one comparison
tells; what is left is extended both ways as far as the words agree. Stretches are compared by prefix hashes
and bisection; every run found is then compared word by word, and a segment where a hash was wrong is searched
without hashes. Words are told apart by 64-bit hashes.

Work is n log n in the words of the segments, linear in all others; memory follows the longest text.
Nulls and texts without words: no runs, empty text. Rows are independent: no shuffle; repeated rows give
equal results. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import words
from tessera.llm.parity_join import mix

MIN_LENGTH, EXPONENT = 6, 4
RUNS = "n_words: long, runs array<struct<start: long, length: long, period: long>>, text: string"
#: Bytes of texts worked at a time, and pairs of a middle and a period.
CHUNK, PAIRS = 1 << 20, 1 << 20
_U = np.uint64
_BASE = _U(0xD1342543DE82EF95)


def overlap(min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> int:
    """The least overlap of a run with itself shifted by its period."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))


def repeated(h: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice in their text. Wrongly equal hashes only add words."""
    n = len(h)
    if n < k:
        return np.zeros(n, bool)
    text = np.repeat(np.arange(len(count), dtype=np.int64), count)
    g = mix(text[: n - k + 1].astype(_U) + _BASE)
    for i in range(k):
        g = mix(g * _BASE + h[i : n - k + 1 + i])
    at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
    order = at[np.argsort(g[at])]
    twin = g[order[1:]] == g[order[:-1]]
    hit = np.zeros(n + 1, np.int64)
    for one in (order[1:][twin], order[:-1][twin]):
        hit[one] = 1
    cover = hit.copy()
    cover[k:] -= hit[:-k]
    return np.cumsum(cover)[:n] > 0


def segments(alive: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the stretches of at least so many living words inside one text."""
    if not len(alive):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    border = np.zeros(len(alive) + 1, bool)
    border[0] = border[-1] = True
    border[np.cumsum(count)] = True
    changed = np.r_[True, alive[1:] != alive[:-1], True]
    edge = np.flatnonzero(border | changed)
    a, b = edge[:-1], edge[1:]
    good = (b - a >= least) & alive[a]
    return a[good], b[good]


def repetitions(y: np.ndarray, start: np.ndarray, stop: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, stop, period) of all runs of y inside the segments, by start and period. The segments
    stand one behind the other in y."""
    n = len(y)
    power = np.cumprod(np.r_[_U(1), np.full(n, _BASE)])
    pre = np.r_[_U(0), np.cumsum(y * power[:n])]

    def same(a: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (pre[a + size] - pre[a]) * power[p] == pre[a + p + size] - pre[a + p]

    def farthest(low: np.ndarray, high: np.ndarray, ok) -> np.ndarray:
        while (low < high).any():
            mid = (low + high + 1) // 2
            good = ok(mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low

    def cross(mid: np.ndarray, a: np.ndarray, b: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Runs around the middles, periods 1 .. top."""
        each = np.repeat(np.arange(len(mid)), top)
        p = np.arange(len(each)) - np.repeat(np.cumsum(top) - top, top) + 1
        mid, a, b = mid[each], a[each], b[each]
        half = (exponent * p + 1) // 2 - p  # words that agree with those a period on, in one half
        right = np.flatnonzero(mid + p + half <= b)
        right = right[same(mid[right], p[right], half[right])]
        left = np.flatnonzero(mid - p - half >= a)
        left = left[same((mid - p - half)[left], p[left], half[left])]
        pick = np.r_[right, left]
        i = np.r_[mid[right], (mid - p - half)[left]]
        p, a, b, half = p[pick], a[pick], b[pick], half[pick]
        ahead = farthest(half, b - p - i, lambda t: same(i, p, t))
        back = farthest(np.zeros_like(i), i - a, lambda u: same(i - u, p, u))
        s, e = i - back, i + p + ahead
        ok = e - s >= np.maximum(min_length, exponent * p)
        return np.unique(np.stack([s[ok], e[ok], p[ok]], 1), axis=0)

    found = []
    block = 1 << (max(min_length, 2) - 1).bit_length()
    while len(start):
        mid = np.arange(block // 2, n, block)
        own = np.searchsorted(start, mid, "right") - 1
        mid, own = (x[(own >= 0) & (mid > start[own]) & (mid < stop[own])] for x in (mid, own))
        top = np.minimum(block, stop[own] - start[own]) // exponent
        far = np.cumsum(top) // PAIRS
        for part in np.split(np.arange(len(mid)), np.flatnonzero(far[1:] != far[:-1]) + 1) if len(mid) else ():
            found.append(cross(mid[part], start[own[part]], stop[own[part]], top[part]))
        if block >= 2 * n:
            break
        block *= 2
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.unique(np.concatenate(found), axis=0)
    # a run with period q has the same ends with 2q, 3q, ...
    runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)][: len(runs)]]
    wrong = {int(np.searchsorted(start, s, "right")) - 1 for s, e, p in runs.tolist() if not np.array_equal(y[s : e - p], y[s + p : e])}
    for j in wrong:
        a, b = int(start[j]), int(stop[j])
        runs = np.concatenate([runs[(runs[:, 0] < a) | (runs[:, 0] >= b)], plain(y[a:b], min_length, exponent) + [a, a, 0]])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def plain(y: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """The same rows for one segment, period by period, without hashes."""
    seen: dict[tuple[int, int], int] = {}
    for p in range(1, len(y) // exponent + 1):
        edge = np.flatnonzero(np.diff(np.r_[False, y[:-p] == y[p:], False].astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + p).tolist(), strict=True):
            if e - s >= max(min_length, exponent * p):
                seen.setdefault((s, e), p)
    rows = sorted((s, p, e) for (s, e), p in seen.items())
    return np.array([(s, e, p) for s, p, e in rows], np.int64).reshape(-1, 3)


def _collapsed(w: words.Words, keep: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bytes of each text's kept words joined by one space, and these texts one behind the other."""
    raw = np.frombuffer(w.raw, np.uint8).copy()
    text = np.repeat(np.arange(len(w.count)), w.count)[keep]
    at, end = w.at[keep], (w.at + w.size)[keep]
    raw[end] = 0x20
    more = np.r_[text[1:] == text[:-1], False] if len(text) else np.zeros(0, bool)  # a space behind, but behind the last
    step = np.zeros(len(raw) + 1, np.int8)
    step[at] += 1
    step[end + more] -= 1
    size = np.bincount(text, end - at + more, len(w.count)).astype(np.int64)
    return size, raw[np.cumsum(step[:-1], dtype=np.int8) > 0].tobytes()


def search(texts: list[bytes | None], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> pa.StructArray:
    """n_words, runs and collapsed text of each text."""
    w = words.cut(texts, words.PLAIN)
    h, first = words.hashes(w), np.cumsum(w.count) - w.count
    a, b = segments(repeated(h, w.count, overlap(min_length, exponent)), w.count, min_length)
    size = b - a
    start = np.cumsum(size) - size
    back = np.repeat(a - start, size)  # from a place in the segments to the word
    y = h[np.arange(len(back)) + back]
    found = repetitions(y, start, start + size, min_length, exponent)
    s, p, length = found[:, 0] + (back[found[:, 0]] if len(found) else 0), found[:, 2], found[:, 1] - found[:, 0]
    gone = np.zeros(len(h) + 1, np.int64)
    np.add.at(gone, s + p, 1)
    np.add.at(gone, s + length, -1)
    own = np.searchsorted(first + w.count, s, "right")
    offsets = np.r_[0, np.cumsum(np.bincount(own, minlength=len(texts)))]
    runs = pa.StructArray.from_arrays([pa.array(s - first[own]), pa.array(length), pa.array(p)], ["start", "length", "period"])
    bytes_of, joined = _collapsed(w, np.cumsum(gone)[:-1] == 0)
    ends = np.r_[0, np.cumsum(bytes_of)]
    text = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(joined)).cast(pa.string())
    return pa.StructArray.from_arrays([pa.array(w.count), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs), text], ["n_words", "runs", "text"])


def find(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT, name: str = "found") -> DataFrame:
    """docs with the struct `name` (a column of that name is replaced): n_words, runs (start, length, period;
    by start, then period) and text, the words outside all runs after their first periods, joined by one space.
    exponent is a whole number of at least 2."""
    if exponent < 2 or min_length < 2:
        raise ValueError("exponent and min_length must be at least 2")
    session.ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != name]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != name)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [search(c, min_length, exponent) for c in words.chunks(b.column(at), CHUNK)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.concat_arrays(done or [search([])])], [*keep, name])

    return rows.mapInArrow(run, f"{fields}{', ' if fields else ''}`{name}` struct<{RUNS}>")
