"""Exact Jaccard self-join of word shingle sets by parity sketches.

A set is XOR-hashed into bit sketches: every shingle flips one bit, so the Hamming distance of two
sketches is the weight of the sketch of their symmetric difference and never above its size. With
Jaccard >= t that size is at most d = (1 - t) / (1 + t) * (|A| + |B|). Sizes fall into bands; in
each band the sketch is cut into m > d blocks, so (pigeonhole) two sets that link agree on some
block, and blocks are joined by equality. Steps:

1. One pass over the texts: set size, 128-bit identity of the set, block signatures.
2. Equal sets collapse to the smallest id. A fixed eighth of the signature space is met first: tasks
   pack their signatures by bucket and only packed arrays are shuffled; of every signature that several
   sets share the star around its smallest id becomes candidate pairs, so candidates are linear in the
   signatures however large a group of copies is.
3. Sketches are made for documents that share a signature, with eight bits or more a shingle, so that
   the bound is close. Candidates within it are verified on their texts: first one for each document,
   then those that join different components.
4. All signatures are met, now with the components known: a bucket keeps only groups that hold several
   components. They are compared pairwise by shortened sketch in tiles of bounded size. Of the pairs
   within the bound a tile emits a spanning forest and the closest others, no more pairs than it has
   rows; these are verified and components grow. If a tile had more, those that failed are set aside and this
   is repeated until no tile has a pair left.

Every link thus lies inside a final component, and only verified links build it.

Agreement: every band takes the fewest blocks that keep m > d (no link can be missed) or, as shingles
fall on blocks by hash, miss a pair at the very threshold with a chance below MISS (1e-9), and one above it
with a far smaller one. exact=True keeps m > d everywhere; blocks are then smaller and more pairs that only
share a passage meet.

Nulls and texts without words: empty set, linked with nothing. A null id is returned unlinked with
component null. Rows that repeat an id link through it. Fewer words than a shingle: the sequence is
the one shingle. Empty table: empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import session
from tessera.llm.common import components, cut, drop_paths, small_batches, whole_groups

WORDS = 5
NUM, DEN = 80, 100  # Jaccard >= NUM / DEN
MISS = 1e-9
RATIO = DEN / NUM  # width of a size band
TILE = 1024
#: Signatures that one bucket is meant to gather; the number of buckets follows from the texts.
BUCKET = 4_000_000
#: Groups of up to this many members are compared many at a time.
SMALL = 64
#: Words of the shortened sketches (64 bits each).
BRIEF = 16
#: Up to this many ids (8 bytes each) are broadcast.
BROADCAST_IDS = 1 << 20
#: Members of one verification task around one document.
SPOKES = 64
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: Bytes of texts that are cut into shingles at a time.
CHUNK = 1 << 20
#: Signatures that a task sorts at a time, and how many ids of one signature among them make it hot.
PACK, HOT = 2 * 10**6, 32

_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts, A-Z lower-cased, text after text; how many words each text has.
    Words are taken eight bytes at a time, all words together; those beyond LONG_WORD one by one."""
    ends = np.cumsum([0 if t is None else len(t) for t in texts]) + np.arange(len(texts))  # of the line feed behind each text
    raw = b"\n".join([b"" if t is None else t for t in texts]).lower() + b"\n" + bytes(8)  # bytes.lower() changes A-Z alone
    space = _SPACE[np.frombuffer(raw, np.uint8, len(raw) - 8)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = edge if space[0] else np.r_[0, edge]
    at, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) - 7,), np.dtype("<u8"), raw, 0, (1,))
    tail = lambda x, left: x & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(8) * (_U(8) - np.minimum(left, 8).astype(_U))))
    h = mix(mix(tail(eight[at], size)) + size.astype(_U))
    rest = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while len(rest):
        h[rest] = mix(h[rest] * _MULT[0] + mix(tail(eight[at[rest] + done], size[rest] - done)))
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i] + size[i]])
    return h, np.diff(np.searchsorted(at, ends), prepend=0)


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words of a sequence of word hashes."""
    n = len(h) - k + 1
    acc = np.full(n, k, _U)
    for i in range(k):
        acc = mix(acc * _MULT[i % len(_MULT)] + h[i : i + n]) if k > len(_MULT) else acc + h[i : i + n] * _MULT[i]
    return mix(acc)


def shingle_sets(texts: Sequence[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many whole texts (UTF-8), A-Z lower-cased: the sorted distinct 64-bit hashes of their word shingles,
    text after text; how many each text has; its number of words."""
    h, count = word_hashes(texts)
    first = np.cumsum(count) - count
    size = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), _U)
    long = count >= words
    if long.any():
        inside = np.arange(len(h)) - np.repeat(first, count) <= np.repeat(count - words, count)
        out[np.repeat(long, size)] = _shingles(h, words)[inside[: len(h) - words + 1]]
    for i in np.flatnonzero((count > 0) & ~long):
        out[start[i]] = _shingles(h[first[i] : first[i] + count[i]], int(count[i]))[0]
    for a, z in zip(start.tolist(), (start + size).tolist(), strict=True):
        out[a:z].sort()
    new = np.r_[True, out[1:] != out[:-1]][: len(out)]
    new[start[size > 0]] = True
    n = np.zeros(len(texts), np.int64)
    if len(out):
        n[size > 0] = np.add.reduceat(new, start[size > 0], dtype=np.int64)
    return out[new], n, count


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of one text."""
    return shingle_sets([(text or "").encode("utf-8", "surrogatepass")], words)[0]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes together."""
    far = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts]) // CHUNK if len(texts) else np.empty(0, int)
    cuts = [0, *(np.flatnonzero(far[1:] != far[:-1]) + 1).tolist(), len(texts)]
    return ((a, z) for a, z in zip(cuts, cuts[1:], strict=False) if z > a)


def _sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The hashes of each text."""
    for a, z in _chunks(texts):
        s, n, _ = shingle_sets([t.as_buffer().to_pybytes() if t.is_valid else None for t in texts[a:z]], words)
        yield from np.split(s, np.cumsum(n)[:-1])


def band(n: int) -> int:
    """Sizes of one band differ by less than RATIO; sets that link are in the same band or neighbours."""
    return int(math.floor(math.log(n) / math.log(RATIO) + 1e-9))


@functools.cache
def blocks(key: int, exact: bool = False) -> tuple[int, int]:
    """(m, t) for pairs met under a band key: m blocks, of which two linked sets agree on at least t;
    sets with fewer than t empty blocks then agree on one that is not empty."""
    # the smaller set of a pair met here is of band key - 1; pairs inside band key meet under key + 1 as well
    low, high = max(1, math.ceil(RATIO ** (key - 1) - 1e-6)), math.ceil(RATIO**key - 1e-6)
    d = int(high * (1 + RATIO) * (DEN - NUM) / (DEN + NUM) + 1e-6)

    def empty(m: int) -> int:
        mu = m * (1 - 1 / m) ** low if m > 1 else 0.0
        return math.ceil(mu + 4 * math.sqrt(mu)) + 1

    m = d + 1
    while m - d < empty(m) and m < 3 * d + 12:
        m += 1
    if exact:
        return m, m - d

    def too_few(k: int) -> float:  # P(Binomial(k, (1 - 1/k)^d) < empty(k))
        q = (1 - 1 / k) ** d if d else 1.0
        if q >= 1:
            return float(k < empty(k))
        return sum(math.exp(math.lgamma(k + 1) - math.lgamma(i + 1) - math.lgamma(k - i + 1) + i * math.log(q) + (k - i) * math.log1p(-q)) for i in range(min(empty(k), k + 1)))

    lo, hi = 2, m
    while lo < hi:
        mid = (lo + hi) // 2
        if too_few(mid) <= MISS:
            hi = mid
        else:
            lo = mid + 1
    return (lo, empty(lo)) if lo < m else (m, m - d)


def signature_lists(s: np.ndarray, n: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Block signatures of many sets, not empty, that stand one after the other (n: their sizes), for each set's own
    band key and the next; how many each set has."""
    sizes, which = np.unique(n, return_inverse=True)
    own = np.array([band(x) for x in sizes.tolist()], np.int64)[which]
    lists = []
    for key in (own, own + 1):
        names, which = np.unique(key, return_inverse=True)
        m, t = (x[which] for x in np.array([blocks(k, exact) for k in names.tolist()], np.int64).T)
        salt = (names * 0x9E3779B9 + 1).astype(_U)
        h = mix(s ^ np.repeat(mix(salt)[which], n))
        base = np.cumsum(m) - m
        at = np.repeat(base, n) + ((h >> _U(32)) * np.repeat(m, n).astype(_U) >> _U(32)).astype(np.int64)
        acc = np.zeros(int(m.sum()), _U)
        np.bitwise_xor.at(acc, at, mix(h & _U(0xFFFFFFFF)))
        block = (np.arange(len(acc)) - np.repeat(base, m)).astype(_U)
        sig = mix(acc ^ mix(block + np.repeat((salt << _U(32))[which], m)))
        full = acc != 0
        few = m - np.add.reduceat(full, base, dtype=np.int64) < t
        keep = full | ~np.repeat(few, m)
        lists.append((sig[keep], np.add.reduceat(keep, base, dtype=np.int64)))
    (x, nx), (y, ny) = lists
    mine = np.repeat(np.tile([True, False], len(n)), np.stack([nx, ny], 1).ravel())
    out = np.empty(len(x) + len(y), _U)
    out[mine], out[~mine] = x, y
    return out, nx + ny


def signatures(s: np.ndarray, exact: bool = False) -> np.ndarray:
    """Block signatures of one set."""
    return signature_lists(s, np.array([len(s)]), exact)[0]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch as uint64 words; its bits are a power of two of at least 256 and 8 times the set's size."""
    bits = max(256, 8 << max(0, int(len(s)) - 1).bit_length())
    flips = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(_U)


def fold(sk: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set on fewer bits: parity is linear."""
    return np.bitwise_xor.reduce(sk.reshape(-1, words), axis=0)


def within(n1: np.ndarray | int, n2: np.ndarray | int, d: np.ndarray | int) -> np.ndarray:
    """Whether a symmetric difference of d (or a lower bound of it) allows a link."""
    return (n1 + n2 - d) * DEN >= (n1 + n2 + d) * NUM


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both > 0 and DEN * both >= NUM * (len(a) + len(b) - both)


# ---- passes ----

FEATURES = "id long, words long, n long, h1 long, h2 long, sigs binary"


def _features(exact: bool, words: int):
    """Of (id, text): number of words; size, identity and signatures of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for a, z in _chunks(texts):
                s, n, count = shingle_sets([t.as_buffer().to_pybytes() if t.is_valid else None for t in texts[a:z]], words)
                some = n > 0
                h1, h2, each = (np.zeros(len(n), np.int64) for _ in range(3))
                sigs = np.empty(0, _U)
                if len(s):
                    at = (np.cumsum(n) - n)[some]
                    h1[some] = np.bitwise_xor.reduceat(mix(s + _U(11)), at).view(np.int64)
                    h2[some] = np.add.reduceat(mix(s ^ _U(0x5851F42D4C957F2D)), at).view(np.int64)
                    sigs, each[some] = signature_lists(s, n[some], exact)
                ends = pa.py_buffer(np.r_[0, np.cumsum(each) * 8].astype(np.int32))
                lists = pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(sigs)])
                yield pa.RecordBatch.from_arrays([b.column(0)[a:z], *map(pa.array, (count, n, h1, h2)), lists], ["id", "words", "n", "h1", "h2", "sigs"])

    return run


PACKED = "bucket int, sigs binary, ids binary, comps binary"


def _sorted(rows: Iterator[pa.RecordBatch], pack: int, part: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sig, id, comp, group starts) of about pack signatures of (id, sigs, comp) at a time, by signature and id; only
    signatures divisible by part."""
    ids, comps, sigs, size = [], [], [], 0

    def flush():
        n = [len(x) for x in sigs]
        sig, i, c = np.concatenate(sigs), np.repeat(np.array(ids, np.int64), n), np.repeat(np.array(comps, np.int64), n)
        for x in (ids, comps, sigs):
            x.clear()
        order = np.lexsort((i, sig.view(_U)))
        sig = sig[order]
        return sig, i[order], c[order], np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, int)

    for b in rows:
        for i, x, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            x = np.frombuffer(x.as_py(), np.int64)
            x = x[x % part == 0] if part > 1 else x
            ids.append(i)
            comps.append(c)
            sigs.append(x)
            size += len(x)
            if size > pack:
                yield flush()
                size = 0
    if size:
        yield flush()


def _pack(buckets: int, sig: np.ndarray, i: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """PACKED of rows sorted by signature."""
    at = ((sig.view(_U) >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    ends = [*cuts[1:], len(at)]
    cut_up = lambda x, d=False: pa.array([(np.diff(x[a:z], prepend=0) if d else x[a:z]).tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary())
    # ids as differences, components as distances from the id: both compress well
    return pa.RecordBatch.from_arrays([pa.array(at[cuts]), cut_up(sig), cut_up(i, True), cut_up(c - i)], ["bucket", "sigs", "ids", "comps"])


def _packed(buckets: int, pack: int, hot: int, part: int = 1):
    """PACKED of the signatures divisible by part. Of one that hot or more ids share here two go along, of the smallest and
    the largest component: enough to tell whether it is mixed; see _hot for the rest. With a component of its own for
    every id the smallest id is one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, i, c, starts in _sorted(batches, pack, part):
            n = np.diff(np.r_[starts, len(sig)])
            if (n >= hot).any():
                ends = []
                for a, k in zip(starts[n >= hot].tolist(), n[n >= hot].tolist(), strict=True):
                    ends += [a + int(c[a : a + k].argmin()), a + int(c[a : a + k].argmax())]
                keep = np.sort(np.r_[np.flatnonzero(np.repeat(n < hot, n)), np.unique(ends)])
                sig, i, c = sig[keep], i[keep], c[keep]
            yield _pack(buckets, sig, i, c)

    return run


def _hot(pack: int, hot: int, part: int = 1):
    """(sig, id) of what _packed left out, among others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, i, _, starts in _sorted(batches, pack, part):
            n = np.diff(np.r_[starts, len(sig)])
            keep = np.repeat(n >= hot, n)
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(i[keep])], ["sig", "id"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sig, id, comp) of one bucket after the other, sorted by sig, those of several ids alone. Rows come sorted by bucket."""
    parts: tuple[list, list, list] = ([], [], [])

    def flush():
        sig = np.concatenate(parts[0])
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        order = order[keep]
        out = sig[keep], np.concatenate(parts[1])[order], np.concatenate(parts[2])[order]
        for p in parts:
            p.clear()
        return out

    own = None
    for b in batches:
        for k, s, i, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
            if k != own and parts[0] and len((got := flush())[0]):
                yield got
            own = k
            ids = np.cumsum(np.frombuffer(i.as_py(), np.int64))
            parts[0].append(np.frombuffer(s.as_py(), np.int64))
            parts[1].append(ids)
            parts[2].append(ids + np.frombuffer(c.as_py(), np.int64))
    if parts[0] and len((got := flush())[0]):
        yield got


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of the smallest id of a shared signature and each other one."""
    for sig, ids, _ in _buckets(batches):
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        hub = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.r_[starts, len(sig)]))
        pairs = np.unique(np.stack([hub, ids], 1)[hub != ids], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, id) of the signatures that several components share."""
    for sig, ids, comp in _buckets(batches):
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        sizes = np.diff(np.r_[starts, len(sig)])
        keep = np.repeat(np.minimum.reduceat(comp, starts) < np.maximum.reduceat(comp, starts), sizes)
        sig, ids = sig[keep], ids[keep]
        for at in range(0, len(sig), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(sig[at : at + 500_000]), pa.array(ids[at : at + 500_000])], ["sig", "id"])


def _dealt(packed: DataFrame, n: int, buckets: int) -> DataFrame:
    """PACKED with the rows of a bucket together, few buckets a task."""
    return packed.repartition(max(n, min(20_000, buckets)), "bucket").sortWithinPartitions("bucket")


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(_sets(b.column(1), words))
            full = [sketch(s) for s in sets]
            brief = [fold(x, min(len(x), BRIEF)).tobytes() for x in full]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in full], pa.binary()), pa.array(brief, pa.binary())], ["id", "n", "sketch", "brief"])

    return run


class _Sketches:
    """Hamming distances of many pairs of sketches of different lengths, the longer one folded."""

    def __init__(self, column) -> None:
        raw = [np.frombuffer(x.as_py(), _U) for x in column]
        self.words = np.array([len(x) for x in raw], np.int64)
        self.at = np.zeros(len(raw), np.int64)
        self.by: dict[int, np.ndarray] = {}
        for w in np.unique(self.words):
            own = np.flatnonzero(self.words == w)
            self.at[own] = np.arange(len(own))
            self.by[int(w)] = np.stack([raw[i] for i in own])

    def rows(self, i: np.ndarray, have: int, want: int) -> np.ndarray:
        x = self.by[have][self.at[i]]
        return x if have == want else np.bitwise_xor.reduce(x.reshape(len(i), -1, want), axis=1)


def _hamming(x: _Sketches, i: np.ndarray, y: _Sketches, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    kind = x.words[i] * (1 << 30) + y.words[j]
    for k in np.unique(kind):
        wx, wy = int(k >> 30), int(k & ((1 << 30) - 1))
        w = min(wx, wy)
        own = np.flatnonzero(kind == k)
        step = max(1, 4_000_000 // max(wx, wy))
        for at in range(0, len(own), step):
            p = own[at : at + step]
            out[p] = np.bitwise_count(x.rows(i[p], wx, w) ^ y.rows(j[p], wy, w)).sum(1, dtype=np.int64)
    return out


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b, na, nb, sa, sb in; a, b and whether the sketches allow a link out."""
    for b in batches:
        if b.num_rows:
            at = np.arange(b.num_rows)
            ok = within(b.column(2).to_numpy(), b.column(3).to_numpy(), _hamming(_Sketches(b.column(4)), at, _Sketches(b.column(5)), at))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], ["a", "b", "ok"])


def _verify(words: int):
    """Of rows (hub, salt, id, text) sorted with the hub first: pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for b in batches:
            a, z = [], []
            for h, i, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), _sets(b.column(3), words), strict=True):
                if h == i:
                    hub, hub_set = h, s
                elif hub == h and linked(hub_set, s):
                    a.append(h)
                    z.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, r, c, side, id, comp, n, sketch, dead) sorted by tile: pairs of different components
    within the bound and not dead; a spanning forest of the components, then the closest others, as many
    as there are rows; a row (null, null) tells that there were more. A tile off the diagonal compares its
    two sides, one on it all its rows."""
    for t, starts in whole_groups(batches, 3):
        r, c, side, ids, comp, n = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5, 6))
        sk = _Sketches(t.column(7))
        tiny = np.stack([fold(np.frombuffer(x.as_py(), _U), 4) for x in t.column(7)])
        dead = {(i, j) for i, x in zip(ids.tolist(), t.column(8), strict=True) if x.is_valid for j in x.as_py()}
        found: list[tuple[np.ndarray, ...]] = []

        def test(i: np.ndarray, j: np.ndarray) -> None:
            """Of rows i, j that differ in component and pass the shortest sketch."""
            pair = np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1)  # noqa: B023
            pair, first = np.unique(pair, axis=0, return_index=True)
            i, j = i[first], j[first]
            ham = _hamming(sk, i, sk, j)  # noqa: B023
            ok = within(n[i], n[j], ham)  # noqa: B023
            if dead and ok.any():  # noqa: B023
                ok[ok] = [(a, b) not in dead for a, b in pair[ok].tolist()]  # noqa: B023
            if ok.any():
                found.append((pair[ok], comp[i][ok], comp[j][ok], (ham / (n[i] + n[j]))[ok]))  # noqa: B023

        ends = np.r_[starts[1:], t.num_rows]
        sizes = ends - starts
        small = (sizes <= SMALL) & (r[starts] == c[starts])
        for k in np.unique(sizes[small]):
            x, y = np.triu_indices(int(k), 1)
            base = starts[small & (sizes == k)][:, None]
            i, j = (base + x).ravel(), (base + y).ravel()
            keep = comp[i] != comp[j]
            i, j = i[keep], j[keep]
            keep = within(n[i], n[j], np.bitwise_count(tiny[i] ^ tiny[j]).sum(1, dtype=np.int64))
            if keep.any():
                test(i[keep], j[keep])
        for a, z in zip(starts[~small], ends[~small], strict=True):
            own = np.arange(a, z)
            names, many = np.unique(comp[a:z], return_counts=True)
            main = names[many.argmax()]  # pairs inside the largest component need no look
            same = r[a] == c[a]
            here, there = (own[comp[a:z] != main], own) if same else (own[side[a:z] == 0], own[side[a:z] == 1])
            for at in range(0, len(here), 256):
                i = here[at : at + 256]
                ham = np.bitwise_count(tiny[i][:, None, :] ^ tiny[there][None, :, :]).sum(2, dtype=np.int64)
                up = within(n[i][:, None], n[there][None, :], ham) & (comp[i][:, None] != comp[there][None, :])
                if same:
                    up &= (i[:, None] < there[None, :]) | (comp[there] == main)[None, :]
                p, q = np.nonzero(up)
                if len(p):
                    test(i[p], there[q])
        if not found:
            continue
        pair, ca, cb, far = (np.concatenate(x) for x in zip(*found, strict=True))
        pair, first = np.unique(pair, axis=0, return_index=True)
        ca, cb, far = ca[first], cb[first], far[first]
        order = np.argsort(far, kind="stable")
        root: dict[int, int] = {}
        tree, others = [], []
        for k in order.tolist():
            a, b = int(ca[k]), int(cb[k])
            while (x := root.get(a, a)) != a:
                a = root[a] = root.get(x, x)
            while (x := root.get(b, b)) != b:
                b = root[b] = root.get(x, x)
            (tree if a != b else others).append(k)
            if a != b:
                root[max(a, b)] = min(a, b)
        keep = [*tree, *others[: max(0, t.num_rows - len(tree))]]
        more = len(keep) < len(pair)
        a, b = ([int(x) for x in pair[keep, s]] + [None] * more for s in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b) that link by their texts (id, text). Hubs with many partners are dealt over several tasks."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).select(F.col("a").alias("hub"), F.ceil(F.col("c") / SPOKES).cast("int").alias("k"))
    spokes = pairs.select(F.col("a").alias("hub"), F.col("b").alias("id")).join(hubs, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("k").cast("long")).cast("int").alias("salt"), "id")
    centre = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.col("hub").alias("id"))
    rows = spokes.unionByName(centre).join(texts, "id").select("hub", "salt", "id", "text")
    rows = rows.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("id") != F.col("hub"))
    return rows.mapInArrow(_verify(words), "a long, b long")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, exact: bool = False) -> DataFrame:
    """One row per row of docs: id column, n_words, n_shingles, rep_id (smallest id with the very same set) and
    component_id (smallest id reachable by links of Jaccard >= 0.8)."""
    spark = docs.sparkSession
    session.ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths: list[str] = []
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    # rows that repeat an id go by a hash of id and text until the end
    again = cut(base.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id"), "parity-again", paths)
    repeated = not again.isEmpty()
    if repeated:
        own = F.when(F.col("again"), -1 - F.shiftrightunsigned(F.xxhash64("id", "text"), 1)).otherwise(F.col("id"))
        base = base.join(again.withColumn("again", F.lit(True)), "id", "left").select(own.alias("id"), "text", F.col("id").alias("given"))
        names = cut(base.where("id != given").select("id", "given").distinct(), "parity-names", paths)
        base = base.select("id", "text")
    # about 0.5 signatures a word; octets / 8 is above that in ordinary text
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    buckets = min(1 << 23, max(n, size // (8 * BUCKET)))
    with small_batches(spark):
        feats = cut(base.mapInArrow(_features(exact, words), FEATURES), "parity-features", paths)
    known = feats.where("n > 0 and id is not null")
    same = known.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    twins = cut(same.where("rep < last").select("h1", "h2", "n", "rep"), "parity-twins", paths)
    copies = cut(known.select("id", "h1", "h2", "n").join(twins, ["h1", "h2", "n"]).where("id != rep").select("id").distinct(), "parity-copies", paths)
    own = known.select("id", "sigs").join(_small(copies), "id", "left_anti")
    # candidates from an eighth of the signatures
    single = own.withColumn("comp", F.col("id"))
    stars = _dealt(single.mapInArrow(_packed(buckets, PACK, HOT, 8), PACKED), n, buckets).mapInArrow(_stars, "a long, b long")
    hot = cut(single.mapInArrow(_hot(PACK, HOT, 8), "sig long, id long"), "parity-hot", paths)
    hubs = cut(hot.groupBy("sig").agg(F.min("id").alias("a")), "parity-hubs", paths)
    stars = stars.unionByName(hot.join(_small(hubs), "sig").where("id != a").select("a", F.col("id").alias("b")))
    stars = cut(stars.distinct(), "parity-stars", paths)
    met = cut(stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))).distinct(), "parity-met", paths)
    texts = cut(base.where("id is not null").join(_small(met), "id", "left_semi"), "parity-texts", paths)
    short = cut(texts.mapInArrow(_sketch(words), SKETCHES).dropDuplicates(["id"]), "parity-sketches", paths)
    near = cut(_near(stars, short), "parity-near", paths)
    first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = cut(_links(first, texts, words), "parity-links", paths)
    # what the first links leave apart
    label = components(links)
    rest = _across(near, label)
    more = cut(_links(rest, texts, words), "parity-links", paths)
    links = links.unionByName(more)
    failed = cut(first.unionByName(rest).distinct().join(links, ["a", "b"], "left_anti"), "parity-failed", paths)
    # all signatures, with the components so far
    label = components(links)
    own = own.join(_small(label), "id", "left").select("id", "sigs", F.coalesce("component_id", "id").alias("comp"))
    groups = _dealt(own.mapInArrow(_packed(buckets, PACK, HOT), PACKED), n, buckets).mapInArrow(_mixed, "sig long, id long")
    groups = cut(groups, "parity-groups", paths)
    several = cut(groups.select("sig").distinct(), "parity-several", paths)
    if not several.isEmpty():  # the ids that hot signatures left out, where these are mixed
        more = cut(own.mapInArrow(_hot(PACK, HOT), "sig long, id long").join(_small(several), "sig", "left_semi"), "parity-hot", paths)
        groups = groups.unionByName(more)
    late_ids = groups.select("id").distinct().join(met, "id", "left_anti")
    late_ids = cut(late_ids, "parity-met", paths)
    late_texts = cut(base.where("id is not null").join(_small(late_ids), "id", "left_semi"), "parity-texts", paths)
    texts = texts.unionByName(late_texts)
    short = short.unionByName(cut(late_texts.mapInArrow(_sketch(words), SKETCHES).dropDuplicates(["id"]), "parity-sketches", paths))
    dead = None  # pairs that tiles gave and that do not link
    while True:
        sig = groups.join(label, "id", "left").select("sig", "id", F.coalesce("component_id", "id").alias("comp"))
        mixed = sig.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig", F.ceil(F.col("c") / TILE).cast("int").alias("k"))
        rows = sig.join(mixed, "sig").withColumn("t", F.pmod(F.xxhash64("id"), F.col("k").cast("long")).cast("int"))
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        rows = rows.select("sig", F.least("t", "o").alias("r"), F.greatest("t", "o").alias("c"), F.when(F.col("t") <= F.col("o"), 0).otherwise(1).alias("side"), "id", "comp")
        about = short.withColumn("dead", F.lit(None).cast("array<long>"))
        if dead is not None:
            about = short.join(dead.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("dead")), "id", "left")
        rows = rows.join(about, "id").select("sig", "r", "c", "side", "id", "comp", "n", "brief", "dead")
        rows = rows.repartition(n, "sig", "r", "c").sortWithinPartitions("sig", "r", "c")
        late = cut(rows.mapInArrow(_tiles, "a long, b long").distinct(), "parity-late", paths)
        left = not late.where("a is null").isEmpty()
        late = late.where("a is not null")
        more = cut(_links(_near(late.join(failed, ["a", "b"], "left_anti"), short), texts, words), "parity-links", paths)
        links = links.unionByName(more)
        label = components(links)
        if not left:
            break
        lost = cut(late.join(more, ["a", "b"], "left_anti"), "parity-dead", paths)
        dead = lost if dead is None else dead.unionByName(lost)
    rows = feats.select("id", "words", "n", "h1", "h2").join(twins, ["h1", "h2", "n"], "left").withColumn("rep", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id")))
    if repeated:
        real = lambda df, c: df.join(names.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("given", c)).drop("given")
        rows = rows.where("id is null").unionByName(real(real(rows.where("id is not null"), "id"), "rep"))
        edges = real(real(label.select(F.col("id").alias("a"), F.col("component_id").alias("b")), "a"), "b")
        same_set = rows.where("id is not null").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        label = components(edges.select("a", "b").unionByName(same_set))
    out = rows.join(label.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    out = out.select(F.col("id").alias(id), F.col("words").alias("n_words"), F.col("n").alias("n_shingles"), F.col("rep").alias("rep_id"), F.coalesce("component_id", "rep").alias("component_id"))
    out = cut(out, "parity-classes")
    drop_paths(spark, paths)
    return out


SKETCHES = "id long, n long, sketch binary, brief binary"


def _small(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, counted, are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _near(pairs: DataFrame, short: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""
    a, b = (short.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb")
    return rows.mapInArrow(_bounded, "a long, b long, ok boolean").where("ok").select("a", "b")


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far, with these."""
    la, lb = label.select(F.col("id").alias("a"), F.col("component_id").alias("ca")), label.select(F.col("id").alias("b"), F.col("component_id").alias("cb"))
    out = pairs.join(la, "a", "left").join(lb, "b", "left")
    return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
