"""Words of many whole texts at once, as byte ranges and 64-bit hashes.

Texts are UTF-8. A word is a longest stretch of bytes of a class; classes hold no line feed, so a text
never reaches into the next. Bytes from 0x80 up are in a class together or not at all: no character is cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm.parity_join import LONG_WORD, mix

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in the given inclusive ranges."""
    inside = np.zeros(256, bool)
    for a, z in ranges:
        inside[a : z + 1] = True
    return inside


#: `[^\x20\x09-\x0D]`
PLAIN = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, of texts in lower case
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


class Words(NamedTuple):
    raw: bytes  #: the texts, a line feed behind each, and eight zero bytes
    at: np.ndarray  #: first byte of each word in raw
    size: np.ndarray  #: bytes of each word
    count: np.ndarray  #: words of each text


def cut(texts: Sequence[bytes | None], inside: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts, text after text; a null text has none. lower: A-Z lower-cased."""
    ends = np.cumsum([0 if t is None else len(t) for t in texts], dtype=np.int64) + np.arange(len(texts))
    raw = b"\n".join([t or b"" for t in texts])
    raw = (raw.lower() if lower else raw) + b"\n" + bytes(8)  # bytes.lower() changes A-Z alone
    word = inside[np.frombuffer(raw, np.uint8, len(raw) - 8)]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    edge = np.r_[0, edge] if word[0] else edge
    at = edge[::2]
    return Words(raw, at, edge[1::2] - at, np.diff(np.searchsorted(at, ends), prepend=0))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time, all words together; those beyond LONG_WORD bytes one by one."""
    eight = np.ndarray((len(w.raw) - 7,), np.dtype("<u8"), w.raw, 0, (1,))
    head = lambda x, left: x & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(8) * (_U(8) - np.minimum(left, 8).astype(_U))))
    h = mix(mix(head(eight[w.at], w.size)) + w.size.astype(_U))
    rest, done = np.flatnonzero((w.size > 8) & (w.size <= LONG_WORD)), 8
    while len(rest):
        h[rest] = mix(h[rest] * _STEP + mix(head(eight[w.at[rest] + done], w.size[rest] - done)))
        done += 8
        rest = rest[w.size[rest] > done]
    for i in np.flatnonzero(w.size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(w.raw[w.at[i] : w.at[i] + w.size[i]])
    return h


def chunks(texts: pa.Array, size: int) -> Iterator[list[bytes | None]]:
    """Consecutive whole texts, about so many bytes together."""
    held: list[bytes | None] = []
    full = 0
    for t in texts:
        b = t.as_buffer().to_pybytes() if t.is_valid else None
        held.append(b)
        full += len(b or b"")
        if full >= size:
            yield held
            held, full = [], 0
    if held:
        yield held
