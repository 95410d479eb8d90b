"""Sorted-string-table shards of token ids.

One shard is one file of documents in ascending key order:

    block*  index  bloom  footer

A block holds entries (shared, unshared, value length as varints; key suffix; value), the key stored
as the length it shares with the key before it and the rest, and is compressed with zstd. The sparse
index has one row a block: first key, offset, length, documents and ids before it. The Bloom filter
covers the keys. The fixed-size footer gives the places of both, counts, the width of an id and a
checksum of index and filter. A lookup asks the filter, finds the block by binary search in the index
and scans that block alone.

Files are written by the tasks straight into a shared folder under a name of their own for each
attempt; the manifest (a table) names the files that count, so a task that runs twice does no harm.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.llm.common import cut, new_path, small_batches

MAGIC = b"TSST0001"
FOOTER = struct.Struct("<8sQIQIQQBI")  # magic, index at, its bytes, bloom at, its bytes, documents, ids, width, crc
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Words kept per Python worker with their ids, twice.
CACHE = 150_000

MANIFEST = "shard int, path string, docs long, ids long, bytes long, key string"


# ---- keys ----


def key_bytes(key: int | str | None) -> bytes:
    """Order-preserving bytes: null before integers before strings."""
    if key is None:
        return b"\x00"
    return b"\x02" + key.encode() if isinstance(key, str) else b"\x01" + struct.pack(">Q", int(key) + (1 << 63))


def key_of(b: bytes) -> int | str | None:
    return None if b[0] == 0 else b[1:].decode() if b[0] == 2 else struct.unpack(">Q", b[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


# ---- files ----


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    """Takes (key, ids) in ascending key order; equal keys may repeat."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at = out, width, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[bytes] = []
        self.hashes: list[bytes] = []
        self.docs = self.ids = self.docs0 = self.ids0 = 0
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        if not self.block:
            self.first, self.docs0, self.ids0, shared = key, self.docs, self.ids, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if key != self.last or not self.docs:
            self.hashes.append(key)
        self.last, self.docs, self.ids = key, self.docs + 1, self.ids + len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack(bytes(self.block))
            self.out.write(data)
            self.index.append(_varint(len(self.first)) + self.first + struct.pack("<QIQQ", self.at, len(data), self.docs0, self.ids0))
            self.at += len(data)
            self.block.clear()

    def close(self) -> int:
        self._flush()
        bits = max(64, len(self.hashes) * BLOOM_BITS)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        at = np.array([p for k in self.hashes for p in _probes(k, bits)], np.int64)
        np.bitwise_or.at(bloom, at >> 3, (1 << (at & 7)).astype(np.uint8))
        index, bloom = b"".join(self.index), struct.pack("<Q", bits) + bloom.tobytes()
        foot = FOOTER.pack(MAGIC, self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, self.width, zlib.crc32(index + bloom))
        self.out.write(index + bloom + foot)
        return self.at + len(index) + len(bloom) + len(foot)


class Reader:
    """Lookup and scan of one shard; holds its index and filter, and one block at a time."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = _fs(uri)
        self.file = fs.open_input_file(path)
        self.unpack = zstandard.ZstdDecompressor().decompress
        foot = self._read(self.file.size() - FOOTER.size, FOOTER.size)
        magic, at, n, bloom_at, bloom_n, self.docs, self.ids, self.width, crc = FOOTER.unpack(foot)
        index, bloom = self._read(at, n), self._read(bloom_at, bloom_n)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError(f"{uri} is no whole shard")
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.firsts: list[bytes] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        i = 0
        while i < len(index):
            k, i = _read_varint(index, i)
            self.firsts.append(index[i : i + k])
            self.blocks.append(struct.unpack_from("<QIQQ", index, i + k))
            i += k + 28

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        at, n, _, _ = self.blocks[block]
        b, key, i = self.unpack(self._read(at, n)), b"", 0
        while i < len(b):
            shared, i = _read_varint(b, i)
            rest, i = _read_varint(b, i)
            size, i = _read_varint(b, i)
            key = key[:shared] + b[i : i + rest]
            i += rest
            yield key, b[i : i + size]
            i += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.blocks)):
            yield from self._entries(block)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, key: int | str | None) -> list[np.ndarray]:
        """Ids of every document with this key; empty if there is none."""
        k, found = key_bytes(key), []
        if not self.blocks or not self.may_hold(k):
            return found
        block = max(0, bisect.bisect_left(self.firsts, k) - 1)
        while block < len(self.blocks) and self.firsts[block] <= k:
            found += [np.frombuffer(v, f"<u{self.width}") for x, v in self._entries(block) if x == k]
            block += 1
        return found

    def close(self) -> None:
        self.file.close()


# ---- encoding ----


class _Ids(dict):
    """Word -> bytes of its ids. When full, words not used since the last time it was full are let go."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        x = self.old.get(word)
        if x is None:
            x = self.encode(word)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = x
        return x


class Encoder:
    """Ids of a text as bytes, equal to one encode() of the whole text.

    For the word-level BPE with the pre-tokenizer PATTERN, a text of printable ASCII and Latin-1 letters
    is lower-cased and split here and each distinct word goes through the model once; pre-tokens never
    span white space, so of other texts only the pieces that need it go to the library's encode().
    Any other tokenizer encodes whole texts.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Latin-1 codes of plain texts: printable ASCII, tab, line ends, letters.
    PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        state = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        split = state(self.tokenizer.pre_tokenizer).get("pretokenizers", [])
        normal = state(self.tokenizer.normalizer).get("normalizers", [])
        self.by_word = [x.get("pattern", {}).get("Regex") for x in split] == [self.PATTERN, None] and split[1]["type"] == "ByteLevel" and [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: b for b in own} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
        self.words = _Ids(self._word)

    def _word(self, word: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))
        return np.array([t.id for t in tokens], self.dtype).tobytes()

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return self._library(text)
        try:
            plain = not text.encode("latin-1").translate(None, self.PLAIN)
        except UnicodeEncodeError:
            plain = False
        if plain and "<|" not in text:
            return b"".join(map(self.words.__getitem__, self.WORDS.findall(text.lower())))
        if " " in text or "\n" in text:
            return b"".join(map(self, text.replace("\n", " ").split(" ")))
        return self._library(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- DataFrames ----


def write(docs: DataFrame, tokenizer: str, end_id: int | None = 1, folder: str | None = None, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encode and write docs in ascending key order; the manifest (shard, path, docs, ids, bytes,
    key: the type of the keys).

    Keys: integers or strings; a null key sorts first, equal keys stay together as rows of their own,
    ordered by text. A null text is an empty one; end_id, if given, follows every document's ids. An
    empty table gives an empty manifest. Other columns of docs are not written. shards: how many range
    partitions of the keys (default: the session's shuffle partitions); each streams through one task.
    """
    spark = docs.sparkSession
    session.ship(spark)
    folder = folder or new_path(spark, "sst")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "string" if docs.schema[key].dataType.simpleString() == "string" else "long"
    rows = docs.select(F.col(key).cast(kind).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(n, F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc, w = TaskContext.get().partitionId(), encoder(tokenizer), None
        end = b"" if end_id is None else np.array([end_id], f"<u{enc.width}").tobytes()
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                if w is None:
                    path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                    fs, local = _fs(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local)
                    w = Writer(out, enc.width)
                w.add(key_bytes(k.as_py()), enc(t.as_py()) + end)
        if w is not None:
            size = w.close()
            out.close()
            row = {"shard": shard, "path": path, "docs": w.docs, "ids": w.ids, "bytes": size, "key": kind}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("key", pa.string())]))

    with small_batches(spark):
        return cut(rows.mapInArrow(task, MANIFEST), "sst-manifest")


def read_back(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the files in the manifest: doc_id (of the type of the keys written), start (ids before it), n_tokens, ids_crc32.

    The running sum over shards is a window over one row a shard. Each file is streamed block by block.
    """
    base = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = manifest.withColumn("base", base).select("shard", "path", "base")
    about = manifest.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).first()
    kind = about.key or "long"
    rows = rows.repartition(max(1, about.n), "shard")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
        frame = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string() if kind == "string" else pa.int64(), *[pa.int64()] * 3, pa.int32()], strict=True)], names)
        for b in batches:
            for x in b.to_pylist():
                reader, start, out = Reader(x["path"]), x["base"], []
                for k, v in reader:
                    ids = np.frombuffer(v, f"<u{reader.width}").astype("<u4")
                    out.append((key_of(k), start, len(ids), zlib.crc32(ids.tobytes()), x["shard"]))
                    start += len(ids)
                    if len(out) == 20_000:
                        yield frame(out)
                        out = []
                reader.close()
                if out:
                    yield frame(out)

    return rows.mapInArrow(task, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, shard int")
