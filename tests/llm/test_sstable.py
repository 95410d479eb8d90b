import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import sstable

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "a", "It's we've  I'LL\tx\n\ny", "Straße ÉCOLE, naïve—dash ² ½ ǅ İstanbul ΣΑΣ", "<|endoftext|> and <|startoftext|>x", "école ́x", "x" * 5000,
    "tab\x0bvt\x1cfs\x85nel nbsp　wide", "don't'''s '' 's", "漢字かな交じり 12.5% a_b", "word " * 20000, "µ ª º × ÷ ÿ Ÿ",
]


def test_encoder_equals_library():
    lib, enc = Tokenizer.from_file(PATH), sstable.Encoder(PATH)
    assert enc.by_word and enc.width == 2
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(enc(t or ""), "<u2").tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_round_trip_and_lookup(spark, tmp_path):
    rows = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)] + [(None, "null key"), (1, "one"), (1, "two"), (1, "one")]
    docs = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, start string")
    manifest = sstable.write(docs, PATH, shards=3, folder=f"file://{tmp_path}/s")
    got = sstable.read_back(spark, manifest).orderBy("start").collect()
    lib = Tokenizer.from_file(PATH)
    want, start = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert [tuple(r)[:4] for r in sorted(got, key=key) if r[0] != 1] == [w for w in want if w[0] != 1]
    assert sorted(r[2:4] for r in got if r[0] == 1) == sorted(w[2:] for w in want if w[0] == 1)
    readers = [sstable.Reader(m.path) for m in manifest.orderBy("shard").collect()]
    found = {k: sorted(tuple(x) for r in readers for x in r.get(k)) for k in (None, 1, -20, 999)}
    assert len(found[1]) == 4 and len(found[None]) == 1 and len(found[-20]) == 1 and not found[999]


def test_empty_and_order(spark):
    manifest = sstable.write(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert manifest.count() == 0 and sstable.read_back(spark, manifest).count() == 0
    w = sstable.Writer(None, 2)
    w.add(b"b", b"")
    with pytest.raises(ValueError):
        w.add(b"a", b"")


def test_many_blocks(tmp_path):
    with open(tmp_path / "x.sst", "wb") as out:
        w = sstable.Writer(out, 4)
        for i in range(3000):
            w.add(sstable.key_bytes(f"k{i:05d}"), np.arange(i % 97, dtype="<u4").tobytes())
        w.close()
    r = sstable.Reader(str(tmp_path / "x.sst"))
    assert len(r.blocks) > 5 and r.docs == 3000
    assert all(len(r.get(f"k{i:05d}")[0]) == i % 97 for i in range(0, 3000, 13))
    assert [sstable.key_of(k) for k, _ in r] == [f"k{i:05d}" for i in range(3000)]
    assert sum(r.may_hold(sstable.key_bytes(f"no{i}")) for i in range(2000)) < 60


def test_string_keys_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(k, t) for k, t in [("b", "two"), ("a", "one"), (None, "none"), ("é", "three x")]], "doc_id string, text string")
    manifest = sstable.write(docs, PATH, shards=2, folder=f"file://{tmp_path}/k")
    got = sstable.read_back(spark, manifest).orderBy("start").collect()
    lib, start = Tokenizer.from_file(PATH), 0
    for r, (k, t) in zip(got, [(None, "none"), ("a", "one"), ("b", "two"), ("é", "three x")], strict=True):
        n = len(lib.encode(t, add_special_tokens=False).ids) + 1
        assert (r.doc_id, r.start, r.n_tokens) == (k, start, n)
        start += n
