import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import packing, queries


def brute(sizes, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return out


def test_against_brute_force():
    for seed in range(30):
        rnd = random.Random(seed)
        n = rnd.choice([0, 1, 5, 60, 300])
        sizes = sorted((rnd.randint(1, 100) for _ in range(n)), reverse=True)
        sources = [rnd.choice([None, *["hot"] * 4, *[f"s{i}" for i in range(8)]]) for _ in range(n)]
        clusters = [rnd.choice([None, "big", f"c{rnd.randrange(40)}"]) for _ in range(n)]
        assert packing.pack_shard(sizes, sources, clusters, 100) == brute(sizes, sources, clusters, 100)


def test_pieces_cover_and_conflicts_hold(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, 3, 40, 99, 100, 101, 350]), rnd.choice(["a", "a", "b", "c", None]), rnd.choice(["x", f"y{i}"])) for i in range(400)] + [(None, 5, "a", "x"), (700, 30, "b", "x"), (700, 30, "b", "x"), (500, 100_000, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, bin_id int, source string, cluster string")
    out = packing.pack(docs, "doc_id", F.col("bin_id"), F.col("source"), F.col("cluster"), capacity=100, shard=90).collect()
    per, bins = defaultdict(int), defaultdict(list)
    for r in out:
        per[r.doc_id] += r.n_tokens
        if r.bin_id:
            bins[r.bin_id].append(r)
    want = defaultdict(int)
    for i, n, *_ in rows:
        want[i] += n
    assert per == want
    for b in bins.values():
        b.sort(key=lambda r: r.bin_start)
        at = 0
        for r in b:
            assert r.bin_start == at
            at += r.n_tokens
        assert at <= 100
    about = {i: (s, c) for i, _, s, c in rows}
    for b in bins.values():
        for k in (0, 1):
            seen = [about[r.doc_id][k] for r in b if about[r.doc_id][k] is not None]
            assert len(seen) == len(set(seen))
    whole = [r for r in out if r.doc_id == 500]
    assert sorted(r.token_start for r in whole) == list(range(0, 100_000, 100))
    assert packing.pack(docs.limit(0), "doc_id", F.col("bin_id"), F.col("source"), F.col("cluster")).count() == 0


def test_near_copies_share_no_bin(spark, tmp_path):
    rnd = random.Random(6)
    text = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join([*text, f"x{i}"]), "en", f"s{i}", 0) for i in range(6)] + [(None, " ".join(text), "en", "s6", 0), (0, " ".join(text).upper(), "en", "s7", 0)]
    rows += [(10 + i, " ".join(f"y{rnd.randrange(5000)}" for _ in range(100)), "en", f"t{i}", 0) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op4_packing(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    bins = [r.bin_id for r in out if r.doc_id is None or r.doc_id < 10]
    assert len(bins) == 8 == len(set(bins))
    assert len({r.bin_id for r in out}) == 8  # the others fill up


def test_many_sources_take_no_longer():
    import time

    rnd = random.Random(3)
    n = 20_000
    sizes = sorted((rnd.randint(1, 2047) for _ in range(n)), reverse=True)
    began = time.time()
    packing.pack_shard(sizes, [f"s{rnd.randrange(n)}" for _ in range(n)], [None] * n, 2048)
    assert time.time() - began < 20
