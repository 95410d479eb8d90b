import random
import re

import numpy as np
import pytest

from tessera.llm import parity_join as pj


def brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    at = {i: i for i, _ in rows if i is not None}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for p, (i, _) in enumerate(rows):
        for q, (j, _) in enumerate(rows[:p]):
            both = len(sets[p] & sets[q])
            if i is not None and j is not None and both and 100 * both >= 80 * len(sets[p] | sets[q]):
                a, b = sorted((find(i), find(j)))
                at[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.5:  # near copy: some words changed, around the threshold
            w = rnd.choice(texts).split(" ")
            for _ in range(max(1, int(len(w) * rnd.choice([0.005, 0.01, 0.02, 0.025, 0.03, 0.05])))):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.5:
                w = w[: int(len(w) * rnd.uniform(0.75, 1))] or w
        else:
            w = [word() for _ in range(rnd.choice([1, 3, 5, 6, 9, 12, 30, 90, 300, 900]))]
            if kind < 0.7:
                w = w + passage
        texts.append(" ".join(w))
    texts += [None, "", " \n", texts[0].upper(), texts[1], "a b c", "a b c", "A\tb\x0bc", "x" * 3000, "same " * 500, "same " * 501]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed,exact", [(1, False), (2, False), (2, True)])
def test_against_brute_force(spark, seed, exact):
    rows = corpus(seed, 220)
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n int")
    got = pj.classes(docs, exact=exact).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_corners(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t), (3, t), (1, t), (3, "other words in this text here"), (9, "other words in this text here"), (4, None)]
    got = pj.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 36, None), (3, 36, 1), (1, 36, 1), (3, 2, 1), (9, 2, 1), (4, 0, 4)], key=str)
    assert pj.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pigeonhole_keeps_pairs_at_the_threshold():
    rnd = np.random.default_rng(5)
    for n in [4, 8, 9, 17, 40, 100, 333, 1000, 4000]:
        for _ in range(60):
            common = int(n * 0.9) if n > 8 else n - 1
            d = [x for x in range(3 * n) if pj.within(common, common + x, x)]
            extra = max(d)
            s = np.unique(rnd.integers(0, 2**63, common + extra, dtype=np.uint64))
            cut = rnd.integers(0, extra + 1)
            a, b = np.sort(s[: common + cut]), np.sort(np.r_[s[:common], s[common + cut :]])
            if pj.linked(a, b):
                assert np.intersect1d(pj.signatures(a), pj.signatures(b)).size, n
                w = min(len(pj.sketch(a)), len(pj.sketch(b)))
                ham = int(np.bitwise_count(pj.fold(pj.sketch(a), w) ^ pj.fold(pj.sketch(b), w)).sum())
                assert ham <= len(np.setxor1d(a, b)) and pj.within(len(a), len(b), ham)


def test_small_tiles_hubs_and_hot_signatures(spark, monkeypatch):
    """Results stay when groups exceed tiles, hubs exceed tasks, and signatures are hot in a task."""
    for name, value in (("TILE", 8), ("SPOKES", 3), ("HOT", 2), ("PACK", 500), ("SMALL", 4), ("BROADCAST_IDS", 2), ("BUCKET", 50)):
        monkeypatch.setattr(pj, name, value)
    rows = corpus(3, 160)
    rnd = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    for i in range(60):  # one family, neighbours link and ends do not
        base[rnd.randrange(120)] = f"z{i}"
        rows.append((1000 + i, " ".join(base)))
    got = pj.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_fewer_blocks_only_where_the_chance_is_small():
    for key in range(1, 40):
        (m, t), (strict, u) = pj.blocks(key), pj.blocks(key, exact=True)
        assert m <= strict and t >= 1 and u >= 1 and (m == strict or m >= 20)


def test_words_and_shingles_of_many_texts():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aAbB\u00e9\x1f\x85\x00z \t\n\x0b\x0c\r") for _ in range(rnd.choice([0, 1, 5, 40, 300]))) for _ in range(2000)]
    texts += [f"{'q' * n} {'Q' * n} {'q' * n}x" for n in (7, 8, 9, 16, 255, 256, 257, 5000)] + ["qqqqqqqq qqqqqqq\x00"]
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    h, count = pj.word_hashes([t.encode() for t in texts])
    assert count.tolist() == [len(w) for w in words]
    of = dict(zip([w for ws in words for w in ws], h.tolist(), strict=True))
    assert [of[w] for ws in words for w in ws] == h.tolist() and len(set(of.values())) == len(of)
    assert pj.word_hashes([None, b""])[1].tolist() == [0, 0]
    for k in (1, 3, 5, 9):
        s, n, _ = pj.shingle_sets([t.encode() for t in texts], k)
        assert n.tolist() == [len({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))}) if ws else 0 for ws in words]
        own = np.split(s, np.cumsum(n)[:-1])
        assert all((a == pj.shingle_set(t, k)).all() for a, t in zip(own, texts, strict=True))
    sets = [x for x in own if len(x)]
    sigs, each = pj.signature_lists(np.concatenate(sets), np.array([len(x) for x in sets]))
    assert all((a == pj.signatures(x)).all() for a, x in zip(np.split(sigs, np.cumsum(each)[:-1]), sets, strict=True))
