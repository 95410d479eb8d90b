import numpy as np
import pytest

from tessera.llm import vptree


def clustered(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + n // 5] = x[0]  # a third of all rows alike
    x[5] = 2 * x[6]
    return x


def cosine(q, x):
    n = np.arange(len(x))
    return np.stack([vptree.exact(q, np.full(len(x), i), x, n) for i in range(len(q))])


def brute(ids, x, q, k):
    s = cosine(x[[ids.tolist().index(q)]], x)[0]
    s[ids == q] = -np.inf
    order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
    return [(int(ids[i]), s[i]) for i in order]


@pytest.mark.parametrize("seed", [0, 1])
def test_factor_one_is_exact(seed):
    x = clustered(seed, 1500)
    ids = np.random.default_rng(seed).permutation(1500).astype(np.int64)
    t = vptree.Tree.build(ids, x, leaf=16)
    pick = np.arange(0, 1500, 7)
    scores, found = t.search(ids[pick], x[pick], 5)
    for r, p in enumerate(pick):
        want = brute(ids, x, ids[p], 5)
        assert found[r].tolist() == [i for i, _ in want] and scores[r].tolist() == [v for _, v in want]


def test_larger_factor_prunes_and_recall_stays():
    x = clustered(3, 3000)
    ids = np.arange(3000)
    t = vptree.Tree.build(ids, x, leaf=16)
    pick = np.arange(0, 3000, 50)
    _, found = t.search(ids[pick], x[pick], 5, factor=1.5)
    hit = sum(len(set(found[r]) & {i for i, _ in brute(ids, x, p, 5)}) for r, p in enumerate(pick))
    assert hit >= 0.9 * 5 * len(pick)


def test_corners(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)], 3) for i in range(300)] + [(1000, None, 0), (1050, [0.0, 0.0, 0.0], 0), (1100, [float("nan"), 1.0, 1.0], 0), (1150, [None, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0), (50, [1.0, 1.0, 50.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    out = vptree.search(df, df.where("vec_id % 50 = 0"), 5, shard=100)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {0, 50, 100, 150, 200, 250} and all(sorted(r.rank for r in v) == [1, 2, 3, 4, 5] for v in got.values())
    one = df.where("vec_id in (50, 51)")
    assert [r.vec_id for r in vptree.search(one, one.where("vec_id = 51"), 5).collect()] == [50, 50]  # every row is a candidate
    assert vptree.search(df.limit(0), df.limit(0), 5).count() == 0


def test_search_over_regions_equals_brute_force_with_repeated_ids(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(5, 12))
    x = centre[rng.integers(0, 5, 900)] + 0.2 * rng.normal(size=(900, 12))
    x[300:600] = x[7]  # one vector holds a third of all rows
    ids = np.arange(900)
    ids[10:19], ids[301:304] = 1, 301  # an id of nine other vectors, an id of three equal rows
    ids[800] = 850  # two queries of one id
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    for factor, shard, k in ((1.0, 60, 5), (1.0, 10_000, 3), (1.4, 60, 5)):
        got = {}
        for r in vptree.search(df, df.where("vec_id % 50 in (0, 1)"), k, factor=factor, shard=shard).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        want = {}
        for q in sorted({int(i) for i in ids if i % 50 in (0, 1)}):
            rows = [(-s, int(ids[j])) for r in np.flatnonzero(ids == q) for j, s in enumerate(cosine(x[[r]], x)[0]) if ids[j] != q]
            want[q] = [(n, i, -s) for n, (s, i) in enumerate(sorted(rows)[:k], 1)]
        if factor == 1:
            assert {q: sorted(v) for q, v in got.items()} == want
        else:
            hit = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / len({i for _, i, _ in want[q]}) for q in want)
            assert hit >= 0.9 * len(want)


def test_search_gives_each_repeated_row(spark):
    rows = [(1, [1.0, 0.01 * i]) for i in range(9)] + [(i, [-1.0, float(i)]) for i in range(50, 550)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], df.schema)
    assert [r.vec_id for r in vptree.search(df, asked, 5).collect()] == [1] * 5
