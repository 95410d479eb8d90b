import numpy as np

from tessera.llm import rabitq


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    q = 0.9 * x[:50] + 0.4 * rng.normal(size=(50, 64))
    codes, f = rabitq.encode(x)
    est, half = rabitq.estimate(q, codes, f)
    true = rabitq.unit(q) @ rabitq.unit(x).T
    assert abs((est - true).mean()) < 0.005 and (np.abs(est - true) <= half[None, :]).all()


def brute(ids, xs, t=0.9):
    ok = [x is not None and all(v is not None and np.isfinite(v) for v in x) and any(x) for x in xs]
    n = len(ids)
    count, at = [0] * n, list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and ids[i] is not None and ids[j] is not None:
                a, b = np.array(xs[i], float), np.array(xs[j], float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= t:
                    count[i] += 1
                    count[j] += 1
                    at[find(i)] = find(j)
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], count[i], low.get(find(i)), None if ids[i] is None else ids[i] == low[find(i)]) for i in range(n) if ids[i] is not None)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    xs = [list(map(float, v)) for v in base]
    for _ in range(340):  # copies at many distances, chains, and a large group
        b = base[0] if rng.random() < 0.4 else base[rng.integers(60)] if rng.random() < 0.5 else np.array(xs[rng.integers(len(xs))])
        xs.append(list(map(float, b + rng.choice([0, 0.05, 0.2, 0.3]) * rng.normal(size=24))))
    xs += [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [2 * v for v in xs[0]], xs[0]]
    ids = [int(i) for i in rng.permutation(len(xs))]
    df = spark.createDataFrame([(i, x, 1) for i, x in zip(ids, xs, strict=True)] + [(None, xs[0], 1)], "vec_id long, embedding array<double>, n_links int")
    got = [tuple(r) for r in rabitq.near_duplicates(df).collect()]
    assert [r for r in got if r[0] is None] == [(None, 0, None, None)]
    got, want = sorted(r for r in got if r[0] is not None), brute(ids, xs)
    assert got == want


def test_no_pair_at_the_threshold_is_missed(spark):
    rng = np.random.default_rng(3)
    x = rabitq.unit(rng.normal(size=(3000, 64)))
    away = rng.normal(size=x.shape)
    away = rabitq.unit(away - (away * x).sum(1)[:, None] * x)
    cosine = rng.choice([0.8999, 0.9001, 0.905, 0.92], 3000)[:, None]
    xs = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * away])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(xs)], "vec_id long, embedding array<double>")
    want = [(i, int(c > 0.9), i % 3000 if c > 0.9 else i, c < 0.9 or i < 3000) for i, c in enumerate(np.tile(cosine[:, 0], 2))]
    for block_bytes in (rabitq.BLOCK_BYTES, 700_000):  # one block, and several
        assert sorted(map(tuple, rabitq.near_duplicates(df, block_bytes=block_bytes).collect())) == want


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    xs = [list(map(float, base[rng.integers(30)] * rng.choice([1, 2]) + rng.choice([0, 0.1, 0.3, 0.5]) * rng.normal(size=16))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(xs)), "vec_id long, embedding array<double>")
    assert sorted(map(tuple, rabitq.near_duplicates(df, block_bytes=5_000).collect())) == brute(list(range(300)), xs)


def test_empty_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (5, [0.0, 2.0]), (0, [3.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, rabitq.near_duplicates(df).collect()))
    assert got == [(0, 1, 0, True), (1, 2, 0, False), (1, 2, 0, False), (5, 1, 0, False)]
    assert rabitq.near_duplicates(df.limit(0)).count() == 0


def test_regions_apart_are_not_compared_and_nothing_is_lost(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(6, 32))
    x = centre[rng.integers(0, 6, 3000)] + 0.12 * rng.normal(size=(3000, 32))
    x[:1000] = centre[0] + 0.12 * rng.normal(size=(1000, 32))  # one cluster holds a third and more
    x[100:400] = x[99]  # and one vector a tenth
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = rabitq.unit(x)
    near = u @ u.T >= 0.9
    got = {r.vec_id: r.n_links for r in rabitq.near_duplicates(df, block_bytes=256 * 32 * 8).collect()}
    assert got == {i: int(n) - 1 for i, n in enumerate(near.sum(1))}
    p = rabitq.unit(centre)
    assert (rabitq.angles(p, p)[np.triu_indices(6, 1)] > 1).all()
