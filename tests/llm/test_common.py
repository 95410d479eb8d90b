import random

from tessera.llm.common import components


def brute(edges):
    at = {}

    def find(x):
        at.setdefault(x, x)
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            at[y] = x
    return {x: find(x) for x in list(at)}


def test_components(spark):
    rnd = random.Random(2)
    path = list(range(100, 160))
    rnd.shuffle(path)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + list(zip(path, path[1:], strict=False)) + [(None, 3), (5, 5), (1000, 1001), (1001, 1000)]
    df = spark.createDataFrame(edges, "a long, b long")
    for local in (10**6, 5):
        got = {r.id: r.component_id for r in components(df, local_edges=local).collect()}
        assert got == brute(edges)
    assert components(df.limit(0)).count() == 0
