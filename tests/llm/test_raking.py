import pytest
from pyspark.sql import functions as F

from tessera.llm import raking


def docs(spark):
    rows = [(i, ["a", "b", "a", None][i % 4], ["en", "fr", "en"][i % 3], (i * 37) % 50) for i in range(3000)] + [(None, "a", "en", 5), (3, "z", "fr", 0)]
    return spark.createDataFrame([(*r, r[3]) for r in rows], "doc_id long, source string, lang string, rake_p int, t int")


@pytest.mark.parametrize("local", [10**6, 0])
def test_margins_met_and_sample_close(spark, local):
    d = docs(spark)
    m = {"source": (F.col("source"), 0.5), "lang": (F.col("lang"), {"en": 0.5, "fr": 0.5})}
    out = raking.rake(d, m, F.col("rake_p"), F.col("doc_id"), 0.4, max_local_cells=local)
    assert out.count() == 3002 and out.columns == ["doc_id", "source", "lang", "t", "rake_factor", "rake_p", "rake_weight", "rake_kept"]
    full = out.toPandas()
    share = full.assign(x=full.rake_factor * full.t).groupby("lang").x.sum()
    assert abs(share["en"] / share.sum() - 0.5) < 1e-6
    s = full.assign(x=full.rake_factor * full.t).groupby(full.source.fillna("-")).x.sum()
    own = full.groupby(full.source.fillna("-")).t.sum()
    assert abs(s["a"] / s["b"] - (own["a"] / own["b"]) ** 0.5) < 1e-6
    assert abs((full.rake_p * full.t).sum() / full.t.sum() - 0.4) < 1e-6
    kept = full[full.rake_kept]
    assert abs(kept.t.sum() / full.t.sum() - 0.4) < 0.05
    est = kept.assign(x=kept.rake_weight * kept.t).groupby("lang").x.sum()
    assert abs(est["en"] / est.sum() - 0.5) < 0.05


def test_local_and_spread_agree(spark):
    d = docs(spark)
    m = {"source": (F.col("source"), 0.5), "lang": (F.col("lang"), {"en": 0.9})}
    a, b = (raking.rake(d, m, F.col("rake_p"), F.col("doc_id"), 0.7, max_local_cells=n).select("doc_id", F.round("rake_p", 6), "rake_kept").collect() for n in (10**6, 0))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_empty_and_zero(spark):
    d = docs(spark)
    m = {"lang": (F.col("lang"), {"en": 1.0, "fr": 0.0})}
    out = raking.rake(d, m, F.col("rake_p"), F.col("doc_id"), 1.0)
    assert not out.where("lang = 'fr' and rake_kept").count()
    assert raking.rake(d.limit(0), m, F.col("rake_p"), F.col("doc_id")).count() == 0
    assert raking.rake(d.where("rake_p = 0"), m, F.col("rake_p"), F.col("doc_id"), 0.5).where("rake_kept").count() > 0
