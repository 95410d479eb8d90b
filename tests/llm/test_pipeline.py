import re

import pytest
from test_parity_join import brute

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    found, docs = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    found.append(docs)
    for name, f in cp.STAGES:
        docs = cp.common.cut(f(spark, docs, sf_dir), f"test-{name}")
        found.append(docs)
    return found


def test_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard", "pii", "mixing", "packing"]
    for s in stages[1:5]:
        assert s.columns == stages[0].columns and 0 < s.count() <= stages[0].count()


def test_near_duplicates_against_brute_force(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in stages[2].select("doc_id").collect()) == sorted(i for i, _, c in brute(rows) if i == c)


def test_no_personal_data_survives(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r.text for r in stages[3].collect()}
    assert before.keys() == after.keys()
    rx = re.compile(r"[\w.]+@[\w.]+\w|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d+\.\d+\.\d+\.\d+\b|AKIA[0-9A-Z]{16}|\b[0-9a-f]{18,40}\b")
    n = 0
    for i, t in before.items():
        for e in rx.findall(t):
            assert e not in after[i]
            n += 1
        if not rx.search(t) and not re.search(r"\d{3}", t):
            assert after[i] == t
    assert n > 5


def test_packing_takes_all_that_mixing_kept(stages):
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in stages[4].collect()}
    got = {}
    for r in stages[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == words


def test_corners(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "x", 0), (10**6, "twice a b c d e f", "en", "x", 17)], docs.schema)
    for first in (docs.unionByName(odd), docs.limit(0)):
        out = first
        for _, f in cp.STAGES:
            out = f(spark, out, sf_dir)
        assert (out.count() > 0) == (first is not docs and not first.isEmpty())
