"""Runs against every period tried at every place, in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import queries, runs


def brute(ws, min_length=6, exponent=4):
    """(start, length, period) of all runs."""
    out = {}
    for q in range(1, len(ws) // exponent + 1):
        i = 0
        while i + q < len(ws):
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(min_length, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(ws, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def sort_key(r):
    return r[0], r[2]


def search(texts, **kw):
    out = runs.search([None if t is None else t.encode() for t in texts], **kw).to_pylist()
    return [([(r["start"], r["length"], r["period"]) for r in x["runs"]], x["text"], x["n_words"]) for x in out]


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(150):
        ws = []
        while len(ws) < rnd.choice((0, 5, 30, 200)):
            unit = [rnd.choice("abcd"[: rnd.choice((1, 2, 4))]) + rnd.choice(("", "", "é")) for _ in range(rnd.randrange(1, 12))]
            ws += (unit * rnd.randrange(1, 8))[: rnd.randrange(1, 60)] + [rnd.choice("abcxyz")]
        texts.append(rnd.choice((" ", "\n", " \t ")).join(ws))
    for t, (found, text, n) in zip(texts, search(texts), strict=True):
        ws = t.split()
        want = sorted(brute(ws), key=sort_key)
        assert found == want and n == len(ws) and text == collapsed(ws, want)


@pytest.mark.parametrize(("min_length", "exponent"), [(2, 2), (10, 3), (6, 2), (4, 5)])
def test_other_limits(min_length, exponent):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("ab") for _ in range(60)) for _ in range(40)]
    for t, (found, _, _) in zip(texts, search(texts, min_length=min_length, exponent=exponent), strict=True):
        assert found == sorted(brute(t.split(), min_length, exponent), key=sort_key)


def test_overlap_is_the_least_of_all_periods():
    assert runs.overlap() == 5 and runs.overlap(20, 2) == 10 and runs.overlap(2, 2) == 1


def test_corners():
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x\x00y " * 8, "w" * 5000 + " " + "b " * 7, "A a A a A a A a"]
    got = search(texts)
    assert [g[0] for g in got] == [[], [], [], [], [], [(0, 6, 1)], [(0, 8, 1)], [(1, 7, 1)], [(0, 8, 2)]]
    assert [g[1] for g in got][:6] == ["", "", "", "a", "a a a a a", "a"] and got[7][1] == "w" * 5000 + " b"


def test_long_text():
    ws = [str(i) for i in range(30000)] + ["p", "q", "r"] * 20000 + [str(i) for i in range(50)] * 5
    ((found, text, n),) = search([" ".join(ws)])
    assert found == [(30000, 60000, 3), (90000, 250, 50)] and n == len(ws) and len(text.split()) == 30053


def test_a_wrong_hash_is_found_out(monkeypatch):
    """With a base of 1 stretches of the same words in any order have equal hashes."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("ab") for _ in range(80)) for _ in range(30)] + ["a b b a " * 5 + "a a a a a a a"]
    want = search(texts)
    monkeypatch.setattr(runs, "_BASE", np.uint64(1))
    assert search(texts) == want
    assert all(f == sorted(brute(t.split()), key=sort_key) for t, (f, _, _) in zip(texts, want, strict=True))


def test_operator_keeps_columns_and_rows(spark):
    rows = [(1, "a a a a a a a", "z"), (1, "a a a a a a a", "z"), (None, None, None), (3, "", "q")]
    df = spark.createDataFrame(rows, "doc_id int, text string, found string")
    got = runs.find(df).collect()
    assert [(r.doc_id, r.text, r.found.text, r.found.n_words) for r in got] == [(1, rows[0][1], "a", 7), (1, rows[0][1], "a", 7), (None, None, "", 0), (3, "", "", 0)]
    assert runs.find(df.limit(0)).collect() == [] and runs.find(df).columns == ["doc_id", "text", "found"]
    with pytest.raises(ValueError):
        runs.find(df, exponent=1)


def test_query_equals_plain_python(spark, sf_dir):
    want = []
    for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist():
        ws = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(ws), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        found = sorted(brute(ws), key=sort_key)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d["doc_id"], len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(ws, found))))
    got = sorted(map(tuple, queries.op11_runs(spark, sf_dir).collect()))
    assert got == sorted(want) and sum(w[1] for w in want) > 5


def test_period_rule_on_nulls(spark):
    df = spark.createDataFrame([(i, t) for i in range(60) for t in (None, "", " ", "one", "a b  c d")], "doc_id long, text string")
    got = df.select("doc_id", "text", queries.with_period(df.doc_id, df.text).alias("t")).collect()
    for r in got:
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            assert r.t == r.text
        else:
            assert (r.t or "").split()[:1] == (r.text or "").split()[:1]
