"""The registered queries over whole small tables: those with SQL equal it, the others are held against plain recomputation."""

import os
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import ordinal, packing, queries, transcript

Q, SQL = queries.queries(), queries.oracle_sql()


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in Q) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    got = Q[name](spark, sf_dir)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    cell = lambda v: round(v, 7) + 0.0 if isinstance(v, float) else v
    key = lambda rows, cols: sorted((tuple(cell(r[cols.index(c)]) for c in sorted(names)) for r in rows), key=str)
    assert key(got.collect(), got.columns) == key(want.fetchall(), names)


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


def test_op2_equals_the_library(spark, sf_dir, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = np.array([*lib.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, Q["op2_token_shards"](spark, sf_dir).collect())) == want


def test_op3_keeps_rows_and_what_holds_no_entity(spark, sf_dir, documents):
    got = {r.doc_id: r for r in Q["op3_pii"](spark, sf_dir).collect()}
    assert len(got) == len(documents) and sum(r.n_entities for r in got.values()) > 0
    for d in documents:
        if not any(c.isdigit() or c == "@" or c in "=:." for c in d["text"] or "") or d["text"] is None:
            assert got[d["doc_id"]].text == d["text"] or "M" in d["text"]


def test_op4_covers_every_document(spark, sf_dir, documents):
    import re

    got, bins = {}, {}
    for r in Q["op4_packing"](spark, sf_dir).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
    assert got == {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in documents}
    assert all(n <= packing.CAPACITY for b, n in bins.items() if b is not None)


def test_op6_equals_brute_force(spark, sf_dir, documents):
    from test_parity_join import brute

    got = sorted(map(tuple, Q["op6_parity_join"](spark, sf_dir).collect()), key=str)
    assert got == brute([(d["doc_id"], d["text"]) for d in documents])


def test_op8_equals_its_model_text_by_text(spark, sf_dir, documents):
    got = {r.doc_id: r for r in Q["op8_toxicity"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = ordinal.fit(docs, queries.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), label="grade")
    assert len(got) == len(documents)
    for d in documents:
        s = sum(model.weights.get(f, 0.0) for f in ordinal.text_features(d["text"]))
        tail = model.tail(np.array([s]))[0]
        assert abs(got[d["doc_id"]].severity - tail.sum()) < 1e-9 and got[d["doc_id"]].rejected == bool(tail[0] >= 0.4 and s > 0)


def test_op9_equals_one_pass_of_viterbi(spark):
    """The query over whole sf0.01, against one pass over the lines of each conversation in plain Python."""
    sf = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(queries.F.col("conv_id").alias("id"), "turn", "role", "text")
    lines = transcript.plain_lines(turns).withColumns({"symbol": transcript.symbol(queries.F.col("text")), "bare": transcript.unmarked(queries.F.col("text"))})
    model = transcript.fit(lines, turns)
    per = {}
    for r in lines.orderBy("id", "line").collect():
        per.setdefault(r.id, []).append(r)
    want = []
    for i, rows in per.items():
        path = transcript.solve(model, np.array([r.symbol for r in rows]))
        found = []
        for s, r in zip(path, rows, strict=True):
            if s % 2 == 0:
                found.append((int(s) // 2, [r.bare]))
            else:
                found[-1][1].append(r.text)
        want += [(i, t, transcript.ROLES[r], f"<|{transcript.ROLES[r]}|>\n{chr(10).join(x).strip(' ')}\n<|end|>\n") for t, (r, x) in enumerate(found)]
    got = sorted(map(tuple, Q["op9_transcripts"](spark, sf).collect()))
    assert got == sorted(want)
    true = {(r.id, r.turn, r.role, r.text.strip(" ")) for r in turns.collect()}
    bare = {(i, t, r, x.split("|>\n", 1)[1].removesuffix("\n<|end|>\n")) for i, t, r, x in got}
    assert len(true & bare) >= 0.75 * len(true)
    print("turns", len(true), "exact", len(true & bare))
