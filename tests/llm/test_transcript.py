import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import transcript as tr


@pytest.fixture(scope="module")
def fitted(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(F.col("conv_id").alias("id"), "turn", "role", "text")
    lines = tr.plain_lines(turns)
    train = "id % 2 = 0"
    return turns, lines, tr.fit(lines.where(train).withColumn("symbol", tr.symbol(F.col("text"))), turns.where(train))


def test_viterbi_against_all_paths(fitted):
    model = fitted[2]
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        seen = rng.integers(0, tr.SYMBOLS, n)

        def score(p):
            s = model.start[p[0]] + model.show[p[0], seen[0]]
            for a, b, o in zip(p, p[1:], seen[1:], strict=False):
                s = s + model.step[a, b] + model.show[b, o]
            return s

        best = max(map(score, itertools.product(range(tr.STATES), repeat=n)))
        assert abs(score(tr.solve(model, seen)) - best) < 1e-9


def test_chunks_equal_one_pass_and_held_out_roles(fitted):
    turns, lines, model = fitted
    test = lines.where("id % 2 = 1")
    one = tr.parse(test, model, "id", "line", "text", chunk=1 << 60)
    many = tr.parse(test, model, "id", "line", "text", chunk=1 << 32)
    a, b = (sorted(map(tuple, x.select("id", "turn", "role", "text").collect())) for x in (one, many))
    assert a == b
    true = sorted((r.id, r.turn, r.role) for r in turns.where("id % 2 = 1").collect())
    found = {(i, t, r) for i, t, r, _ in a}
    assert sum(x in found for x in true) / len(true) > 0.75


def test_markers_and_corners(spark, fitted):
    model = fitted[2]
    text = ["User: hi there?", "Assistant: hello", "[AI] again", "### Instruction: be kind", "Q> why?", "**Agent**: because", "Human: bye"]
    df = spark.createDataFrame([("c", i, t, 1) for i, t in enumerate(text)] + [(None, 1, "x", 1), ("d", None, "x", 1), ("e", 0, "", 1), ("e", 1, None, 1)], "id string, line long, text string, turn int")
    got = tr.parse(df, model, "id", "line", "text", chunk=2).orderBy("turn").collect()
    c = [(r.role, r.text) for r in got if r.id == "c"]
    assert [x[0] for x in c] == ["user", "assistant", "assistant", "system", "user", "assistant", "user"]
    assert c[1][1] == "hello" and c[4][1] == "why?" and c[5][1] == "because"
    assert {r.id for r in got if r.id != "c"} == {"e"}
    assert tr.parse(df.limit(0), model, "id", "line", "text").count() == 0


def test_turn_texts_come_back_whole(spark, fitted):
    words = ["Model-based methods", "User-friendly design", "Q-learning is", "A) first option", "(A) other option", "a | b | c", "Agent - a word", "System) no"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, text string")
    assert [tuple(r) for r in df.select(tr.marker(F.col("text")), tr.unmarked(F.col("text"))).collect()] == [(0, w) for w in words]
    marked = ["User: x", "[AI] x", "Q> x", "**Agent**: x", "**User:** x", "### Instruction: x", "<|user|> x", "(Human): x", "USER | x", "A: x"]
    assert {r[0] for r in spark.createDataFrame([(m,) for m in marked], "text string").select(tr.unmarked(F.col("text"))).collect()} == {"x"}
    body = {"user": "please list\n" + "\n".join(words) + "\nNote: keep this", "assistant": "* one\n- two\n  Note: keep this\n" + "\n".join(words)}
    turns = spark.createDataFrame([(c, t, r, body[r]) for c in range(20) for t, r in enumerate(["user", "assistant"] * 2)], "id long, turn int, role string, text string")
    lines = tr.plain_lines(turns, silent=0)
    model = tr.fit(lines.withColumn("symbol", tr.symbol(F.col("text"))), turns)
    got = sorted(map(tuple, tr.parse(lines, model, "id", "line", "text").select("id", "turn", "role", "text").collect()))
    assert got == sorted(map(tuple, turns.collect()))


def test_chunk_cut_inside_a_turn_with_marker_like_lines(spark, fitted):
    turns = spark.createDataFrame([(c, t, r, "\n".join(["hello", "Note: stay", "Answer: in the text", "a) one", "x"] * 3)) for c in range(3) for t, r in enumerate(["user", "assistant"])], "id long, turn int, role string, text string")
    lines = tr.plain_lines(turns, silent=0)
    a, b = (sorted(map(tuple, tr.parse(lines, fitted[2], "id", "line", "text", chunk=c).select("id", "turn", "role", "text").collect())) for c in (1 << 60, 4))
    assert a == b
    given = sorted((r.id, x) for r in lines.collect() for x in r.text.split("\n"))
    found = sorted((i, x) for i, _, _, t in a for x in t.split("\n"))
    assert len(given) == len(found) and {x for _, x in found} >= {"Note: stay", "a) one"}
