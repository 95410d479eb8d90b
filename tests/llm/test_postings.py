"""Matches of benchmark windows against every window tried at every place, in plain Python."""

import random
import re

import pytest
from tessera.llm import postings


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=10):
    """(id, n_words, n_hit, items, contaminated) of each document."""
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for s in range(max(0, len(w) - window) + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + k]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (g := tuple(w[s : s + k])) in wins:
                    hit |= set(range(s, s + k))
                    names |= wins[g]
        out.append((d, len(w), len(hit), sorted(n for n in names if n is not None), bool(hit)))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


def run(spark, docs, items, size=postings.BLOCK, segment=postings.SEGMENT, **kw):
    d, i = frames(spark, docs, items)
    index = postings.index(d, size=segment)
    return sorted((tuple(r) for r in postings.report(index, postings.search(index, i, size=size, **kw)).collect()), key=str)


@pytest.mark.parametrize(("seed", "size", "segment"), [(0, postings.BLOCK, postings.SEGMENT), (1, 30, 400), (2, 60, 1)])
def test_equals_brute_force(spark, seed, size, segment):
    rnd = random.Random(seed)
    text = lambda n, v: rnd.choice((" ", ", ", "-")).join(rnd.choice(v) for _ in range(n))
    vocabulary = ["The", "the", "cat", "É", "été", "42", "x" * 300, "sat"]
    items = [(f"i{k}", text(rnd.choice((0, 1, 3, 9, 10, 12, 25)), vocabulary)) for k in range(12)] + [("i3", text(15, vocabulary)), (None, text(14, vocabulary))]
    docs = []
    for k in range(40):
        body = [text(rnd.randrange(0, 30), vocabulary)]
        for _ in range(rnd.randrange(3)):
            body += [rnd.choice(items)[1].upper().replace("É", "É"), text(rnd.randrange(3), vocabulary)]
        docs.append((k, " ".join(body)))
    assert run(spark, docs, items, size, segment) == sorted(brute(docs, items), key=str)


def test_corners(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = [("b", passage), ("a", passage.upper()), ("a", passage), ("c", "solo"), ("none", None), ("empty", "..."), (None, "ghost words")]
    docs = [(1, passage), (1, passage), (None, "x " + passage.replace(" ", "\n") + " y"), (4, None), (5, ""), (6, "SOLO; solo ghost words"), (7, "one two three four five six seven eight nine"), (8, "nine ten")]
    got = run(spark, docs, items)
    assert got == sorted(brute(docs, items), key=str)
    assert (6, 4, 4, ["c"], True) in got and (None, 13, 11, ["a", "b"], True) in got
    # a passage never goes on in the next document
    halves = [(1, " ".join(passage.split()[:5])), (2, " ".join(passage.split()[5:]))]
    assert [r[2] for r in run(spark, halves, items[:1])] == [0, 0]
    assert run(spark, docs, [("none", None)]) == sorted(brute(docs, []), key=str)
    assert run(spark, [], items) == []


def test_one_word_everywhere(spark):
    docs = [(k, "a " * 500) for k in range(20)] + [(99, "b")]
    got = run(spark, docs, [("x", "a " * 40), ("y", "a " * 10 + "b")])
    assert got == sorted(brute(docs, [("x", "a " * 40), ("y", "a " * 10 + "b")]), key=str)


def test_spans_and_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, f"w w {item} w"), (2, "w alpha beta gamma NEW delta epsilon zeta eta theta iota kappa"), (3, "beta alpha gamma delta epsilon zeta eta theta iota kappa"), (4, "alpha beta gamma a b c d e delta epsilon zeta eta theta iota kappa")]
    # the corpus makes kappa the rarest word: the others are placed from it
    docs.append((5, " ".join(w for w in item.split() if w != "kappa") + " w"))
    d, i = frames(spark, docs, [("q", item)])
    index = postings.index(d)
    who = {(r.segment, r.ord): r.id for r in index.where("term is null").collect()}
    found = lambda slop: sorted((who[r.segment, r.ord], r.exact, r.start, r.length) for r in postings.search(index, i, slop=slop).collect())
    assert found(0) == [(1, True, 2, 10)]
    assert found(1) == [(1, True, 2, 10), (2, False, 1, 11), (3, False, 0, 10)]
    assert (4, False, 0, 15) in found(5) and len(found(5)) == 4


def test_index_holds_all_positions(spark):
    docs = [(1, "a b a"), (2, None), (3, "c a b")]
    d, _ = frames(spark, docs, [])
    rows = postings.index(d.coalesce(1)).collect()
    assert sorted((r.ord, r.id, r.start, r.n) for r in rows if r.term is None) == [(0, 1, 0, 3), (1, 2, 3, 0), (2, 3, 3, 3)]
    assert sorted(tuple(postings.unpack(r.positions).tolist()) for r in rows if r.term is not None) == [(0, 2, 4), (1, 5), (3,)]


def test_string_ids_and_other_columns(spark):
    d = spark.createDataFrame([("k1", "red green", 1), ("k2", "blue", 2)], "doc_id string, text string, term int")
    i = spark.createDataFrame([(7, "green", "z")], "item_id int, text string, ord string")
    index = postings.index(d)
    assert sorted(map(tuple, postings.report(index, postings.search(index, i)).collect())) == [("k1", 2, 1, ["7"], True), ("k2", 1, 0, [], False)]
