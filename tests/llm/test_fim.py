"""Fill-in-middle against a plain reading of its rule."""

import hashlib
import re

import pytest

from tessera.llm import fim


def brute(i, t, rate=100, spm=50):
    x = hashlib.sha256(f"7:{i}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    lines = t.splitlines(keepends=True) if "\r" not in t and not re.search("[\x0b\x0c\x1c-\x1e\x85  ]", t) else re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(lines)
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
        return n, "plain", t, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h[3] % 100 < spm else (n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc\nd\n\ne", "é😀\r\nü\n z", "has <M> in it\nx", "<P", "x<S\n>y\nM>", "<\n" * 30, "line\n" * 5000]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 50), (100, 0), (100, 100), (0, 50)])
def test_equals_the_rule(spark, rate, spm):
    rows = [(k * 31 + j, t) for k, t in enumerate(TEXTS) for j in range(8)] + [(None, "a\nb"), (5, "a\nb"), (5, "a\nb"), (5, "other\nlines\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = fim.transform(df, rate=rate, spm=spm)
    out = fim.restore(out, out.fim.output, out.fim.form).collect()
    assert len(out) == len(rows)
    for r in out:
        n, form, output, prefix, middle = brute("null" if r.doc_id is None else r.doc_id, r.text or "", rate, spm)
        assert (r.fim.n, r.fim.form, r.fim.output, r.fim.prefix_chars, r.fim.middle_chars) == (n, form, output, prefix, middle)
        assert r.restored.text == (r.text or "") and r.fim.digest == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored.digest == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_other_units_and_marks(spark):
    df = spark.createDataFrame([("a", "one two  three", 9)], "key string, body string, fim int")
    (r,) = fim.transform(df, "key", "body", unit=r"\S+\s*", marks=("[p]", "[s]", "[m]")).collect()
    assert r.fim.n == 3 and fim.parts(r.fim.output, r.fim.form, ("[p]", "[s]", "[m]")) == r.body
    assert fim.transform(df.limit(0), "key", "body").collect() == []
