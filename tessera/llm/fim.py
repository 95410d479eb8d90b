"""Fill-in-middle: a text becomes its prefix, suffix and middle with sentinels, in one of two orders.

An Arrow-batched pandas UDF does the work: finditer of the regex library collects the end offsets of the
units (lines, or what a pattern says) in a compact array, two look-ups there cut the text, hashlib gives the
seeds from the row's id and the digest of the output. Rows are independent: no shuffle, no state, and a task
that runs again gives the same rows.

    form  output
    plain text
    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

Nulls: a null text is empty, a null id is keyed as `null`. An empty text, and one that holds a sentinel, stays
plain, so that restore() is exact. Rows that repeat an id are cut by the same seeds, each on its own text.
Empty table: empty result. Offsets take four bytes a unit, so memory beside the text is bounded by it.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import session

#: A unit: a line with its end.
LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
FIM = "n long, form string, output string, prefix_chars long, middle_chars long, digest string"


def seeds(salt: str, id: str) -> list[int]:
    """The first four 8-digit groups of the sha256 of `salt:id`."""
    x = hashlib.sha256(f"{salt}:{id}".encode()).hexdigest()
    return [int(x[i : i + 8], 16) for i in range(0, 32, 8)]


def cut_text(text: str, id: str, unit: regex.Pattern, salt: str, rate: int, spm: int, marks: tuple[str, str, str]) -> tuple:
    """(n, form, output, prefix_chars, middle_chars) of one text."""
    ends = array("I", (m.end() for m in unit.finditer(text)))
    n = len(ends)
    h1, h2, h3, h4 = seeds(salt, id)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", text, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    p, s, m = marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", f"{s}{suffix}{p}{prefix}{m}{middle}", a, b - a
    return n, "psm", f"{p}{prefix}{s}{suffix}{m}{middle}", a, b - a


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = LINES, salt: str = "7", rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS, name: str = "fim") -> DataFrame:
    """docs with the struct `name` (a column of that name is replaced): n units, form, output, code points of
    prefix and middle (null where plain), sha256 of the output. rate: percent of texts that are cut;
    spm: percent of those in the order of spm."""

    @F.pandas_udf(FIM)
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(unit)
        rows = []
        for i, t in zip(ids, texts, strict=True):
            row = cut_text(t or "", i, pattern, salt, rate, spm, marks)
            rows.append((*row, hashlib.sha256(row[2].encode()).hexdigest()))
        out = pd.DataFrame(rows, columns=["n", "form", "output", "prefix_chars", "middle_chars", "digest"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.withColumn(name, cut(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("null")), F.col(f"`{text}`")))


def parts(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that an output was made of. Sentinels are found from the left: texts that hold one stay plain."""
    p, s, m = marks
    if form == "psm":
        prefix, rest = output[len(p) :].split(s, 1)
        suffix, middle = rest.split(m, 1)
    elif form == "spm":
        suffix, rest = output[len(s) :].split(p, 1)
        prefix, middle = rest.split(m, 1)
    else:
        return output
    return prefix + middle + suffix


def restore(rows: DataFrame, output: Column, form: Column, marks: tuple[str, str, str] = MARKS, name: str = "restored") -> DataFrame:
    """rows with the struct `name`: the text rebuilt from output and form alone, and its sha256; null where output is null."""
    session.ship(rows.sparkSession)

    @F.pandas_udf("text string, digest string")
    def rebuild(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [None if o is None else parts(o, f, marks) for o, f in zip(outputs, forms, strict=True)]
        digests = [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts]
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "digest": pd.Series(digests, dtype=object)})

    return rows.withColumn(name, rebuild(output, form))
