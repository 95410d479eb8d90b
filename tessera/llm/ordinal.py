"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are flags of words and of word beginnings of PREFIX letters: that it occurs, that it occurs
twice or more, that it makes up DENSE of the words. One weight vector is shared by all thresholds:
P(grade > k) = sigmoid(w.x - theta_k) with theta_0 < theta_1 < ..., and the expected severity is the
sum of these over k. Weights are not negative: text can raise a grade, and no length of harmless
text can hide what raises it.

Fitting takes a bounded sample of labelled rows (SAMPLE a class, the smallest keyed hashes of the id);
feature counts are made where the texts are, and only the chosen features (at most FEATURES, by a
two-proportion z of at least MIN_Z) and the sample's flags for them reach the driver. Scoring is one
pass over whole texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import session

#: Labelled rows of each class taken for fitting.
SAMPLE = 3000
FEATURES = 2000
MIN_Z, MIN_RATIO = 5.0, 3.0
#: A chosen flag is on at least this many texts, and this share of the texts, of label 1.
MIN_DOCS, MIN_SHARE = 5, 0.01
PREFIX = (4, 5, 6)
DENSE = 0.004
RIDGE = 2e-5
MEMO = 200_000

WORD = re.compile(r"[^\W\d_]+")


def word_features(w: str) -> tuple[str, ...]:
    return (w, *(f"{w[:n]}*" for n in PREFIX if len(w) > n))


def flags_of(f: str, n: int, words: int) -> list[str]:
    """Flags of a feature that n of a text's words carry."""
    return [f, *([f"{f}2"] if n > 1 else []), *([f"{f}%"] if n >= DENSE * words else [])]


def text_features(text: str | None) -> set[str]:
    words = Counter(WORD.findall((text or "").lower()))
    carried: Counter[str] = Counter()
    for w, n in words.items():
        for f in word_features(w):
            carried[f] += n
    return {x for f, n in carried.items() for x in flags_of(f, n, words.total())}


def fit_cumulative(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = RIDGE, steps: int = 1000, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights of at least 0 and ascending thresholds that minimise the cumulative-link loss, classes weighted evenly."""
    n, m = x.shape
    x = x.astype(np.float32)
    count = np.bincount(y, minlength=grades)
    weight = (1 / np.maximum(count, 1))[y]
    weight = (weight / weight.sum()).astype(np.float64)
    w, t0, gap = np.zeros(m), 0.0, np.zeros(grades - 2)
    mom, var, at = np.zeros(m + grades - 1), np.zeros(m + grades - 1), 0
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for at in range(1, steps + 1):
        theta = t0 + np.r_[0.0, np.cumsum(np.exp(gap))]
        s = x @ w.astype(np.float32)
        upper = np.concatenate([np.ones((n, 1)), sig(s[:, None] - theta[None, :]), np.zeros((n, 1))], 1)  # P(y >= k)
        row = np.arange(n)
        a, b = upper[row, y], upper[row, y + 1]
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)  # derivatives; zero at both ends
        ds = -weight * (da - db) / p
        dtheta = np.zeros(grades - 1)
        for k in range(grades - 1):
            dtheta[k] = np.sum(weight * (np.where(y == k + 1, da, 0) - np.where(y == k, db, 0)) / p)
        gw = (ds.astype(np.float32) @ x).astype(np.float64) + ridge * w
        ggap = np.array([dtheta[k + 1 :].sum() * math.exp(gap[k]) for k in range(grades - 2)])
        g = np.concatenate([gw, [dtheta.sum()], ggap])
        mom, var = 0.9 * mom + 0.1 * g, 0.98 * var + 0.02 * g * g
        step = rate * (1 - at / (steps + 1)) * (mom / (1 - 0.9**at)) / (np.sqrt(var / (1 - 0.98**at)) + 1e-8)
        w, t0, gap = np.maximum(0, w - step[:m]), t0 - step[m], np.clip(gap - step[m + 1 :], -5, 5)
    return w, t0 + np.r_[0.0, np.cumsum(np.exp(gap))]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thetas: tuple[float, ...]

    def tail(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[:, None] - np.array(self.thetas)[None, :], -40, 40)))

    def scorer(self):
        """text -> w.x; what a word carries is looked up once a task."""
        used = {f.rstrip("2%") for f in self.weights}
        memo: dict[str, tuple[str, ...]] = {}

        def score(text: str | None) -> float:
            words = Counter(WORD.findall((text or "").lower()))
            carried: dict[str, int] = {}
            for w, n in words.items():
                hit = memo.get(w)
                if hit is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    hit = memo[w] = tuple(f for f in word_features(w) if f in used)
                for f in hit:
                    carried[f] = carried.get(f, 0) + n
            if not carried:
                return 0.0
            total = words.total()
            return math.fsum(self.weights.get(x, 0.0) for f, n in carried.items() for x in flags_of(f, n, total))

        return score


def severity_of(toxic: Column, quality: Column) -> Column:
    """The grade that two binary labels give: 0 not toxic, 1 toxic and of good (or unknown) quality, 2 toxic and of low quality."""
    return F.when(toxic == 0, 0).when(toxic == 1, F.when(quality == 0, 2).otherwise(1))


def sample(labels: DataFrame, id: str, label: str, per_class: int, grades: int) -> DataFrame:
    """At most per_class ids of label 0 and of all labels above: the smallest keyed hashes."""
    rows = labels.where(F.col(id).isNotNull() & F.col(label).between(0, grades - 1)).groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("g"))
    pick = lambda few: rows.where(few).orderBy(F.xxhash64("id", F.lit(17)), "id").limit(per_class)
    return pick(F.col("g") == 0).unionByName(pick(F.col("g") > 0))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = SAMPLE, grades: int = 3) -> Model:
    """Fit on rows labelled with ordered grades 0 .. grades - 1; 0 is harmless.

    Grades come from the labels alone. A grade without rows, at the top, gets a threshold that few texts
    pass; binary labels (grades=2) give one threshold. Rows without a label, or with a null id or label, or
    one outside the grades, are not used. Without rows both of grade 0 and above the model has no weights
    and gives every text grade 0.
    """
    session.ship(docs.sparkSession)
    none = Model({}, tuple(20.0 + i for i in range(grades - 1)))
    chosen = sample(labels, id, label, per_class, grades).withColumn("y", (F.col("g") > 0).cast("int"))
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    # copies of a text count once; the sample is bounded, so is this shuffle
    rows = rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("id").alias("id"), F.max("y").alias("y"), F.first("text").alias("text"), F.max("g").alias("g")).select("id", "y", "text", "g")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["f", "y", "n"])
        for b in batches:
            for y, t in zip(b.column(1), b.column(2), strict=True):
                seen.update((f, y.as_py()) for f in text_features(t.as_py()))
                seen[("", y.as_py())] += 1
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        yield out()

    n1 = F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.lit(0))
    n0 = F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0))
    counts = rows.mapInArrow(count, "f string, y int, n long").groupBy("f").agg(n1.alias("n1"), n0.alias("n0")).persist()
    try:
        total = counts.where("f = ''").first()
        if total is None or not total.n1 or not total.n0:
            return none
        p = (F.col("n1") + F.col("n0") + 1) / F.lit(float(total.n1 + total.n0 + 2))
        z = (F.col("n1") / total.n1 - F.col("n0") / total.n0) / F.sqrt(p * (1 - p) * (1 / total.n1 + 1 / total.n0) + 1e-12)
        best = counts.where((F.col("f") != "") & (F.col("n1") >= max(MIN_DOCS, MIN_SHARE * total.n1))).withColumn("z", z)
        best = best.where((F.col("z") >= MIN_Z) & (F.col("n1") * float(total.n0) >= MIN_RATIO * F.col("n0") * float(total.n1)))
        best = best.orderBy(F.col("z").desc(), "f").limit(FEATURES).collect()
    finally:
        counts.unpersist()
    names = [r.f for r in best]
    at = {f: i for i, f in enumerate(names)}

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [sorted(at[f] for f in text_features(t.as_py()) if f in at) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(hits, pa.list_(pa.int32()))], ["id", "g", "hits"])

    if not names:
        return none
    found = rows.mapInArrow(flags, "id long, g int, hits array<int>").toArrow().sort_by([("id", "ascending"), ("g", "ascending")]).to_pylist()
    x = np.zeros((len(found), len(names)), np.float32)
    for i, r in enumerate(found):
        x[i, r["hits"]] = 1
    y = np.array([r["g"] for r in found])
    w, theta = fit_cumulative(x, y, grades)
    return Model({f: float(v) for f, v in zip(names, w, strict=False)}, tuple(float(t) for t in theta))


def grade(docs: DataFrame, model: Model, text: str = "text", reject: float = 0.4) -> DataFrame:
    """All rows and columns of docs with severity (expected grade), grade (the most likely one) and
    rejected (P(grade >= 1) >= reject, and at least one flag of the model). A null or empty text has no
    flags: it is scored as such and never rejected.
    Columns of docs with these names are replaced."""
    session.ship(docs.sparkSession)
    new = ("severity", "grade", "rejected")
    keep = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema = f"{fields}, severity double, grade int, rejected boolean"
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            scores = np.array([score(t.as_py()) for t in b.column(at)], np.float64)
            tail = model.tail(scores)
            mass = -np.diff(np.concatenate([np.ones((len(tail), 1)), tail, np.zeros((len(tail), 1))], 1), axis=1)
            more = [pa.array(tail.sum(1)), pa.array(mass.argmax(1).astype(np.int32)), pa.array((tail[:, 0] >= reject) & (scores > 0))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*keep, *new])

    return rows.mapInArrow(run, schema)
