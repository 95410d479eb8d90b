"""A filter of trading decisions that learns from labelled ones: boosted trees and calibrated chances, fitted on the cluster.

Rows are cut by time, never shuffled: a head to fit the trees, a tail of the training rows to calibrate, the newest rows to hold out.
Trees and calibration are Spark ML; only the cuts, the counts and the fitted model come to the driver. Isotonic
calibration sees a row for each of at most 1,001 rounded chances, with the rows' weights summed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of the newest rows held out, share of the training rows to calibrate on, and the rows that these and a model need.
TEST, CALIBRATE = 0.3, 0.25
MIN_ROWS, MIN_CALIBRATE, MIN_ISOTONIC = 30, 60, 300
#: Stands for a missing value: below every real one, so that a tree can split it off.
MISSING = -1e12


def vectorize(rows: DataFrame, features: list[str], qty: str = "signed_qty") -> DataFrame:
    """rows with `features`: the named columns in order, then the direction. Nulls, NaN and infinite values are missing; a column that is
    missing throughout is constant and never split."""
    x = lambda c: F.when(F.col(c).cast("double").between(-1e11, 1e11), F.col(c).cast("double")).otherwise(MISSING)
    d = rows.withColumns({f"_x_{c}": x(c) for c in features} | {"_x_dir": F.coalesce(F.signum(F.col(qty).cast("double")), F.lit(0.0))})
    return VectorAssembler(inputCols=[*(f"_x_{c}" for c in features), "_x_dir"], outputCol="features").transform(d).drop(*(f"_x_{c}" for c in features), "_x_dir")


@dataclass
class Policy:
    features: list[str]
    trees: object
    calibrator: object = None  #: of Spark ML: isotonic over chances, or logistic over margins; None without enough rows
    isotonic: bool = False

    def score(self, rows: DataFrame, qty: str = "signed_qty") -> DataFrame:
        """rows with p_win, the chance that the decision wins."""
        d = self.trees.transform(vectorize(rows, self.features, qty))
        d = d.withColumn("_p", vector_to_array("probability")[1]).withColumn("_m", vector_to_array("rawPrediction")[1])
        if self.calibrator is None:
            p = F.col("_p")
        elif self.isotonic:
            d, p = self.calibrator.transform(VectorAssembler(inputCols=["_p"], outputCol="_v").transform(d)), F.col("_c")
        else:
            model = self.calibrator
            p = 1 / (1 + F.exp(-(model.intercept + float(model.coefficients[0]) * F.col("_m"))))
        return d.withColumn("p_win", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).select(*[c for c in rows.columns if c != "p_win"], "p_win")


def decide(direction: Column, p_win: Column, threshold: float = 0.55, most: int = 3) -> Column:
    """Contracts with sign: none below the threshold, else 1 and up to `most` as the chance rises to 1 (halves to even)."""
    span = max(1e-9, 1 - threshold)
    qty = F.least(F.greatest(1 + F.bround((p_win - threshold) / span * (most - 1)), F.lit(1.0)), F.lit(float(most)))
    return F.when((direction == 0) | p_win.isNull() | (p_win < threshold), 0).otherwise(direction * qty).cast("int")


def cut(rows: DataFrame, at: str, share: float) -> tuple[DataFrame, DataFrame]:
    """The older rows, and about the given share of the newest: rows of one time stay together; a null time belongs to neither."""
    d = rows.where(F.col(at).isNotNull()).withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")) if rows.schema[at].dataType.simpleString() in ("date", "timestamp", "timestamp_ntz") else F.col(at).cast("long"))
    edge = d.agg(F.percentile_approx("_at", F.lit(1 - share), F.lit(10_000)).alias("e")).first().e
    edge = 0 if edge is None else edge
    return d.where(F.col("_at") < edge).drop("_at"), d.where(F.col("_at") >= edge).drop("_at")


def _trees(rows: DataFrame, rounds: int) -> object:
    return GBTClassifier(featuresCol="features", labelCol="y", weightCol="w", maxIter=rounds, maxDepth=3, stepSize=0.2, minInstancesPerNode=5, subsamplingRate=1.0, seed=0).fit(rows)


def _classes(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("k")).first()
    return r.n, r.k


def fit(rows: DataFrame, features: list[str], at: str, label: str = "win", weight: str | None = None, qty: str = "signed_qty", rounds: int = 20) -> Policy | None:
    """Trees on the older rows (at, features, signed_qty, win as 0 or 1, weight), calibrated on the newest quarter: isotonic from 300 rows there,
    logistic from 60, else not at all and then fitted on all rows. None below 30 rows or with one class. Null labels take no part."""
    d = rows.where(F.col(label).isNotNull()).withColumns({"y": F.col(label).cast("double"), "w": F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)})
    n, classes = _classes(d)
    if n < MIN_ROWS or classes < 2:
        return None
    head, tail = cut(d, at, CALIBRATE)
    (n_tail, tail_classes), (_, head_classes) = _classes(tail), _classes(head)
    if n_tail < MIN_CALIBRATE or tail_classes < 2 or head_classes < 2:
        return Policy(features, _trees(vectorize(d, features, qty), rounds))
    policy = Policy(features, _trees(vectorize(head, features, qty), rounds))
    scored = policy.trees.transform(vectorize(tail, features, qty)).select("y", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("m"))
    if n_tail >= MIN_ISOTONIC:
        points = scored.groupBy(F.round("p", 3).alias("p"), "y").agg(F.count(F.lit(1)).cast("double").alias("k"))
        points = VectorAssembler(inputCols=["p"], outputCol="_v").transform(points)
        policy.calibrator, policy.isotonic = IsotonicRegression(featuresCol="_v", labelCol="y", weightCol="k", predictionCol="_c").fit(points), True
    else:
        policy.calibrator = LogisticRegression(featuresCol="_v", labelCol="y").fit(VectorAssembler(inputCols=["m"], outputCol="_v").transform(scored))
    return policy


def evaluate(scored: DataFrame, label: str = "win", threshold: float = 0.55) -> dict:
    """Of scored rows: n, n_taken, base_win_rate, precision and lift of those taken, auc, brier, gap; None where undefined."""
    y, p = F.col(label).cast("double"), F.col("p_win")
    d = scored.where(F.col(label).isNotNull() & p.isNotNull())
    taken = F.when(p >= threshold, y)
    r = d.agg(F.count(F.lit(1)).alias("n"), F.count(taken).alias("n_taken"), F.avg(y).alias("base"), F.avg(taken).alias("precision"), F.avg(F.pow(p - y, 2)).alias("brier"), F.abs(F.avg(p) - F.avg(y)).alias("gap"), F.countDistinct(y).alias("k")).first()
    auc = BinaryClassificationEvaluator(rawPredictionCol="p_win", labelCol="_y").evaluate(d.withColumn("_y", y)) if r.k == 2 else None
    lift = None if r.precision is None else r.precision - r.base
    return {"n": r.n, "n_taken": r.n_taken, "base_win_rate": r.base, "precision": r.precision, "lift": lift, "auc": auc, "brier": r.brier, "gap": r.gap}


def train(rows: DataFrame, features: list[str], at: str, label: str = "win", weight: str | None = None, qty: str = "signed_qty", threshold: float = 0.55, rounds: int = 20) -> tuple[Policy | None, dict]:
    """A policy fitted on all but the newest three tenths of the rows, and what it is worth on these."""
    past, held = cut(rows.where(F.col(label).isNotNull()), at, TEST)
    policy = fit(past, features, at, label, weight, qty, rounds)
    return policy, {} if policy is None else evaluate(policy.score(held, qty), label, threshold)
