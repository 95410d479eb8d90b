"""Models and order-dependent operators: numpy per group where built-ins cannot say it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.exposure import sized_qty, vol_target_qty


def none(**types) -> pd.DataFrame:
    """No rows, of these column types."""
    return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in types.items()})


def ols_attribution(rets: DataFrame, factors: DataFrame, window: int = 250, min_points: int = 60) -> DataFrame:
    """(sym, d, factor, beta, contribution): least squares of a symbol's returns on all factors over the last
    `window` dates before its newest one (which is explained, not fitted). One bounded array a symbol."""
    names = [c for c in factors.columns if c != "d"]
    w = Window.partitionBy("sym").orderBy(F.desc("d"))
    rows = rets.join(factors, "d").withColumn("k", F.row_number().over(w)).where(F.col("k") <= window + 1)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        day, past = pdf.iloc[0], pdf.iloc[1:]
        if len(past) < min_points:
            return none(sym=object, d=object, factor=object, beta=float, contribution=float)
        x = np.column_stack([np.ones(len(past)), past[names].to_numpy(float)])
        b = np.linalg.lstsq(x, past["ret"].to_numpy(float), rcond=None)[0]
        return pd.DataFrame({"sym": day["sym"], "d": day["d"], "factor": names, "beta": b[1:], "contribution": b[1:] * day[names].to_numpy(float)})

    return rows.groupBy("sym").applyInPandas(fit, "sym string, d date, factor string, beta double, contribution double")


def fit_regimes(x: np.ndarray, states: int = 3, sticky: float = 0.98, iters: int = 100, tol: float = 1e-5) -> np.ndarray:
    """Most likely states of a Gaussian hidden Markov model with diagonal covariance, started at quantiles of the
    first feature and fitted by expectation maximisation; states ascend with its mean."""
    n = len(x)
    part = np.minimum((np.argsort(np.argsort(x[:, 0], kind="stable")) * states) // n, states - 1)
    mean = np.array([x[part == s].mean(0) for s in range(states)])
    var = np.array([x[part == s].var(0) + 1e-6 for s in range(states)])
    step = np.full((states, states), (1 - sticky) / max(1, states - 1)) + np.eye(states) * (sticky - (1 - sticky) / max(1, states - 1))
    start, last = np.full(states, 1 / states), -np.inf
    density = lambda: -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None] - mean[None]) ** 2 / var[None]).sum(2)
    for _ in range(iters):
        logp = density()
        top = logp.max(1, keepdims=True)
        p = np.exp(logp - top)
        alpha, scale, beta = np.zeros((n, states)), np.zeros(n), np.ones((n, states))
        for t in range(n):
            a = (start if t == 0 else alpha[t - 1] @ step) * p[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = step @ (p[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        xi = (alpha[:-1, :, None] * step[None] * (p[1:] * beta[1:] / scale[1:, None])[:, None, :]).sum(0)
        start, step = gamma[0], xi / xi.sum(1, keepdims=True)
        weight = gamma.sum(0)[:, None]
        mean = gamma.T @ x / weight
        var = np.array([(gamma[:, s, None] * (x - mean[s]) ** 2).sum(0) for s in range(states)]) / weight + 1e-6
        like = float(np.log(scale).sum() + top.sum())
        if like - last < tol:
            break
        last = like
    logp = density()
    with np.errstate(divide="ignore"):
        ls, lt = np.log(start), np.log(step)
    best, back = ls + logp[0], np.zeros((n, states), int)
    for t in range(1, n):
        ways = best[:, None] + lt
        back[t] = ways.argmax(0)
        best = ways.max(0) + logp[t]
    path = np.zeros(n, int)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return np.argsort(np.argsort(mean[:, 0]))[path]


def regimes(series: DataFrame, features: list[str], states: int = 3, min_points: int = 200) -> DataFrame:
    """(key, d, state) of rows (key, d, features): one model a key; keys with fewer points give no rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        if len(pdf) < min_points:
            return none(key=object, d=object, state="int32")
        return pd.DataFrame({"key": pdf["key"], "d": pdf["d"], "state": fit_regimes(pdf[features].to_numpy(float), states)})

    return series.groupBy("key").applyInPandas(run, "key string, d date, state int")


def nearest_earlier(x: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(row, cosine distance) of the nearest of all earlier rows, for each row of unit vectors; -1 and infinity for
    the first one. Of equally near ones the earliest counts. At most block x block distances are held."""
    at, least = np.full(len(x), -1), np.full(len(x), np.inf)
    for lo in range(0, len(x), block):
        own = x[lo : lo + block]
        for a in range(0, lo + 1, block):
            d = 1 - own @ x[a : a + block].T
            if a == lo:
                d[np.triu_indices(len(own))] = np.inf
            k = d.argmin(1)
            best = d[np.arange(len(own)), k]
            nearer = best < least[lo : lo + block]
            at[lo : lo + block][nearer], least[lo : lo + block][nearer] = a + k[nearer], best[nearer]
    return at, least


def stories(vectors: DataFrame, threshold: float = 0.12) -> DataFrame:
    """(bucket, id, story): in order of id, a vector joins the story of the nearest of all earlier ones of its bucket
    if their cosine distance is within the threshold, else it opens one named by its id.

    The rule is sequential, so the bucket (a coarse topic or day) bounds what one task holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        ids, story = pdf["id"].to_numpy(), []
        for i, (at, d) in enumerate(zip(*nearest_earlier(x), strict=True)):
            story.append(story[at] if d <= threshold else int(ids[i]))
        return pd.DataFrame({"bucket": pdf["bucket"], "id": ids, "story": story})

    return vectors.groupBy("bucket").applyInPandas(run, "bucket int, id long, story long")


def evaluation(rows: DataFrame) -> DataFrame:
    """(key, n, sharpe, sortino, profit_factor) of per-trade returns (key, ret); the downside is over losses alone."""
    down = F.sqrt(F.avg(F.when(F.col("ret") < 0, F.pow("ret", 2))))
    gain, loss = F.sum(F.when(F.col("ret") > 0, F.col("ret"))), -F.sum(F.when(F.col("ret") < 0, F.col("ret")))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sharpe"), (F.avg("ret") / F.nullif(down, F.lit(0.0))).alias("sortino"), (gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"))


def calibration(rows: DataFrame) -> DataFrame:
    """(key, n, brier, gap) of (key, y, p)."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))


def position_size(rows: DataFrame, threshold: float = 0.55, target_pct: float = 1.0, most: int = 5, ref: float = 0.7) -> DataFrame:
    """rows (p_win, equity, risk) with qty, by the rule of exposure.sized()."""
    base = vol_target_qty(F.col("equity"), F.col("risk"), target_pct, most)
    return rows.withColumn("qty", F.coalesce(sized_qty(base, F.col("p_win"), threshold, most, ref), F.lit(0)))


def purged_folds(labels: DataFrame, splits: int = 5, embargo: int = 0) -> DataFrame:
    """(sym, fold, i, part) of labels (sym, i, start, end): contiguous test parts of each symbol by i; training rows
    whose life meets the test part's span (plus embargo) are left out. One row a fold joins every label of its symbol,
    no interval pairs."""
    n = labels.groupBy("sym").agg((F.max("i") + 1).alias("n"))
    d = labels.join(n, "sym").withColumn("own", F.floor(F.col("i") * splits / F.col("n")).cast("int"))
    span = d.groupBy("sym", F.col("own").alias("fold")).agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    x = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).join(span, ["sym", "fold"])
    part = F.when(F.col("own") == F.col("fold"), "test").when((F.col("end") < F.col("lo")) | (F.col("start") > F.col("hi") + embargo), "train")
    return x.select("sym", "fold", "i", part.alias("part")).where("part is not null")


def shift_back(levels: DataFrame, k: int = 2) -> DataFrame:
    """levels (sym, d, close) with the value k own positions later, the tail filled with the last one."""
    w = Window.partitionBy("sym").orderBy("d")
    end = F.last("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("shifted", F.coalesce(F.lead("close", k).over(w), end))


def peer_returns(rets: DataFrame, coverage: float = 0.6) -> DataFrame:
    """(d, ret, n): mean return of the symbols on dates where at least ceil(coverage * all) have one."""
    need = rets.agg(F.ceil(F.count_distinct("sym") * F.lit(coverage)).alias("need"))
    d = rets.groupBy("d").agg(F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("n"))
    return d.join(F.broadcast(need)).where("n >= need").drop("need")


def drift(runs: DataFrame, tolerance: float = 0.15, least: int = 3) -> DataFrame:
    """runs (key, at, value) with drifted: a fall of more than the tolerance below the mean of all runs before."""
    w = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    mean, n = F.avg("value").over(w), F.count("value").over(w)
    return runs.withColumn("drifted", F.coalesce((n >= least) & (mean > 0) & (F.col("value") < (1 - tolerance) * mean), F.lit(False)))


def exposure(positions: DataFrame, specs: DataFrame) -> DataFrame:
    """(gross, net) notional of positions (code, qty, price) by specs (code, tick, tick_value)."""
    d = positions.join(specs, "code").select((F.col("qty") * F.col("price") / F.col("tick") * F.col("tick_value")).alias("x"))
    return d.agg(F.sum(F.abs("x")).alias("gross"), F.sum("x").alias("net"))


def term_slope(quotes: DataFrame) -> DataFrame:
    """(ts, slope_pct): next over front contract less 1, of the two nearest expiries per ts."""
    w = Window.partitionBy("ts").orderBy("expiry", "contract")
    d = quotes.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("ts")
    d = d.agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("b"))
    return d.where("b is not null and a <> 0").select("ts", ((F.col("b") / F.col("a") - 1) * 100).alias("slope_pct"))


def upcoming(events: DataFrame, today: str, days: int) -> DataFrame:
    day = F.lit(today).cast("date")
    return events.where(F.col("d").between(day, F.date_add(day, days))).withColumn("days_left", F.datediff("d", day))
