"""Stories in a window of time: an article joins the story of the nearest one of the hours before it, or opens one."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera import session

HOURS, DISTANCE = 72, 0.12


def unit(v) -> np.ndarray | None:
    """The vector at length 1; None for one that is null, zero or not finite."""
    x = np.asarray(v, np.float64) if v is not None else np.zeros(0)
    n = float(np.linalg.norm(x)) if len(x) else 0.0
    return x / n if n > 0 and np.isfinite(n) else None


class Context:
    """The articles of the last hours, in order of time: (time in microseconds, story, vector)."""

    def __init__(self, rows=(), hours: float = HOURS, distance: float = DISTANCE):
        self.rows = deque(rows)
        self.span, self.distance = int(hours * 3_600_000_000), distance

    def place(self, id: int, ts: int, v: np.ndarray) -> int:
        """The story of the next article: that of the nearest vector that is not older than the window, the earliest of equally near
        ones, if within the distance; else its own id."""
        while self.rows and self.rows[0][0] < ts - self.span:
            self.rows.popleft()
        story = id
        if self.rows:
            d = 1 - np.stack([r[2] for r in self.rows]) @ v
            k = int(d.argmin())
            story = self.rows[k][1] if d[k] <= self.distance else id
        self.rows.append((ts, story, v))
        return story


def ordered(ids, ts, vs) -> list[tuple[int, int, np.ndarray]]:
    """(ts, id, vector) of the articles that can be placed, by time, then id."""
    rows = [(int(t), int(i), unit(v)) for i, t, v in zip(ids, ts, vs, strict=True) if not pd.isna(i) and not pd.isna(t)]
    return sorted((r for r in rows if r[2] is not None), key=lambda r: r[:2])


def windowed(vectors: DataFrame, hours: float = HOURS, distance: float = DISTANCE) -> DataFrame:
    """(bucket, id, story) of vectors (bucket, id, ts, v), placed one after the other by time (then id) within their bucket.

    A null id, time or bucket, and a null, zero or infinite vector, take no part. The rule depends on the order, so a bucket is one task's
    work: its memory holds the bucket's rows, its time grows with the rows of a window for each row."""
    session.ship(vectors.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = Context(hours=hours, distance=distance)
        rows = [(i, at.place(i, t, v)) for t, i, v in ordered(pdf["id"], pdf["us"], pdf["v"])]
        out = pd.DataFrame(rows, columns=["id", "story"]).astype("int64")
        return out.assign(bucket=pdf["bucket"].iloc[0])[["bucket", "id", "story"]]

    d = vectors.where("bucket is not null and id is not null and ts is not null").selectExpr("cast(bucket as long) as bucket", "cast(id as long) as id", "unix_micros(cast(ts as timestamp)) as us", "v")
    return d.groupBy("bucket").applyInPandas(run, "bucket long, id long, story long")
