"""Stories over a stream: the windowed rule, with state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import session
from tessera.operators.story import DISTANCE, HOURS, Context, ordered

STATE = "us array<long>, story array<long>, vs array<array<double>>, wait_us array<long>, wait_id array<long>, wait_vs array<array<double>>"


def online(vectors: DataFrame, hours: float = HOURS, distance: float = DISTANCE, late: str = "1 hour") -> DataFrame:
    """(bucket, id, ts, story) of a stream of vectors (bucket, id, ts, v), each once.

    A row waits in the state until the watermark (`late` behind the newest time seen) has passed it: rows that come in any order within that
    delay are placed in order of time, so the result is that of story.windowed() over the same rows. Rows later than that are
    dropped by Spark. State is a bucket's waiting rows and the vectors of its last hours; what is older goes, and an idle bucket's state with it."""
    session.ship(vectors.sparkSession)
    span = int(hours * 3_600_000_000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, story, vs, wait_us, wait_id, wait_vs = (list(x) for x in state.get) if state.exists else ([], [], [], [], [], [])
        for b in batches:
            wait_us += [int(x) for x in b["us"]]
            wait_id += [int(x) for x in b["id"]]
            wait_vs += list(b["v"])
        mark = state.getCurrentWatermarkMs() * 1000
        rows = ordered(wait_id, wait_us, wait_vs)
        due = [r for r in rows if r[0] <= mark]
        left = rows[len(due) :]
        at = Context([(t, s, np.asarray(v)) for t, s, v in zip(us, story, vs, strict=True)], hours, distance)
        found = [(i, t, at.place(i, t, v)) for t, i, v in due]
        keep = [r for r in at.rows if r[0] >= mark - span]
        if keep or left:
            state.update(([r[0] for r in keep], [r[1] for r in keep], [r[2].tolist() for r in keep], [r[0] for r in left], [r[1] for r in left], [r[2].tolist() for r in left]))
            # called again when the first waiting row is due, else when the last vector is too old
            next_us = left[0][0] if left else keep[-1][0] + span
            state.setTimeoutTimestamp(max(next_us // 1000 + 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        if found:
            out = pd.DataFrame(found, columns=["id", "us", "story"]).astype("int64")
            yield out.assign(bucket=key[0])[["bucket", "id", "us", "story"]]

    d = vectors.where("bucket is not null and id is not null and ts is not null and v is not null").withWatermark("ts", late)
    d = d.select(F.col("bucket").cast("long").alias("bucket"), F.col("id").cast("long").alias("id"), "ts", F.unix_micros("ts").alias("us"), F.col("v").cast("array<double>").alias("v"))
    out = d.groupBy("bucket").applyInPandasWithState(run, "bucket long, id long, us long, story long", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("bucket", "id", F.timestamp_micros("us").alias("ts"), "story")
