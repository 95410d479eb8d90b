"""Windowed stories against plain loops, and the stream against the batch, rows out of order included."""

import math
import random
from datetime import datetime, timedelta

from tessera.operators import story
from tessera.streaming import stories

T = datetime(2024, 1, 1)
SCHEMA = "bucket long, id long, ts timestamp, v array<double>"


def made(n=160):
    rnd = random.Random(9)
    rows, centres = [], [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    for i in range(n):
        c = rnd.choice(centres)
        rows.append((i % 2, i, T + timedelta(hours=3 * i, minutes=rnd.randrange(50)), [x + rnd.gauss(0, 0.12) for x in c]))
    return rows


def plain(rows, hours, distance):
    out = {}
    for b in {r[0] for r in rows}:
        seen = []
        for _, i, t, v in sorted((r for r in rows if r[0] == b), key=lambda r: (r[2], r[1])):
            norm = math.sqrt(sum(x * x for x in v))
            best = None
            for s, u, w, m in seen:
                if u >= t - timedelta(hours=hours):
                    d = 1 - sum(x * y for x, y in zip(v, w, strict=True)) / norm / m
                    if best is None or d < best[0]:
                        best = (d, s)
            mine = best[1] if best and best[0] <= distance else i
            seen.append((mine, t, v, norm))
            out[b, i] = mine
    return out


def test_windowed_equals_loops(spark):
    rows = made()
    extra = [(0, 900, T, None), (0, 901, None, [1.0] * 6), (0, None, T, [1.0] * 6), (None, 902, T, [1.0] * 6), (0, 903, T, [0.0] * 6)]
    for hours in (72, 12):
        got = {(r.bucket, r.id): r.story for r in story.windowed(spark.createDataFrame(rows + extra, SCHEMA), hours, 0.05).collect()}
        want = plain(rows, hours, 0.05)
        assert got == want and 5 < len(set(want.values())) < len(want)
    assert story.windowed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    rows = made()
    folder = tmp_path / "in"
    rnd = random.Random(1)
    for k in range(0, len(rows), 40):  # rows within a file in any order; each file begins with some that are late, but within the delay
        part = rows[k : k + 40]
        if k:
            part = rows[k - 2 : k] + part
        if k + 40 < len(rows):
            part = part[:-2]
        rnd.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    end = T + timedelta(days=90)
    for k in range(2):
        spark.createDataFrame([(b, 5000 + 10 * k + b, end + timedelta(days=9 * k), [1.0, *[0.0] * 5]) for b in (0, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = stories.online(source, hours=24, distance=0.05, late="12 hours").writeStream.format("memory").queryName("st").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = [(r.bucket, r.id, r.story) for r in spark.table("st").collect() if r.id < 5000]
    assert len(got) == len(set(got)) == len(rows)
    assert {(b, i): s for b, i, s in got} == plain(rows, 24, 0.05)
