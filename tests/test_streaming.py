from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from skytab.streaming import live

SCHEMA = "job_id long, status string, at timestamp"


@pytest.fixture
def events(spark, tmp_path):
    t = datetime(2024, 1, 1)
    for k in range(3):
        rows = [(j, s, t + timedelta(minutes=10 * k + j)) for j in range(4) for s in ("QUEUED", "QUEUED", "COMPLETED")]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_job_counts(events):
    got = {(r.start.minute, r.status): r.n for r in drain(live.job_counts(events), "counts", "complete")}
    assert got == {(m, s): n for m in (0, 10, 20) for s, n in (("QUEUED", 8), ("COMPLETED", 4))}


def test_distinct_job_events(events):
    assert len(drain(live.distinct_job_events(events), "jobs")) == 8


def test_rolling_pairs_take_late_rows_in_their_place(spark, tmp_path):
    schema = "track_id long, idx long, at timestamp, east double, north double"
    t = datetime(2024, 1, 1)
    rows = [(k, i, t + timedelta(seconds=i), i * 0.5 + i * i, i * float(k)) for k in (1, 2) for i in range(40)]
    order = sorted(rows, key=lambda r: (r[1] + (r[1] * 7 % 9), r[0]))  # up to eight seconds late
    parts = [order[k : k + 16] for k in range(0, len(order), 16)]
    parts.append([(1, -4, t - timedelta(hours=1), 0.0, 0.0), (3, 0, t + timedelta(minutes=5), 0.0, 0.0)])  # far too late; the clock goes on
    parts.append([(4, 0, t + timedelta(hours=5), 0.0, 0.0)])  # all others are idle
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:02d}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.rolling_pairs(stream).writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = sorted((r.track_id, r.idx, r.d_east, r.d_north) for r in spark.table("pairs").collect())
    assert got == [(k, i, 4.0 + i * i - (i - 8) ** 2, 8.0 * k) for k in (1, 2) for i in range(8, 40, 4)]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) >= 2 and states[-1] <= 1  # tracks 1 to 3 are forgotten
