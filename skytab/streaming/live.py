"""Streaming forms: job states as events arrive, and a rolling buffer over telemetry rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_job_events(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Job events (job_id, status, at) without repeats; state is dropped behind the watermark."""
    return events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["job_id", "status"])


def job_counts(events: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Events by status and window of time; late events within the watermark still count."""
    counted = events.withWatermark("at", lateness).groupBy(F.window("at", window), "status").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "status", "n")


def rolling_pairs(rows: DataFrame, stride: int = 4, gap: int = 8, lateness: str = "10 seconds", idle: str = "1 hour") -> DataFrame:
    """Rows (track_id, idx, at, east, north), in any order that the watermark allows, to every stride-th one with its displacement
    since ``gap`` rows before: track_id, idx, d_east, d_north.

    A row waits until the watermark (``lateness`` behind the latest at) has passed it, so that rows that come late, within
    that time, take their place by idx; later ones are dropped. ``at`` grows with idx along a track. State: the rows that
    wait and the last gap of a track; it goes when the watermark is ``idle`` beyond the track's last row.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    keep = int(pd.Timedelta(idle).total_seconds() * 1000)
    columns = ["idx", "ms", "east", "north"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = ([list(zip(*part)) for part in (state.get[:4], state.get[4:])]) if state.exists else ([], [])
        if not state.hasTimedOut:
            for new in batches:
                waiting += list(new.assign(ms=new["at"].astype("datetime64[ms]").astype("int64"))[columns].itertuples(index=False, name=None))
        mark = state.getCurrentWatermarkMs()
        ready = sorted(r for r in waiting if r[1] <= mark)
        waiting, out = sorted(r for r in waiting if r[1] > mark), []
        for row in ready:
            held = [*held, row][-(gap + 1) :]
            if len(held) == gap + 1 and row[0] % stride == 0:
                out.append((key[0], int(row[0]), held[-1][2] - held[0][2], held[-1][3] - held[0][3]))
        last = max((r[1] for r in (*held, *waiting)), default=mark)
        if state.hasTimedOut and not waiting and mark >= last + keep:
            state.remove()
        else:
            part = lambda rows: tuple(map(list, zip(*rows))) if rows else ([], [], [], [])
            state.update((*part(held), *part(waiting)))
            state.setTimeoutTimestamp(max(mark + 1, waiting[0][1] if waiting else last + keep))
        yield pd.DataFrame(out, columns=["track_id", "idx", "d_east", "d_north"])

    kinds = ("long", "long", "double", "double")
    held = ", ".join(f"{side}_{c} array<{k}>" for side in ("held", "waiting") for c, k in zip(columns, kinds))
    timed = rows.withWatermark("at", lateness)
    return timed.groupBy("track_id").applyInPandasWithState(step, "track_id long, idx long, d_east double, d_north double", held, "append", GroupStateTimeout.EventTimeTimeout)
