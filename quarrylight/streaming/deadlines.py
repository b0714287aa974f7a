"""What became of each source that was started: a state for each source with a timer at its deadline."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: seconds that a source has.
DEADLINE = 45


def outcomes(events: DataFrame, seconds: float = DEADLINE, late: str = "10 minutes", source: str = "source", phase: str = "phase", time: str = "time", order: str = "n") -> DataFrame:
    """(source, started, status, seconds) of a stream of events, one row for each start and for each end without one.

    ``phase`` is start, done or failed; other events are left out. A start is ``done`` or ``failed`` by an end of its source
    within the deadline, ``restarted`` by another start within it, else ``timed_out``: at once if a later event of its source is
    seen, or as soon as the watermark (the latest time less ``late``) passes the deadline. An end that no open start precedes is
    ``unmatched``. Events of a micro-batch are taken by time, then ``order``; events behind the watermark are late and dropped.
    """
    limit = int(seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        opened = state.get[0] if state.exists else None

        def told(start: int | None, status: str, took: int | None) -> None:
            out.append((key[0], None if start is None else pd.Timestamp(start, unit="us"), status, None if took is None else took / 1e6))

        if state.hasTimedOut:
            told(opened, "timed_out", limit)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "n"], kind="stable")
            for at, what in zip(rows["at"].tolist(), rows["phase"].tolist(), strict=True):
                if opened is not None and at - opened > limit:
                    told(opened, "timed_out", limit)
                    opened = None
                if what == "start":
                    if opened is not None:
                        told(opened, "restarted", at - opened)
                    opened = at
                elif opened is None:
                    told(None, "unmatched", None)
                else:
                    told(opened, what, at - opened)
                    opened = None
            ends = None if opened is None else (opened + limit) // 1000 + 1
            if ends is not None and ends <= state.getCurrentWatermarkMs():
                told(opened, "timed_out", limit)
                opened = None
            if opened is None:
                if state.exists:
                    state.remove()
            else:
                state.update((opened,))
                state.setTimeoutTimestamp(ends)
        yield pd.DataFrame(out, columns=["source", "started", "status", "seconds"]).astype({"seconds": "float64"})

    own = events.where(F.col(phase).isin("start", "done", "failed")).select(F.col(source).alias("source"), F.col(phase).alias("phase"), F.col(time).cast("timestamp").alias("time"), F.col(order).alias("n"))
    own = own.withWatermark("time", late).withColumn("at", F.unix_micros("time"))
    kind = own.schema["source"].dataType.simpleString()
    return own.groupBy("source").applyInPandasWithState(step, f"source {kind}, started timestamp, status string, seconds double", "opened long", "append", GroupStateTimeout.EventTimeTimeout)
