"""The sliding call limit as a stream operator: state is the accepted times of a user inside the window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limited_stream(log: DataFrame, per_window: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """log (user_id, ts, event_id), a stream -> (event_id, user_id, accepted).

    Within a micro-batch a user's calls are folded in time order. Refused calls take no place in the window. State of a user
    is dropped once the watermark is past its window, so state is bounded by per_window times of active users. A call that
    comes later than the watermark allows is judged against what the state still holds.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        calls = pd.concat(list(batches)).sort_values(["at", "event_id"])
        ok = []
        for at in calls["at"].tolist():
            held = [h for h in held if h > at - seconds * 1_000_000]
            ok.append(len(held) < per_window)
            if ok[-1]:
                held.append(at)
        state.update((held,))
        state.setTimeoutTimestamp(max(max(held, default=0) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield calls.assign(user_id=key[0], accepted=ok)[["event_id", "user_id", "accepted"]]

    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("user_id").applyInPandasWithState(fold, "event_id bigint, user_id bigint, accepted boolean", "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def calls_per_window(log: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Calls of each user in tumbling windows, late calls up to the watermark included."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"))
