"""Per-key expiry in a stream: the last value of each key, and an event when it runs out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def expiring_keys(sets: DataFrame, ttl_ms: int, delay: str = "0 seconds") -> DataFrame:
    """(key, value, state) of a stream of (key, value, ts): `live` on a set, `expired` once
    the watermark passes its time plus ttl_ms. A late set does not replace a newer one."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            value = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "state": ["expired"]})
            return
        best = state.get if state.exists else (None, -1)
        for pdf in frames:
            row = pdf.loc[pdf["ts_ms"].idxmax()]
            if int(row["ts_ms"]) >= best[1]:
                best = (row["value"], int(row["ts_ms"]))
        state.update(best)
        state.setTimeoutTimestamp(max(best[1] + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "value": [best[0]], "state": ["live"]})

    timed = sets.withWatermark("ts", delay).select("key", "value", "ts", F.unix_millis("ts").alias("ts_ms"))
    return timed.groupBy("key").applyInPandasWithState(step, "key string, value string, state string", "value string, ts_ms long", "append", GroupStateTimeout.EventTimeTimeout)
