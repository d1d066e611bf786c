"""Structured Streaming variants: hourly health with a watermark, and the breaker as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholarframe.operators.ledger import breaker_step, fresh_breaker


def hourly_health(snapshots: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly buckets of a stream of snapshots; a bucket is emitted once the watermark has passed it."""
    return (
        snapshots.withWatermark("recorded_at", late)
        .groupBy("provider_id", F.window("recorded_at", "1 hour").alias("w"))
        .agg(F.count("*").alias("snapshot_count"), F.count_if(F.col("health") == "up").alias("up_count"), F.count_if(F.col("health") == "down").alias("down_count"), F.avg("latency_ms").alias("avg_latency_ms"))
        .select("provider_id", F.col("w.start").alias("bucket_start"), "snapshot_count", "up_count", "down_count", "avg_latency_ms")
    )


def breaker_states(calls: DataFrame) -> DataFrame:
    """(provider_id, event_id, state, allowed) of each call of a stream; the state is the breaker's own few fields."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            name, failed, last, cooldown, opened = state.get
            at = {"name": name, "failed": failed, "last": [c == "1" for c in last], "cooldown": cooldown, "opened": None if opened < 0 else opened}
        else:
            at = fresh_breaker()
        rows = pd.concat(list(frames)).sort_values(["at_ms", "event_id"])
        out = []
        for event, at_ms, ok in zip(rows["event_id"], rows["at_ms"], rows["ok"], strict=True):
            at, name, allowed = breaker_step(at, int(at_ms), bool(ok))
            out.append((key[0], event, name, allowed))
        state.update((at["name"], at["failed"], "".join("1" if x else "0" for x in at["last"]), at["cooldown"], -1 if at["opened"] is None else at["opened"]))
        yield pd.DataFrame(out, columns=["provider_id", "event_id", "state", "allowed"])

    return calls.groupBy("provider_id").applyInPandasWithState(run, "provider_id long, event_id long, state string, allowed boolean", "name string, failed int, last string, cooldown long, opened long", "append", GroupStateTimeout.NoTimeout)
