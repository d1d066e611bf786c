"""The circuit breaker as state with event-time timers, and a sink that a repeated batch doesn't double.

A provider's calls arrive as a stream.  Each call is answered by the breaker as it stands; an open breaker sets a timer for the end of its
cooldown, and becomes half-open there even if no call comes.  The state of a provider that is never called again goes once its
timer has fired and its time to live has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scholarframe.operators.ledger import breaker_step, fresh_breaker

OUT = "provider_id long, kind string, event_id long, at_ms long, state string, allowed boolean"
_STATE = "name string, failed int, last string, cooldown long, opened long, ended boolean"
#: Calls of a batch that are objects at a time, and rows that are returned at once.
SLICE = 10_000
#: What `transformWithState` keeps its state in.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Breaker(StatefulProcessor):
    """One provider's breaker: rows of kind `call` for each call, and of kind `half_open` for the end of each cooldown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", _STATE)

    def _read(self) -> tuple[dict, bool]:
        if not self.state.exists():
            return fresh_breaker(), True
        name, failed, last, cooldown, opened, ended = self.state.get()
        return {"name": name, "failed": failed, "last": [c == "1" for c in last], "cooldown": cooldown, "opened": None if opened < 0 else opened}, ended

    def _write(self, at: dict, ended: bool) -> None:
        self.state.update((at["name"], at["failed"], "".join("1" if x else "0" for x in at["last"]), at["cooldown"], -1 if at["opened"] is None else at["opened"], ended))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at, ended = self._read()
        before = None if ended else at["opened"] + at["cooldown"]
        out = []
        for event, at_ms, ok in _in_order(rows):
            if len(out) >= SLICE:
                yield _rows(out)
                out = []
            if not ended and at_ms >= at["opened"] + at["cooldown"]:  # the cooldown is over before its timer was due
                out.append((key[0], "half_open", None, at["opened"] + at["cooldown"], "half_open", None))
                ended = True
            opened = at["opened"]
            at, name, allowed = breaker_step(at, at_ms, ok)
            if at["opened"] != opened and at["opened"] is not None:
                ended = False
            out.append((key[0], "call", event, at_ms, name, allowed))
        after = None if ended else at["opened"] + at["cooldown"]
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        self._write(at, ended)
        yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at, ended = self._read()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if not ended and due == at["opened"] + at["cooldown"]:
            self._write(at, True)
            yield _rows([(key[0], "half_open", None, due, "half_open", None)])

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, bool]]:
    """The calls of a batch as (event_id, at_ms, ok) by time: held as arrays, seventeen bytes a call, and made into objects a slice at a time."""
    parts = [(r["event_id"].to_numpy(np.int64), r["at_ms"].to_numpy(np.int64), r["ok"].to_numpy(bool)) for r in rows]
    event, at_ms, ok = (np.concatenate(p) for p in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort((event, at_ms))
    for start in range(0, len(order), SLICE):
        own = order[start : start + SLICE]
        yield from zip(event[own].tolist(), at_ms[own].tolist(), ok[own].tolist(), strict=True)


def _rows(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["provider_id", "kind", "event_id", "at_ms", "state", "allowed"])
    return frame.astype({"event_id": "Int64", "allowed": "boolean"})


def breaker_events(calls: DataFrame, late: str = "0 seconds") -> DataFrame:
    """OUT's rows for a stream of calls (provider_id, event_id, at timestamp, ok).

    A cooldown that ended is reported by the first later call of its provider, or once the watermark has passed its end."""
    from pyspark.sql import functions as F

    calls.sparkSession.conf.set(*STORE)
    named = calls.select("provider_id", "event_id", "at", F.unix_millis("at").alias("at_ms"), "ok").withWatermark("at", late)
    return named.groupBy("provider_id").transformWithStateInPandas(Breaker(), OUT, "Append", "eventTime")


def write_batches(stream: DataFrame, folder: str, checkpoint: str):  # noqa: ANN201
    """A writer of each batch into a folder of its own, in place of what an attempt before has left there: what is read from
    `folder` has every row once, however often a batch is run."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put)
