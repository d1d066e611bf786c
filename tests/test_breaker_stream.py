"""The streamed breaker with timers against a fold over all calls, through a crash and a restart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scholarframe.operators.ledger import breaker_step, fresh_breaker
from scholarframe.streaming import breaker


def folded(rows):
    """Every call's answer and every cooldown that ended by the last call of all, one provider after the other."""
    out, last = [], max(at for _, _, at, _ in rows)
    for provider in {p for p, *_ in rows}:
        state, opened = fresh_breaker(), set()
        for _, event, at, ok in sorted((r for r in rows if r[0] == provider), key=lambda r: (r[2], r[1])):
            state, name, allowed = breaker_step(state, at, ok)
            out.append((provider, "call", event, at, name, allowed))
            if state["opened"] is not None:
                opened.add((state["opened"], state["cooldown"]))
        out += [(provider, "half_open", None, o + c, "half_open", None) for o, c in opened if o + c < last]
    return sorted(out, key=str)


@pytest.fixture
def calls(spark):
    rng = random.Random(6)
    rows, at = [], 1_700_000_000_000
    for i in range(240):
        at += rng.choice([1000, 4000, 9000, 45_000])
        rows.append((rng.randint(0, 2), i, at, rng.random() < 0.25))
    rows.append((7, 999, at + 900_000, True))  # moves the watermark past all cooldowns
    return rows


def test_restart_gives_each_row_once(spark, tmp_path, calls):
    schema = "provider_id long, event_id long, at_ms long, ok boolean"
    put = lambda part: spark.createDataFrame(part, schema).withColumn("at", F.timestamp_millis("at_ms")).drop("at_ms").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/calls")
    put(calls[:100])
    source = spark.read.parquet(f"file://{tmp_path}/calls")
    stream = lambda: breaker.breaker_events(spark.readStream.schema(source.schema).parquet(f"file://{tmp_path}/calls"))
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"

    def crash(batch, number):  # writes all it has, and dies before the batch is committed
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream().writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(crash).start().awaitTermination()
    breaker.write_batches(stream(), out, checkpoint).start().awaitTermination()
    put(calls[100:])
    breaker.write_batches(stream(), out, checkpoint).start().awaitTermination()
    breaker.write_batches(stream(), out, checkpoint).start().awaitTermination()
    got = spark.read.parquet(out).select("provider_id", "kind", "event_id", "at_ms", "state", "allowed").collect()
    assert sorted(map(tuple, got), key=str) == folded(calls)
    assert sum(r.kind == "half_open" for r in got) >= 5
