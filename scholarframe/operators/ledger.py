"""Usage ledger, grants, capacity sources and source health: running balances, schedules, state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.text import publication_credit
from scholarframe.plans.tables import numbered


def running_balance(events: DataFrame, user: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """events with balance and applied delta, where no balance falls below zero.

    With S the running sum, the clamped balance is S - min(0, smallest S so far): two running windows over
    one sort, no fold."""
    w = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = Window.partitionBy(user).orderBy(*order)
    summed = events.withColumn("s", F.sum("delta").over(w))
    balanced = summed.withColumn("balance", F.col("s") - F.least(F.lit(0), F.min("s").over(w))).drop("s")
    return balanced.withColumn("applied", F.col("balance") - F.coalesce(F.lag("balance").over(at), F.lit(0)))


def once(events: DataFrame, key: str, user: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The first event of each user and idempotency key; events without a key all stay."""
    first = Window.partitionBy(user, key).orderBy(*order)
    keyed = events.where(F.col(key).isNotNull()).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    return keyed.unionByName(events.where(F.col(key).isNull()))


def diminishing_grants(items: DataFrame, threshold: int, base: int, user: str, order: str) -> DataFrame:
    """items with the credit of each: `base` up to the threshold, then half as much again and again."""
    index = F.row_number().over(Window.partitionBy(user).orderBy(order)) - threshold
    return items.withColumn("credit", publication_credit(index, base))


def contribution_grants(items: DataFrame, granted: DataFrame, threshold: int, base: int, review: int) -> DataFrame:
    """(user_id, key, kind, credit): what contributions earn that have earned nothing yet.

    items has user_id, kind (publication or peer_review), id and ord; granted has user_id and key.  Publications earn `base` up to the threshold
    and then half as much again and again; those granted before count on, in their place if they are listed again, and before all others if they
    are not, so that batches earn what one run over all would.  Reviews earn `review` each and don't count.  An id listed twice earns once
    and takes two places in that run; a later batch counts what was granted."""
    publication = F.col("kind") == "publication"
    told = items.withColumn("key", F.concat(F.when(publication, "work:").otherwise("review:"), F.col("id")))
    unlisted = granted.where(F.col("key").startswith("work:")).select("user_id", "key").distinct().join(told, ["user_id", "key"], "left_anti").groupBy("user_id").agg(F.count("*").alias("before"))
    place = F.row_number().over(Window.partitionBy("user_id", "kind").orderBy("ord", "id"))
    times = F.row_number().over(Window.partitionBy("user_id", "key").orderBy("ord", "id"))
    placed = told.withColumn("place", place).withColumn("times", times).where("times = 1").join(granted.select("user_id", "key"), ["user_id", "key"], "left_anti").join(unlisted, "user_id", "left")
    index = F.coalesce("before", F.lit(0)) + F.col("place") - threshold
    return placed.select("user_id", "key", "kind", F.when(publication, publication_credit(index, base)).otherwise(review).cast("long").alias("credit"))


def within_schedule(hours: Column, days: Column, now: Column) -> Column:
    """Whether `now` (UTC) lies in an HH:MM-HH:MM window, which may pass midnight, of one of the ISO weekdays.

    The part after midnight belongs to the day on which the window opened.  A malformed or empty window or
    day list restricts nothing."""
    valid = hours.rlike(r"^\s*([01]\d|2[0-3]):[0-5]\d-([01]\d|2[0-3]):[0-5]\d\s*$")
    part = lambda k: F.regexp_extract(hours, r"(\d\d):(\d\d)-(\d\d):(\d\d)", k).try_cast("int")
    start, end = part(1) * 60 + part(2), part(3) * 60 + part(4)
    limited = F.coalesce(valid & (start != end), F.lit(False))
    minute = F.hour(now) * 60 + F.minute(now)
    wraps = end < start
    is_open = F.when(wraps, (minute >= start) | (minute < end)).otherwise((minute >= start) & (minute < end))
    opened = F.when(limited & wraps & (minute < end), F.date_sub(now, 1)).otherwise(F.to_date(now))
    listed = F.filter(F.transform(F.split(days, ","), lambda d: F.trim(d).try_cast("int")), lambda d: d.between(1, 7))
    on_day = F.coalesce((F.size(listed) == 0) | F.array_contains(listed, F.weekday(opened) + 1), F.lit(True))
    return F.when(limited, is_open & on_day).otherwise(on_day)


def rank_sources(sources: DataFrame, now: Column, preference: list[str], sponsor_eligible: bool = True) -> DataFrame:
    """Sources that may serve now, sponsored ones first, then by the order of preference."""
    rolled = F.date_trunc("month", F.col("period_starts_at")) < F.date_trunc("month", now)
    able = (F.col("status") != "disabled") & F.col("credential_ref").isNotNull() & ~F.coalesce(F.col("dormant_until") > now, F.lit(False))
    able = able & within_schedule(F.col("active_hours_utc"), F.col("active_days"), now)
    able = able & ((F.col("status") != "exhausted") | rolled)
    able = able & (F.col("monthly_token_cap").isNull() | rolled | (F.col("tokens_used_period") < F.col("monthly_token_cap")))
    if not sponsor_eligible:
        able = able & F.col("sponsor_name").isNull()
    place = F.array_position(F.array(*map(F.lit, preference)), F.col("provider_id"))
    place = F.when(place == 0, len(preference) + 1).otherwise(place).cast("int")
    return numbered(sources.where(able).withColumn("sponsored", F.col("sponsor_name").isNotNull().cast("int")).withColumn("place", place), "rank", F.col("sponsored").desc(), F.col("place"), F.col("id"))


def remaining_tokens(now: Column) -> Column:
    """What a source may still spend this month; null without a cap."""
    rolled = F.date_trunc("month", F.col("period_starts_at")) < F.date_trunc("month", now)
    return F.col("monthly_token_cap") - F.when(rolled, 0).otherwise(F.col("tokens_used_period"))


def fails_over(status: Column) -> Column:
    return F.coalesce((status >= 500) | status.isin(401, 402, 403, 429), F.lit(True))


def dormancy_seconds(status: Column) -> Column:
    return F.when(status == 429, 300).when(status.isin(401, 402, 403), 21600).otherwise(0)


def hourly_health(snapshots: DataFrame) -> DataFrame:
    """Per provider and hour: snapshots, up, down, uptime percent and mean latency."""
    return (
        snapshots.groupBy("provider_id", F.date_trunc("hour", "recorded_at").alias("bucket_start"))
        .agg(F.count("*").alias("snapshot_count"), F.count_if(F.col("health") == "up").alias("up_count"), F.count_if(F.col("health") == "down").alias("down_count"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"))
        .withColumn("uptime_percent", F.round(F.col("up_count") / F.col("snapshot_count") * 100, 6))
    )


def rolling_latency(snapshots: DataFrame, order: tuple[str, ...], size: int = 20) -> DataFrame:
    w = Window.partitionBy("provider_id").orderBy(*order).rowsBetween(1 - size, 0)
    return snapshots.withColumn("rolling_ms", F.round(F.avg("latency_ms").over(w), 6))


def failure_runs(calls: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """calls with the number of failures in a row up to each, and failures among the last ten."""
    w = Window.partitionBy("provider_id").orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    island = calls.withColumn("island", F.count_if("ok").over(so_far))
    run = Window.partitionBy("provider_id", "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("consecutive", F.count_if(~F.col("ok")).over(run)).withColumn("failed_of_10", F.count_if(~F.col("ok")).over(w.rowsBetween(-9, 0))).drop("island")


#: Fixed values of the breaker: failures in a row, window, rate, first and longest cooldown in milliseconds.
BREAKER = (5, 10, 0.8, 30_000, 300_000)


def breaker_step(state: dict, at_ms: int, ok: bool) -> tuple[dict, str, bool]:
    """One call at `at_ms`: the new state, its name, and whether the call was let through."""
    row, window, rate, first, longest = BREAKER
    s = dict(state)
    if s["name"] == "open":
        if at_ms - s["opened"] < s["cooldown"]:
            return s, "open", False
        if ok:
            return fresh_breaker(), "closed", True
        s |= {"opened": at_ms, "cooldown": min(2 * s["cooldown"], longest)}
        return s, "open", True
    s["failed"] = 0 if ok else s["failed"] + 1
    s["last"] = (s["last"] + [ok])[-window:]
    if not ok and (s["failed"] >= row or (len(s["last"]) >= window and s["last"].count(False) / len(s["last"]) >= rate)):
        s |= {"name": "open", "opened": at_ms}
    return s, s["name"], True


def fresh_breaker() -> dict:
    return {"name": "closed", "failed": 0, "last": [], "cooldown": BREAKER[3], "opened": None}


def breaker_states(calls: DataFrame) -> DataFrame:
    """(provider_id, event_id, state, allowed) of each call; calls has provider_id, event_id, at_ms, ok.

    Rows of a provider stream through one task in time order, sorted and spilled by Spark; only the
    machine's state is held."""
    import pyarrow as pa

    def run(batches):
        states: dict[int, dict] = {}
        for batch in batches:
            names, allowed = [], []
            for provider, at_ms, ok in zip(*(batch.column(c).to_pylist() for c in ("provider_id", "at_ms", "ok")), strict=True):
                states[provider], name, let_in = breaker_step(states.get(provider) or fresh_breaker(), at_ms, ok)
                names.append(name)
                allowed.append(let_in)
            yield pa.record_batch([batch.column("provider_id"), batch.column("event_id"), pa.array(names, pa.string()), pa.array(allowed, pa.bool_())], ["provider_id", "event_id", "state", "allowed"])

    dealt = calls.select("provider_id", "event_id", "at_ms", "ok").repartition("provider_id").sortWithinPartitions("provider_id", "at_ms", "event_id")
    return dealt.mapInArrow(run, "provider_id long, event_id long, state string, allowed boolean")
