"""Calls dealt to ranked capacity sources: fail-over from source to source, and caps that fill up."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.text import let
from scholarframe.operators.ledger import fails_over
from scholarframe.plans.tables import settle

#: Ranks that one round decides, calls that make a step of a pool's queue, and calls of a pool that one task goes through.
RANKS, STEP, CHUNK = 512, 4096, 32768
#: Calls of a pool that one task goes through where statuses follow from kinds.
LONG_CHUNK = 1 << 18
CALL = ("call_id", "pool", "tokens", "at", "step", "attempts", "last_status")
_WENT = "call_id {call}, pool {pool}, tokens long, at long, step long, attempts int, last_status int, outcome string, place int, left long"


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """rows in ranges of the order, settled, with the number of each one's range in `_range`."""
    return settle(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, group: str, order: tuple[str, ...], value: Column) -> DataFrame:
    """dealt rows with `before`, the sum of `value` over the earlier rows of their group.

    Each range is summed for itself, after the sums of the ranges before; so a group with a third of all rows is no single task."""
    sums = rows.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    so_far = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(group, "_range", F.sum("_sum").over(so_far).alias("_earlier"))
    inside = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce("_earlier", F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return rows.join(earlier, [group, "_range"], "left").withColumn("before", before).drop("_earlier")


def ranked_in_pools(sources: DataFrame) -> DataFrame:
    """(pool, source_id, rank, remaining): each pool's sources numbered from 1 in the order of their `rank` over all pools."""
    placed = running(dealt(sources.select("pool", "source_id", "rank", "remaining"), "pool", "rank"), "pool", ("rank",), F.lit(1))
    return placed.select("pool", "source_id", (F.col("before") + 1).cast("int").alias("rank"), "remaining")


def dispatch(calls: DataFrame, sources: DataFrame, status: Callable[[Column, Column], Column]) -> DataFrame:
    """(call_id, pool, source_id, outcome, attempts, status) of each call, as if all were made one after the other in the order of ord and call_id.

    calls has call_id, pool, ord and tokens; sources has pool, source_id, rank (from 1, without gaps) and remaining tokens (null: no cap).
    status(call_id, source_id) is the status of an attempt; below 400 it succeeds, null is no answer.  A call tries its pool's sources in rank
    order, but for those whose remaining tokens are used up; the call that uses up the last ones is still served whole.  A failure that
    another source may mend moves it on, any other ends it.  outcome is served or error, by source_id, or fallback if no source is left.

    A round takes RANKS ranks at once.  Sources with a cap are used up by a short stretch of the pool's queue: its next CHUNK calls are gone through one by
    one.  Later calls then only meet sources that are left; they are all sent on as if none of those was used up, which holds if what they spend is
    less than what each has left, and otherwise the next stretch is gone through.  Calls that meet no open source of the round stay where
    they are.  Rounds end with the last call.  A null pool has no sources, null or negative tokens are 0, repeated rows are calls of their
    own, empty tables give no rows or fallbacks only; other columns are ignored.
    """
    queue = _queued(calls)
    queue = queue.select("*", F.lit(0).alias("attempts"), F.lit(None).cast("int").alias("last_status"))
    places = settle(sources.select("pool", "source_id", "rank", F.col("remaining").cast("long").alias("left")), "sources")
    kind = places.schema["source_id"].dataType
    schema = _WENT.format(call=dict(queue.dtypes)["call_id"], pool=dict(queue.dtypes)["pool"])
    decided, touched, start = [], queue.limit(0), queue.select("pool", F.lit(0).cast("long").alias("start")).limit(0)
    for first in range(1, (places.agg(F.max("rank")).first()[0] or 0) + 1, RANKS):
        waiting = touched.unionByName(queue.join(start, "pool", "left").where(F.col("step") >= F.coalesce("start", F.lit(0))).select(*CALL))
        here = _listed(places.where(F.col("rank").between(first, first + RANKS - 1)), "rank")
        went, fate = _round(waiting, here, status, schema)
        ended = [w.where("outcome <> 'pending'").select("call_id", "pool", F.col("source_id").cast(kind).alias("source_id"), "outcome", "attempts", "last_status") for w in went]
        decided += ended
        # Calls behind the last stretch of a pool without an open source were not touched, nor pools without sources in this round.
        kept = touched.join(fate, "pool", "left").where(F.col("until").isNull() | (F.col("step") >= F.col("until"))).select(*CALL)
        touched = settle(reduce(DataFrame.unionByName, [w.where("outcome = 'pending'").select(*CALL) for w in went], kept), "touched")
        both = start.join(fate, "pool", "full").select("pool", F.greatest("start", "until").alias("start"))
        start = settle(both, "start")
        if touched.isEmpty() and queue.join(start, "pool", "left").where(F.col("step") >= F.coalesce("start", F.lit(0))).isEmpty():
            break
    rest = touched.unionByName(queue.join(start, "pool", "left").where(F.col("step") >= F.coalesce("start", F.lit(0))).select(*CALL))
    decided.append(rest.select("call_id", "pool", F.lit(None).cast(kind).alias("source_id"), F.lit("fallback").alias("outcome"), "attempts", "last_status"))
    return reduce(DataFrame.unionByName, decided).select("call_id", "pool", "source_id", "outcome", "attempts", F.col("last_status").alias("status"))


def _queued(calls: DataFrame, *more: str) -> DataFrame:
    """calls in the order of their pools' queues: `at` is the place in the queue, `step` the step that it lies in."""
    spent = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens")
    placed = running(dealt(calls.select("call_id", "pool", "ord", spent, *more), "pool", "ord", "call_id"), "pool", ("ord", "call_id"), F.lit(1))
    return settle(placed.select("call_id", "pool", "tokens", F.col("before").cast("long").alias("at"), F.floor(F.col("before") / STEP).cast("long").alias("step"), *more), "queue")


def dispatch_kinds(calls: DataFrame, sources: DataFrame, status: Callable[[Column, Column], Column]) -> DataFrame:
    """What `dispatch` gives where statuses follow from a kind of the call and one of the source, few of each: status(call's kind, source's kind).

    calls and sources have a column `kind` besides.  Calls of a kind end alike as long as the same sources are open, at the first of them that
    doesn't send them on, so nothing is asked call by call.  The sources with a cap are used up by a stretch of the pool's queue, which is gone
    through in one task, LONG_CHUNK calls at most.  The calls behind it end by kind, whole steps at a time, up to the first step in which another
    source is used up; there the next stretch begins.  A task holds a pool's open sources and one stretch of its queue."""
    numbers = lambda rows, name: settle(rows.select("kind").distinct().select("kind", (F.row_number().over(Window.orderBy("kind")) - 1).alias(name)), "kinds")
    asked, offered = numbers(calls, "call_kind"), numbers(sources, "source_kind")
    number = lambda rows, kinds: rows.join(kinds.withColumnRenamed("kind", "_kind"), F.col("kind").eqNullSafe(F.col("_kind"))).drop("kind", "_kind")
    queue = _queued(number(calls.select("call_id", "pool", "ord", "tokens", "kind"), asked), "call_kind")
    codes = asked.crossJoin(offered.withColumnRenamed("kind", "_kind")).select("source_kind", F.struct("call_kind", _code(status(F.col("kind"), F.col("_kind")).cast("int")).alias("code")).alias("c"))
    answers = settle(codes.groupBy("source_kind").agg(F.sort_array(F.collect_list("c"))["code"].alias("answers")), "answers")
    usable = F.col("left").isNull() | (F.col("left") > 0)
    places = number(sources.select("pool", "source_id", "rank", F.col("remaining").cast("long").alias("left"), "kind"), offered)
    still = first = settle(places.where(usable & F.col("pool").isNotNull()), "sources")
    steps = settle(queue.join(first.select("pool").distinct(), "pool", "left_semi").groupBy("pool", "step", "call_kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")), "steps")
    types = dict(queue.dtypes) | dict(places.dtypes)
    schema = f"pool {types['pool']}, call_id {types['call_id']}, source_id {types['source_id']}, rank int, call_kind int, left long, outcome string, attempts int, status int"
    decided, spans = [], []
    after = steps.select("pool").distinct().withColumn("after", F.lit(0).cast("long"))
    while not after.isEmpty():
        many = steps.join(after, "pool").where(F.col("step") >= F.col("after")).groupBy("pool", "step").agg(F.sum("n").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("pool").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # Whole steps, up to the first that fills the stretch.
        until = settle(many.withColumn("before", before).where(F.col("before") < LONG_CHUNK).groupBy("pool").agg(F.min("step").alias("start"), (F.max("step") + 1).alias("until")), "until")
        head = queue.join(until, "pool").where((F.col("step") >= F.col("start")) & (F.col("step") < F.col("until"))).select("pool", "call_id", "tokens", "at", "call_kind")
        held = still.join(until.select("pool"), "pool", "left_semi").join(answers, "source_kind").select("pool", "source_id", "rank", "left", "source_kind", "answers")
        gone = settle(head.groupBy("pool").cogroup(held.groupBy("pool")).applyInArrow(_go_through_kinds, schema), "gone")
        decided.append(gone.where("call_kind is null and outcome is not null").select("pool", "call_id", "source_id", "outcome", "attempts", "status"))
        now = gone.where("outcome is null").select("pool", "rank", F.col("left").alias("now"))
        still = settle(still.join(now, ["pool", "rank"], "left").withColumn("left", F.coalesce("now", "left")).drop("now").where(usable), "sources")
        ends = gone.where("call_kind is not null").select("pool", "call_kind", "source_id", "rank", "outcome", "attempts", "status").join(until.select("pool", "until"), "pool")
        # The first step of the rest in which a source is used up, if all of it ended so.
        rest = steps.join(ends.where("outcome = 'served'"), ["pool", "call_kind"]).where(F.col("step") >= F.col("until"))
        spent = rest.groupBy("pool", "rank", "step").agg(F.sum("tokens").alias("tokens"))
        so_far = F.sum("tokens").over(Window.partitionBy("pool", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
        full = spent.withColumn("so_far", so_far).join(still.select("pool", "rank", "left"), ["pool", "rank"]).where("so_far >= left")
        after = settle(full.groupBy("pool").agg(F.min("step").alias("after")), "after")
        sent = spent.join(after, "pool").where(F.col("step") < F.col("after")).groupBy("pool", "rank").agg(F.sum("tokens").alias("sent"))
        still = settle(still.join(sent, ["pool", "rank"], "left").withColumn("left", F.col("left") - F.coalesce("sent", F.lit(0))).drop("sent"), "sources")
        spans.append(ends.join(after, "pool", "left").select("pool", "call_kind", "source_id", "outcome", "attempts", "status", F.col("until").alias("start"), F.coalesce("after", F.lit(1 << 62)).alias("after")))
    out = ("call_id", "pool", "source_id", "outcome", "attempts", "status")
    none = queue.join(first.select("pool").distinct(), "pool", "left_anti")
    decided = [d.select(*out) for d in decided]
    decided.append(none.select("call_id", "pool", F.lit(None).cast(types["source_id"]).alias("source_id"), F.lit("fallback").alias("outcome"), F.lit(0).alias("attempts"), F.lit(None).cast("int").alias("status")))
    if spans:
        ended = settle(reduce(DataFrame.unionByName, spans), "spans")
        decided.append(queue.join(ended, ["pool", "call_kind"]).where((F.col("step") >= F.col("start")) & (F.col("step") < F.col("after"))).select(*out))
    return reduce(DataFrame.unionByName, decided)


def _listed(open_sources: DataFrame, order: str) -> DataFrame:
    """(pool, here): each pool's sources that have something left, in order, as structs (order, source_id, left); at most RANKS of them."""
    usable = open_sources.where("left is null or left > 0")
    return settle(usable.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct(order, "source_id", "left"))).alias("here")), "here")


def _round(waiting: DataFrame, here: DataFrame, status: Callable[[Column, Column], Column], schema: str) -> tuple[list[DataFrame], DataFrame]:
    """(calls by what became of them, fate): fate has each pool of `here` with `until`, the first step of its queue that was not touched."""
    went, fates, after = [], [], here.select("pool", F.lit(0).cast("long").alias("after"))
    while not here.isEmpty():
        asked = waiting.join(here, "pool").join(after, "pool").where(F.col("step") >= F.col("after")).drop("after")
        many = asked.groupBy("pool", "step").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("pool").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # Whole steps, up to the first that fills the stretch.
        until = settle(many.withColumn("before", before).where(F.col("before") < CHUNK).groupBy("pool").agg((F.max("step") + 1).alias("until")), "until")
        answers = F.transform(F.transform("here", lambda s: status(F.col("call_id"), s["source_id"]).cast("int")), _code)
        head = asked.join(until, "pool").where(F.col("step") < F.col("until")).select(*CALL, answers.alias("answers"), F.transform("here", lambda s: s["left"]).alias("left"))
        gone = settle(head.groupBy("pool").applyInArrow(_go_through, schema), "gone")
        calls = gone.where("left is null").join(here, "pool").withColumn("source_id", F.get("here", F.col("place"))["source_id"]).drop("here", "left", "place")
        went.append(calls)
        left = here.select("pool", F.posexplode("here").alias("place", "s")).select("pool", "place", "s.source_id", "s.left")
        now = gone.where("left is not null").select("pool", "place", F.col("left").alias("now"))
        still = _listed(left.join(now, ["pool", "place"], "left").select("pool", "place", "source_id", F.coalesce("now", "left").alias("left")), "place")
        # The calls behind the stretch, if none of the sources that are left is used up by them.
        tail = waiting.join(still, "pool").join(until, "pool").where(F.col("step") >= F.col("until"))
        sent = settle(_sent_on(tail, status), "sent")
        spent = sent.where("outcome = 'served'").groupBy("pool", "source_id").agg(F.sum("tokens").alias("spent"))
        limits = still.select("pool", F.explode("here").alias("s")).select("pool", "s.source_id", "s.left")
        again = settle(spent.join(limits, ["pool", "source_id"]).where("left is not null and spent >= left").select("pool").distinct(), "again")
        went.append(sent.join(again, "pool", "left_anti"))
        whole = still.join(again, "pool", "left_anti").select("pool", F.lit(1 << 62).alias("whole"))
        fates.append(until.join(again, "pool", "left_anti").join(whole, "pool", "left").select("pool", F.coalesce("whole", "until").alias("until")))
        here, after = still.join(again, "pool", "left_semi"), until.select("pool", F.col("until").alias("after"))
    none = here.select("pool", F.lit(0).cast("long").alias("until")).limit(0)
    return went, settle(reduce(DataFrame.unionByName, fates, none), "fate")


def _code(answer: Column) -> Column:
    """An attempt's status (no answer: -1) and what it leads to, as one number: served 0, on to the next 1, an error 2."""
    leads = F.when(F.coalesce(answer < 400, F.lit(False)), 0).when(fails_over(answer), 1).otherwise(2)
    return F.coalesce(answer, F.lit(-1)) * 4 + leads


def _sent_on(calls: DataFrame, status: Callable[[Column, Column], Column]) -> DataFrame:
    """calls with what becomes of them at the sources of `here`, none of which is used up."""

    def step(at: Column, s: Column) -> Column:
        ends = lambda answer: F.when(F.coalesce(answer < 400, F.lit(False)), 0).when(fails_over(answer), 1).otherwise(2)
        tried = lambda answer: F.struct(ends(answer).alias("ends"), (at["tries"] + 1).alias("tries"), answer.alias("answer"), s["source_id"].alias("source_id"))
        # The status is computed once, and only for calls that come so far.
        return F.when(at["ends"] != 1, at).otherwise(let(status(F.col("call_id"), s["source_id"]).cast("int"), tried))

    kind = calls.schema["here"].dataType.elementType["source_id"].dataType
    none = F.struct(F.lit(1).alias("ends"), F.lit(0).alias("tries"), F.lit(None).cast("int").alias("answer"), F.lit(None).cast(kind).alias("source_id"))
    told = calls.withColumn("end", F.aggregate("here", none, step))
    last = F.when(F.col("end.tries") > 0, F.col("end.answer")).otherwise(F.col("last_status"))
    outcome = F.element_at(F.array(F.lit("served"), F.lit("pending"), F.lit("error")), F.col("end.ends") + 1)
    return told.select("call_id", "pool", "tokens", "at", "step", (F.col("attempts") + F.col("end.tries")).alias("attempts"), last.alias("last_status"), outcome.alias("outcome"), "end.source_id")


def _go_through(calls: pa.Table) -> pa.Table:
    """A stretch of one pool's calls, one after the other: a row a call, and one with `left` for each source that has a cap."""
    calls = calls.sort_by("at")
    left = calls.column("left")[0].as_py()
    answers = np.array(calls.column("answers").combine_chunks().flatten()).reshape(len(calls), len(left))
    tokens, tries, last = (calls.column(c).to_pylist() for c in ("tokens", "attempts", "last_status"))
    outcomes, places = ["pending"] * len(calls), [None] * len(calls)
    still = list(range(len(left)))
    for i, own in enumerate(tokens):
        for place in still:
            code = int(answers[i, place])
            tries[i] += 1
            last[i] = None if code >> 2 == -1 else code >> 2
            if code & 3 == 1:
                continue
            outcomes[i], places[i] = ("served", "", "error")[code & 3], place
            if code & 3 == 0 and left[place] is not None:
                left[place] -= own
                if left[place] <= 0:
                    still.remove(place)
            break
    capped = [(k, v) for k, v in enumerate(left) if v is not None]
    many, fill = len(calls), lambda kind: pa.nulls(len(capped), kind)
    names = [f for f in ("call_id", "pool", "tokens", "at", "step")]
    cols = [pa.concat_arrays([calls.column(c).combine_chunks(), fill(calls.schema.field(c).type) if c != "pool" else pa.array([calls.column("pool")[0].as_py()] * len(capped), calls.schema.field(c).type)]) for c in names]
    cols += [pa.array([*x, *[None] * len(capped)], kind) for x, kind in ((tries, pa.int32()), (last, pa.int32()), (outcomes, pa.string()))]
    cols += [pa.array([*places, *[k for k, _ in capped]], pa.int32()), pa.array([*[None] * many, *[v for _, v in capped]], pa.int64())]
    return pa.table(cols, [*names, "attempts", "last_status", "outcome", "place", "left"])


def _go_through_kinds(calls: pa.Table, sources: pa.Table) -> pa.Table:
    """A stretch of one pool's calls, one after the other: a row a call, one with `left` for each source that has a cap, and one with `call_kind` for how each kind of call ends then.

    Only the first open source of a kind ever serves, so a kind's open sources are those from one place on."""
    calls, sources = calls.sort_by("at"), sources.sort_by("rank")
    left, kinds, tokens = sources.column("left").to_pylist(), sources.column("source_kind").to_numpy(), calls.column("tokens").to_pylist()
    offered, where = np.unique(kinds, return_index=True)
    codes = np.array(sources.column("answers").take(pa.array(where)).to_pylist(), int).reshape(len(offered), -1).T  # calls' kinds x sources' kinds
    places = [np.flatnonzero(kinds == k) for k in offered]
    which = dict(zip(offered.tolist(), range(len(offered)), strict=True))
    gone = [0] * len(offered)

    def end(kind: int) -> tuple[int, int, int, str]:
        """(place, attempts, status, outcome) of a call of the kind now; no place is -1, no answer is None."""
        stops = [(int(p[g]), k) for k, (p, g) in enumerate(zip(places, gone, strict=True)) if g < len(p) and codes[kind, k] & 3 != 1]
        if not stops:
            last = max(((int(p[-1]), k) for k, (p, g) in enumerate(zip(places, gone, strict=True)) if g < len(p)), default=None)
            code = -4 if last is None else int(codes[kind, last[1]])
            return -1, sum(len(p) - g for p, g in zip(places, gone, strict=True)), code >> 2, "fallback"
        place, k = min(stops)
        tries = sum(max(0, int(np.searchsorted(p, place, "right")) - g) for p, g in zip(places, gone, strict=True))
        return place, tries, int(codes[kind, k]) >> 2, ("served", "", "error")[codes[kind, k] & 3]

    ends, known, found = [], {}, []
    for kind, own in zip(calls.column("call_kind").to_pylist(), tokens, strict=True):
        if kind not in known:
            known[kind] = len(ends)
            ends.append(end(kind))
        found.append(known[kind])
        place, _, _, outcome = ends[known[kind]]
        if outcome == "served" and left[place] is not None:
            left[place] -= own
            if left[place] <= 0:
                gone[which[int(kinds[place])]] += 1
                known = {}
    later = [(kind, *end(kind)) for kind in range(len(codes))]
    capped = [k for k, v in enumerate(left) if v is not None]
    told = [ends[k] for k in found] + [e[1:] for e in later]
    place = pa.array([None if e[0] < 0 else e[0] for e in told] + capped, pa.int64())
    ids, none, many = sources.column("source_id").take(place), [None] * len(capped), len(calls)
    calls_id = pa.chunked_array([*calls.column("call_id").chunks, pa.nulls(len(later) + len(capped), calls.schema.field("call_id").type)])
    pool = pa.array([calls.column("pool")[0].as_py()] * len(place), calls.schema.field("pool").type)
    kind = pa.array([None] * many + [e[0] for e in later] + none, pa.int32())
    status = pa.array([None if e[2] == -1 else e[2] for e in told] + none, pa.int32())
    return pa.table([pool, calls_id, ids, sources.column("rank").take(place).cast(pa.int32()), kind, pa.array([None] * len(told) + [left[k] for k in capped], pa.int64()), pa.array([e[3] for e in told] + none, pa.string()), pa.array([e[1] for e in told] + none, pa.int32()), status], ["pool", "call_id", "source_id", "rank", "call_kind", "left", "outcome", "attempts", "status"])
