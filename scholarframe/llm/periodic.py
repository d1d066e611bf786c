"""Periodic runs of words by bit-parallel lags, in Arrow batches.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
max(6, 4 q) words, that no neighbouring word extends with period q.

Words get ids in order of appearance, and bit k of all ids is plane k, one big integer with a bit for each word.  For a
lag q each plane is XORed with itself shifted by q, and the planes' mismatches are ORed: a zero at place i says that words i
and i + q are identical.  A run of period q is a zero stretch of at least max(6 - q, 3 q) places; shift-doubling
AND keeps a bit for each place where so long a stretch begins, in a logarithmic number of steps.  Mismatches only grow
from plane to plane, so a lag ends with the first plane that leaves no stretch, which for most lags is the first one.

A stretch found at lag q whose smallest period p is smaller has a p that divides q, as it is at least 4 q long, and
then it was found at lag p with the same ends: smaller lags come first, and a stretch met again is passed over.

A lag costs a number of machine words in proportion to the text's words / 64, and there are words / 4 lags.  In texts
of more than PROBE_WORDS words lags of 64 and more are probed first: a zero stretch of 3 q places holds three
successive multiples of q, so four words at successive multiples of q must be equal.  Only lags with such a place go
through the planes, and what is left of the cost is in proportion to n log n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.functions.text import let

#: Words beyond which long lags are probed before they go through the planes; results are the same.
PROBE_WORDS = 1 << 15
_SPACE = "[\\x20\\x09-\\x0D]+"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def bit_planes(ids: np.ndarray) -> list[int]:
    """Bit k of all ids as one integer, for each k."""
    width = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(width)]


def long_stretches(zeros: int, need: int) -> int:
    """A bit for each place from which `need` places or more are set."""
    have = 1
    while have < need and zeros:
        step = min(have, need - have)
        zeros &= zeros >> step
        have += step
    return zeros


def places(bits: int) -> list[int]:
    if not bits:
        return []
    data = np.frombuffer(bits.to_bytes(bits.bit_length() + 7 >> 3, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(data, bitorder="little")).tolist()


def _probed(ids: np.ndarray, q: int) -> bool:
    """Whether four words at successive multiples of q are equal."""
    steps = ids[::q]
    same = steps[1:] == steps[:-1]
    return bool((same[2:] & same[1:-1] & same[:-2]).any())


def find_runs(ids: np.ndarray, probe_words: int = PROBE_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    if n < 6:
        return []
    planes, every, seen = bit_planes(ids), (1 << n) - 1, {}
    for q in range(1, n // 4 + 1):
        if n > probe_words and q >= 64 and not _probed(ids, q):
            continue
        need, mask, mismatch, found = max(6 - q, 3 * q), every >> q, 0, 0
        for plane in planes:
            mismatch |= plane ^ plane >> q
            found = long_stretches(mask ^ mismatch & mask, need)
            if not found:
                break
        if found:
            for first, last in zip(places(found & ~(found << 1)), places(found & ~(found >> 1)), strict=True):
                seen.setdefault((first, last - first + need + q), q)
    return sorted(((start, length, q) for (start, length), q in seen.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep))


def _found(batches: Iterator[pa.RecordBatch], probe_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        many, runs, texts = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = (text or b"").split()  # of bytes: at blanks and tab to carriage return
            own = find_runs(word_ids(words), probe_words)
            many.append(len(words))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            texts.append(collapsed(words, own).decode())
        columns = [batch.column("doc_id"), pa.array(many, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())]
        yield pa.record_batch(columns, ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, probe_words: int = PROBE_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of docs (doc_id long, text string).

    runs are structs (start, length, period) by start, then period; collapsed is the text's words without those that a run
    holds after its first period.  Words are what blanks and tab to carriage return separate, as they are.  A null or empty text
    has no words and no runs, and is collapsed to an empty one.  Rows that repeat a doc_id are searched each, a null one stays
    null; an empty table gives no rows; other columns are ignored.  A text is held whole by one task.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda it: _found(it, probe_words), _OUT)


def looped(text: Column, key: Column) -> Column:
    """The text with a planted loop in a tenth of the documents: with h the CRC-32 of the decimal key and g = h / 10, where
    h % 10 = 0 the words from a = g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them.  Others, and texts without words or
    without a key, stay as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        at = F.struct(words.alias("words"), a.alias("a"), (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int").alias("p"))
        told = lambda x: F.transform(x["words"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["words"], x["a"] + F.pmod(i - x["a"], x["p"]))))
        return F.when(n > 0, F.array_join(let(at, told), " ")).otherwise(text)

    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), let(F.filter(F.split(text, _SPACE), lambda w: w != ""), loop)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    named = found.withColumn("best", best)
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
