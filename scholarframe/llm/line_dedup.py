"""Line dedup over overlapping windows of three lines, in DataFrame functions only.

Lines are what \\n separates; those of white space alone don't count for windows.  Every three
consecutive lines make a window, known by 128 bits of hashes.  Of a window that occurs more than
once anywhere the first occurrence has the smallest (doc_id, text hash, line); all lines of the
later ones are removed: their line ranges are merged and cut out.  Where a later occurrence overlaps the
first one of its own text, the lines that they share go too: a, a, a, a holds the window a, a, a twice and
becomes a.  Each line of a later occurrence equals one further up, so the first occurrence of
any line is never removed and no wording is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.functions.text import let
from scholarframe.plans.tables import settle


def _windows(text: Column) -> Column:
    """array<struct<a, b, h1, h2>>: first and last line of each window, and its hashes."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"), line.rlike("[^ \\t-\\r]").alias("said")))
    said = F.filter(lines, lambda line: line["said"])
    none = F.array().cast("array<struct<a:int,b:int,h1:bigint,h2:bigint>>")

    def slide(at: Column) -> Column:
        three = lambda k: [F.get(at, k)[c] for c in ("x", "y")] + [F.get(at, k + 1)[c] for c in ("x", "y")] + [F.get(at, k + 2)[c] for c in ("x", "y")]
        window = lambda k: F.struct(F.get(at, k)["i"].alias("a"), F.get(at, k + 2)["i"].alias("b"), F.xxhash64(*three(k)).alias("h1"), F.xxhash64(F.lit(2), *three(k)).alias("h2"))
        return F.when(F.size(at) >= 3, F.transform(F.sequence(F.lit(0), F.size(at) - 3), window)).otherwise(none)

    return let(said, slide)


def _kept(text: Column, cut: Column) -> Column:
    """The text without the line ranges of `cut`, an array of structs (a, b) sorted by both."""

    def keep(both: Column) -> Column:
        lines, at = both["lines"], both["cut"]
        heads = F.filter(at, lambda x, i: (i == 0) | (x["a"] > F.get(at, i - 1)["b"] + 1))
        tails = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1)["a"] > x["b"] + 1))
        gap = lambda ends: F.transform(F.sequence(F.lit(0), F.size(ends["heads"])), lambda k: _slice(lines, ends, k))
        return let(F.struct(heads.alias("heads"), tails.alias("tails")), lambda ends: F.array_join(F.flatten(gap(ends)), "\n"))

    def _slice(lines: Column, ends: Column, k: Column) -> Column:
        start = F.coalesce(F.get(ends["tails"], k - 1)["b"] + 1, F.lit(0))
        stop = F.coalesce(F.get(ends["heads"], k)["a"], F.size(lines))
        return F.slice(lines, start + 1, stop - start)

    return let(F.struct(F.split(text, "\n").alias("lines"), cut.alias("cut")), keep)


def _removed(cut: Column) -> Column:
    """Number of lines that the ranges of `cut` cover: each range counts from where the one before ends."""
    new = lambda at: F.transform(at, lambda x, i: x["b"] - F.greatest(x["a"] - 1, F.coalesce(F.get(at, i - 1)["b"], F.lit(-1))))
    return let(cut, lambda at: F.aggregate(new(at), F.lit(0), lambda n, x: n + x))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with `text` freed of repeated windows, and the column n_removed (long) behind.

    docs has doc_id and text; its other columns are kept, but for one named n_removed.  A null text
    stays null, an empty one empty; a text of fewer than three lines has no window and stays.  A text
    whose every line repeats becomes empty, its row stays.  Rows equal in doc_id and text are the same
    document and keep the same lines; a null doc_id comes before all others.
    """
    docs = docs.drop("n_removed")
    # Settled, since both the count and the join need them: texts are split and hashed once.
    named = settle(docs.select("doc_id", F.xxhash64("text").alias("th"), F.inline(_windows(F.col("text")))), "windows")
    firsts = named.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "th", "a")).alias("first")).where("times > 1").select("h1", "h2", "first")
    later = named.join(firsts, ["h1", "h2"]).where(F.struct("doc_id", "th", "a") != F.col("first"))
    cut = later.groupBy(F.col("doc_id").alias("d"), "th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("cut"))
    # The row travels as one struct, so that none of its names can meet one of ours.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("t"))
    joined = rows.join(cut, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("th")), "left")
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(_kept(F.col("row.text"), F.col("cut")))
    removed = F.when(F.col("cut").isNull(), 0).otherwise(_removed(F.col("cut"))).cast("long")
    return joined.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns), removed.alias("n_removed"))
