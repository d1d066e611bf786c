"""Quality rules: robust multivariate outliers by minimum covariance determinants, in DataFrame functions only.

Each text gives counts, the counts a vector of transformed statistics.  For each language and source
the vectors' location and scatter are estimated by concentration steps: keep the `share` of rows of the smallest
Mahalanobis distance, take their mean and covariance, and repeat; the determinant does not grow on the way.
The steps run from three fixed starts, and of their ends that with the smallest determinant counts: medians with quartile
spreads; mean and covariance of all rows; medians with the covariance of directions from them.  A share's covariance
is too small for the whole and is made larger by the factor that holds for normal vectors.  Rows
beyond the 0.999 quantile of chi-square with as many degrees of freedom as the vector has parts are rejected.

A step is two aggregates: one counts rows per distance bin, which gives the distance that the
share stays under, one adds up the rows' products.  Both combine before they shuffle.  Rows meet
their group's figures in a broadcast of at most `FEW_GROUPS` groups, beyond that by salt, so a group of a third of all rows
is spread over many tasks either way.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.text import let
from scholarframe.plans.tables import settle

SPACE = r"[\x20\x09-\x0D]+"
#: The vector's parts: log length, mean word length, and the logits of three rates.
PARTS = ("v_words", "v_length", "v_symbols", "v_lines", "v_repeats")
#: Spread that every part has at least, in its own unit; else a part that most rows share would reject all others.
FLOOR = (0.35, 0.12, 0.8, 0.8, 0.9)
#: Bins per factor e of the squared distance.
BINS = 40
#: Groups whose figures are broadcast, and tasks that a group's rows are dealt to beyond.
FEW_GROUPS, SALTS = 4096, 64
GROUP = ("lang", "source")


def chi_square(x: float, freedom: float) -> float:
    """The distribution function of chi-square, by the series of the incomplete gamma function."""
    a, half = freedom / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= half / n
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a))


@cache
def chi_square_quantile(p: float, freedom: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return high


@cache
def consistency(share: float, size: int) -> float:
    """How much larger the covariance of normal vectors is than that of their `share` nearest the middle."""
    return 1.0 if share >= 1 else share / chi_square(chi_square_quantile(share, size), size + 2)


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more, the first one included."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def count(own: Column) -> Column:
        order = F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda at: F.filter(at, lambda x, i: (F.get(at, i - 1)["h"] == x["h"]) | (F.get(at, i + 1)["h"] == x["h"]))
        starts = let(order, lambda at: F.sort_array(F.transform(twice(at), lambda x: x["i"])))
        step = lambda at: F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
        total = let(starts, lambda at: F.aggregate(step(at), F.lit(0), lambda n, x: n + x))
        # Most texts repeat no window, so only the others are sorted with positions.
        return F.when(F.size(F.array_distinct(own)) == F.size(own), 0).otherwise(total)

    return F.when(F.size(words) < 3, 0).otherwise(let(hashes, count))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; a null text has no words."""
    text = F.coalesce("text", F.lit(""))
    # Stripped first, so that no empty word is split off; an empty text has none.
    bare = F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")
    split = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    said = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = lambda w: F.struct(F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), _repeated(w).alias("n_repeat_words"))
    lines = let(said, lambda at: F.size(at) - F.size(F.array_distinct(at)))
    out = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), let(split, words).alias("w"), symbols.alias("n_symbols"), lines.alias("n_dup_lines"))
    return out.select("doc_id", "lang", "source", *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")))


def vectors(counts: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c, unit: F.log((F.col(c) + F.lit(unit)) / (n + F.lit(unit)))
    return counts.withColumns({
        "v_words": F.log(n),
        "v_length": F.log((F.col("word_chars") + 1) / n),
        "v_symbols": rate("n_symbols", 2.0),
        "v_lines": rate("n_dup_lines", 2.0),
        "v_repeats": rate("n_repeat_words", 6.0),
    })


def _cholesky(at: DataFrame, size: int) -> DataFrame:
    """Columns l_i_j of the lower factor of the covariance c_i_j, by Cholesky's recursion."""
    for j in range(size):
        squares = reduce(add, (F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        at = at.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - squares, F.lit(1e-9))))
        for i in range(j + 1, size):
            cross = reduce(add, (F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            at = at.withColumn(f"l_{i}_{j}", (F.col(f"c_{i}_{j}") - cross) / F.col(f"l_{j}_{j}"))
    return at


def _meet(rows: DataFrame, figures: DataFrame, *keys: str) -> DataFrame:
    """rows with their group's figures, a settled table."""
    if figures.count() <= FEW_GROUPS:
        return rows.join(F.broadcast(figures), list(keys))
    spread = figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, [*keys, "salt"])


def _distance(rows: DataFrame, shape: DataFrame, *more: str) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance under their group's shape; `more` are columns of the shape to keep."""
    size = len(PARTS)
    factors = [f"l_{i}_{j}" for i in range(size) for j in range(i + 1)]
    out = _meet(rows, shape.select(*GROUP, *(f"m_{i}" for i in range(size)), *factors, *more), *GROUP)
    for i, part in enumerate(PARTS):
        known = reduce(add, (F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y_{i}", (F.col(part) - F.col(f"m_{i}") - known) / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", reduce(add, (F.col(f"y_{i}") ** 2 for i in range(size)))).select(*rows.columns, *more, "d2")


def _moments(rows: DataFrame, scale: Column, *more: str) -> DataFrame:
    """Mean and covariance of each group's rows, the covariance times `scale`, with the floors added."""
    size = len(PARTS)
    sums = [F.avg(p).alias(f"m_{i}") for i, p in enumerate(PARTS)]
    products = [F.avg(F.col(PARTS[i]) * F.col(PARTS[j])).alias(f"p_{i}_{j}") for i in range(size) for j in range(i + 1)]
    at = rows.groupBy(*GROUP, *more).agg(*sums, *products, F.max(scale).alias("scale"))
    for i in range(size):
        for j in range(i + 1):
            own = (F.col(f"p_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * F.col("scale")
            at = at.withColumn(f"c_{i}_{j}", own + FLOOR[i] ** 2 if i == j else own)
    return _cholesky(at, size)


def _starts(rows: DataFrame) -> DataFrame:
    """Each group's three first shapes."""
    size = len(PARTS)
    # Medians and spreads between quartiles: sketches that merge.
    quartiles = [F.percentile_approx(p, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, p in enumerate(PARTS)]
    at = rows.groupBy(*GROUP).agg(*quartiles)
    spread = lambda i: F.sqrt(((F.get(f"q_{i}", 2) - F.get(f"q_{i}", 0)) / 1.349) ** 2 + FLOOR[i] ** 2)
    middle = settle(at.select(*GROUP, *(F.get(f"q_{i}", 1).alias(f"m_{i}") for i in range(size)), *(spread(i).alias(f"s_{i}") for i in range(size))), "middle")
    first = middle
    for i in range(size):
        for j in range(i + 1):
            first = first.withColumn(f"c_{i}_{j}", F.col(f"s_{i}") ** 2 if i == j else F.lit(0.0))
    # Directions: vectors from the median, in units of the spreads, brought to length one.
    turned = _meet(rows, middle, *GROUP)
    z = [(F.col(p) - F.col(f"m_{i}")) / F.col(f"s_{i}") for i, p in enumerate(PARTS)]
    turned = turned.withColumn("r2", F.greatest(reduce(add, (x * x for x in z)), F.lit(1e-9)))
    crossed = turned.groupBy(*GROUP).agg(*(F.avg(z[i] * z[j] / F.col("r2") * size).alias(f"d_{i}_{j}") for i in range(size) for j in range(i + 1)))
    third = middle.join(crossed, list(GROUP))
    for i in range(size):
        for j in range(i + 1):
            own = F.col(f"d_{i}_{j}") * F.col(f"s_{i}") * F.col(f"s_{j}")
            third = third.withColumn(f"c_{i}_{j}", own + FLOOR[i] ** 2 if i == j else own)
    cols = [*GROUP, *(f"m_{i}" for i in range(size)), *(f"l_{i}_{j}" for i in range(size) for j in range(i + 1))]
    shapes = (_cholesky(first, size), _moments(rows, F.lit(1.0)), _cholesky(third, size))
    return reduce(DataFrame.union, (x.select(*cols, F.lit(k).alias("start")) for k, x in enumerate(shapes)))


def robust_shapes(rows: DataFrame, share: float = 0.75, steps: int = 3) -> DataFrame:
    """Each group's location m_i and factor l_i_j, of the start whose `steps` concentration steps end in the smallest determinant."""
    size = len(PARTS)
    shape = settle(_starts(rows), "shape")
    group = Window.partitionBy(*GROUP, "start")
    factors = F.array(*(F.lit(consistency(k / 200, size)) for k in range(1, 201)))
    for _ in range(steps):
        near = _distance(rows, shape, "start").withColumn("bin", F.floor(F.log(F.col("d2") + 1e-3) * BINS).cast("int"))
        counted = near.groupBy(*GROUP, "start", "bin").agg(F.count("*").alias("n"))
        run = counted.select(*GROUP, "start", "bin", F.sum("n").over(group.orderBy("bin")).alias("run"), F.sum("n").over(group).alias("all"))
        bound = run.where(F.col("run") >= F.ceil(F.col("all") * share)).groupBy(*GROUP, "start").agg(F.min("bin").alias("last"), F.min(F.col("run") / F.col("all")).alias("kept"))
        # Rows of equal distance stay together, so the factor is that of the share really kept.
        bound = settle(bound.select(*GROUP, "start", "last", F.element_at(factors, F.ceil(F.col("kept") * 200).cast("int")).alias("factor")), "bound")
        kept = _meet(near, bound, *GROUP, "start").where("bin <= last")
        shape = settle(_moments(kept, F.col("factor"), "start"), "shape")
    logs = reduce(add, (F.log(f"l_{i}_{i}") for i in range(size)))
    best = F.min_by(F.struct(*(c for c in shape.columns if c not in GROUP)), F.struct(F.round(logs, 9), "start")).alias("s")
    return settle(shape.groupBy(*GROUP).agg(best).select(*GROUP, "s.*"), "shape")


def judge(docs: DataFrame, quantile: float = 0.999, share: float = 0.75, steps: int = 3) -> DataFrame:
    """doc_id, counts, base_failed, kept and distance2 for each document.

    docs has doc_id, text, lang and source; other columns are ignored.  A null text has no words, a null lang
    or source is an empty one.  A row is rejected if base_failed (fewer than 50 words, or over half of its
    words in repeated 3-word windows) or if its squared distance is beyond the `quantile` of chi-square.  Groups of few rows
    have the floors as their least scatter, so a lone row has distance 0.  Repeated rows and ids count each.
    An empty table gives no rows.
    """
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    rows = settle(vectors(text_counts(docs)).withColumn("salt", salt), "vectors")
    fit = rows.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    judged = _distance(fit, robust_shapes(fit, share, steps))
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    limit = chi_square_quantile(quantile, len(PARTS))
    good = judged.select(*cols, F.lit(False).alias("base_failed"), (F.col("d2") <= limit).alias("kept"), F.col("d2").alias("distance2"))
    bad = rows.where("not (n_words >= 50 and 100 * n_repeat_words <= 50 * n_words)").select(*cols, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2"))
    return good.union(bad)
