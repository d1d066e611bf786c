"""Candidates within crowds: sets made of the same long passages, of which very many share any one of them.

Tokens that stand in exactly the same sets are one element with a weight, so a passage that a template repeats is a
single element, and no more than a few elements can be missed in a link.  A set's elements are put in order of (frequency,
members), and prefixes are extended as far as the crowd asks for: a node is a combination of a pair's first k common elements, the first
level has k = 1, and a node of more than `leaf` sets is extended by each element that can be the next common one, which
is so if all that is passed over weighs no more than the set can miss.  A small node's sets are compared with each other.  In a node that is
extended, pairs may end: those whose common elements are the node's only.  Both sets then can miss all that is left, both reach a link
with the weight of the node alone, and so the smallest such set links with both: comparing it with the others is enough.

A node is extended where that takes far fewer rows than it has pairs, and leaves fewer pairs; others are compared as they are,
within bands of sizes that can link.  So the rows of a level are a fraction of the pairs that signatures alone would give.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.plans.tables import settle

#: Sets of a node that are compared with each other.
LEAF = 8
#: Nodes of the first level that a set of heavy elements has at most.
FEW = 32
#: A node is extended where its pairs are at least so many times the rows of its extension.
WORTH = 4
#: Sets of a node, more or less, that tell whether extending it leaves fewer pairs.
TRIED = 64


def band(n: Column, percent: int) -> Column:
    """Sizes that can link are in one band or in two next to each other."""
    return F.floor(F.log(n + 0.0) / math.log(101 / percent)).cast("int")


def elements(sets: DataFrame, percent: int) -> DataFrame:
    """(ref, n, el, total, budget): each set's elements, structs (df, who, before, weight) in order, with the weight of those before;
    the weight of all, and what of it the set can miss in a link.  sets has ref, n, tokens; those that can link with none are left out."""
    held = sets.select("ref", F.explode("tokens").alias("token"))
    # The members of a token, as 64 bits of their hashes: tokens of the same ones are one element.
    kinds = settle(held.groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("ref")).alias("who")).where("df > 1"), "kinds")
    weighed = held.join(kinds, "token").groupBy("ref", "df", "who").agg(F.count("*").alias("weight"))
    before = F.sum("weight").over(Window.partitionBy("ref").orderBy("df", "who")) - F.col("weight")
    lists = weighed.withColumn("before", before).groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("df", "who", "before", "weight"))).alias("el"), F.sum("weight").alias("total"))
    told = lists.join(sets.select("ref", "n"), "ref")
    return told.withColumn("budget", F.col("total") - F.ceil(F.col("n") * percent / 100)).where("budget >= 0")


def _nodes(rows: DataFrame) -> DataFrame:
    """Rows of the nodes that a set goes to from (node, pos, skip, got): one for each element after pos that can be the next common one."""
    here = F.get("el", F.col("pos"))  # null before the first
    start = F.coalesce(here["before"] + here["weight"], F.lit(0))
    ahead = lambda at: F.filter(F.transform("el", lambda e, j: F.struct(j.alias("j"), e.alias("e"))), lambda x: (x["j"] > F.col(at)) & (F.col("skip") + x["e"]["before"] - F.col("start") <= F.col("budget")))
    told = rows.withColumn("start", start)
    out = told.select("ref", "n", "at", "el", "total", "budget", "node", "skip", "got", "start", F.explode(ahead("pos")).alias("x"))
    own = F.col("x.e")
    out = out.select(
        "ref", "n", "at", "el", "total", "budget", F.col("node").alias("parent"), F.xxhash64("node", own["df"], own["who"]).alias("node"), F.col("x.j").alias("pos"),
        (F.col("skip") + own["before"] - F.col("start")).alias("skip"), (F.col("got") + own["weight"]).alias("got"), (own["before"] + own["weight"]).alias("start"),
    )
    after = F.col("total") - F.col("start")
    return out.select("ref", "n", "at", "parent", "node", "pos", "skip", "got", after.alias("after"), F.size(ahead("pos")).alias("kids"), (F.col("skip") + after <= F.col("budget")).alias("may_end"))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets in one node that can link and are in different parts."""
    side = lambda x, bands: rows.select("node", bands.alias("band"), *(F.col(c).alias(f"{c}{x}") for c in ("ref", "n", "at", "got", "after")))
    own = band(F.col("n"), percent)
    most = F.col("gota") + F.least("aftera", "afterb")
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("refa") < F.col("refb")))
    met = side("a", F.explode(F.array(own, own + 1))).join(side("b", own), ["node", "band"])
    met = met.where(first & (F.col("ata") != F.col("atb")) & (100 * most >= percent * (F.col("na") + F.col("nb") - most)))
    return met.select(F.least("refa", "refb").alias("a"), F.greatest("refa", "refb").alias("b"))


def crowd_candidates(listed: DataFrame, percent: int, leaf: int = LEAF) -> DataFrame:
    """(a, b): pairs of refs that hold all links between sets of different parts, as far as connecting them needs.

    listed has the columns of `elements` and at, the part that a set is known to be in."""
    # The lists are joined to the rows of each level again, rather than carried through its shuffles.
    listed = settle(listed, "elements")
    found = None
    start = {"node": F.lit(0).cast("long"), "pos": F.lit(-1), "skip": F.lit(0).cast("long"), "got": F.lit(0).cast("long")}
    rows = settle(_nodes(listed.withColumns(start)), "nodes")
    while True:
        counted = rows.groupBy("node").agg(F.count("*").alias("many"), F.sum("kids").alias("all_kids"), F.min("at").alias("lo"), F.max("at").alias("hi"))
        # Nodes of one part have nothing left to connect.
        counted = counted.where("lo <> hi").withColumn("large", (F.col("many") > leaf) & (2 * WORTH * F.col("all_kids") <= F.col("many") * F.col("many")))
        told = settle(rows.join(counted.select("node", "many", "large"), "node"), "counted")
        # Where sets share nearly all, longer combinations tell no more of them apart: such a node is compared as it is.  How many
        # pairs an extension leaves is told by some of a node's sets, about TRIED or all of a smaller node.
        some = told.where("large").where(F.pmod(F.xxhash64("node", "ref"), F.col("many")) < TRIED)
        tried = _nodes(some.select("ref", "node", "pos", "skip", "got").join(listed, "ref"))
        pairs = lambda c: F.col(c) * (F.col(c) - 1)
        inner = tried.groupBy("parent", "node").agg(F.count("*").alias("met")).groupBy(F.col("parent").alias("node")).agg(F.sum(pairs("met")).alias("inner"))
        paying = settle(some.groupBy("node").agg(F.count("*").alias("sets")).join(inner, "node", "left").where(F.coalesce("inner", F.lit(0)) < pairs("sets")).select("node", F.lit(True).alias("pays")), "paying")
        told = settle(told.join(paying, "node", "left").withColumn("pays", F.coalesce("pays", F.lit(False))), "told")
        ends = told.where("pays and may_end")
        pivot = ends.groupBy("node").agg(F.min(F.struct("n", "ref", "at")).alias("p")).select("node", F.col("p.n").alias("np"), F.col("p.ref").alias("refp"), F.col("p.at").alias("atp"))
        star = ends.join(pivot, "node").where((F.col("at") != F.col("atp")) & (100 * F.col("got") >= percent * (F.col("n") + F.col("np") - F.col("got"))))
        star = star.select(F.least("ref", "refp").alias("a"), F.greatest("ref", "refp").alias("b"))
        own = settle(_pairs(told.where("not pays"), percent).union(star).distinct(), "candidates")
        found = own if found is None else found.union(own)
        again = told.where("pays and kids > 0")
        if again.isEmpty():
            return found.distinct()
        rows = settle(_nodes(again.select("ref", "node", "pos", "skip", "got").join(listed, "ref")), "nodes")
