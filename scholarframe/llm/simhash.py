"""SimHash near-duplicate classes by a Gray-order hierarchical index.

A text's fingerprint has bit k set if more than half of its shingles' XXH64 values have it.  Equal fingerprints become one
row; two link at `most` or fewer differing bits.

The index over all fingerprints is a tree whose upper nodes are rows of Spark tables and whose lower nodes stand in one
task's memory:

1. Upper nodes.  A node holds fingerprints that agree on the bits of a mask.  Its free bits, those that still differ
   among its members, are dealt to most + 1 masks, and each member goes to most + 1 children: to child k with those that agree with it
   on mask k.  Two linked members differ in at most `most` bits, so at least one mask has none of them, and the pair
   meets in that child.  The root's free bits are all 64.  A node of up to LEAF members is a leaf; a larger one is
   split again, on what is left free there, so a crowd of similar fingerprints is cut by the bits in which it does
   differ.  Members are distinct, so a node with more than LEAF of them has bits enough to be split, and each level
   settles a part of them: the depth is bounded by the bits, not by the data.
2. Lower nodes.  A leaf's members are sorted by Gray rank, in which neighbours tend to share patterns.  Successive members
   form groups, successive groups larger ones; a node has the bits that all below share, and of these only those
   that its parent hasn't got already, so shared patterns are compared once for all members below.
3. Search.  Every member goes down its leaf's tree; the differences on a node's own bits add to those of the nodes above, and beyond
   `most` the whole group is passed over.  What arrives at a member with its last bits compared is a link: the accumulated difference is
   the exact distance.

A leaf returns a star of links for each of its connected parts, at most one row a member, never its pairs.  Keys of nodes
are hashes; where two nodes had one key they would be searched as one, with the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.operators.components import connected_components
from scholarframe.plans.tables import settle

#: Members of a leaf; beyond, a node is split.
LEAF = 4096
#: Members or nodes of a lower node.
FAN = 16
#: (member, node) pairs that a search holds at once.
FRONTIER = 1 << 16
#: Shares of a split node's members that are dealt apart.
SALTS = 32
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, size: int = 4, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text; 0 of one without words."""
    words = (text or b"").translate(_LOWER).split()  # of bytes: at blanks and tab to carriage return
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    many, counts, digest = len(stops), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, many, BLOCK):
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > many, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = np.array([fingerprint(t, size) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.record_batch([batch.column("doc_id"), pa.array(own.view(np.int64))], ["doc_id", "fp"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order: the exclusive or of all its right shifts."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class _Level:
    """Nodes of one level: the bits that all below share, their values, the first child of each and the last member below."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.mask, self.pattern, self.first, self.last, self.own = mask, pattern, first, last, mask


def _levels(members: np.ndarray, fan: int) -> list[_Level]:
    """The levels from the members up; the last one has up to `fan` nodes.  own: a node's shared bits beyond those of its parent."""
    many = np.arange(len(members) + 1)
    levels = [_Level(np.full(len(members), _ALL), members, many, many[:-1])]
    while len((below := levels[-1]).mask) > fan:
        first = np.append(np.arange(0, len(below.mask), fan), len(below.mask))
        ones = np.bitwise_and.reduceat(below.pattern & below.mask, first[:-1])
        ever = np.bitwise_or.reduceat(below.pattern | ~below.mask, first[:-1])
        # Bits that all children have, all of them set or all clear.
        levels.append(above := _Level(~(ones ^ ever), ones, first, below.last[first[1:] - 1]))
        below.own = below.mask & ~np.repeat(above.mask, np.diff(first))
    return levels


def search(members: np.ndarray, most: int, fan: int = FAN, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of the linked pairs of members in Gray order, some at a time.

    A stretch of members goes down with the nodes it meets, the deepest first, so at most about `fan` times `frontier` pairs of a
    level are held."""
    levels = _levels(members, fan)
    top = len(levels) - 1
    heads = np.arange(len(levels[top].mask))
    step = max(1, frontier // max(1, len(heads)))
    for at in range(0, len(members), step):
        q = np.arange(at, min(at + step, len(members)))
        work = [(top, np.repeat(q, len(heads)), np.tile(heads, len(q)), np.zeros(len(q) * len(heads), np.uint8))]
        while work:
            depth, q, node, acc = work.pop()
            level = levels[depth]
            acc = acc + np.bitwise_count((members[q] ^ level.pattern[node]) & level.own[node])
            keep = (acc <= most) & (level.last[node] > q)  # of a pair only the later member need be met
            q, node, acc = q[keep], node[keep], acc[keep]
            if not depth:
                yield q, node
                continue
            many = np.diff(level.first)[node]
            for k in range(0, len(q), frontier):
                part = slice(k, k + frontier)
                count = many[part]
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                work.append((depth - 1, np.repeat(q[part], count), np.repeat(level.first[node[part]], count) + inner, np.repeat(acc[part], count)))


def stars(members: np.ndarray, most: int, fan: int = FAN) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what the members' links connect: each member with the first of its part."""
    members = members[np.argsort(gray_rank(members))]
    label = np.arange(len(members))
    for i, j in search(members, most, fan):
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    other = np.flatnonzero(label != np.arange(len(label)))
    return members[label[other]], members[other]


def _linked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("members")
        ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy().view(np.uint64)
        found = [stars(flat[a:b], most) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1))
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def child_masks(free: Column, most: int) -> Column:
    """array<bigint>: the free bits dealt in turn to most + 1 masks."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(free, i) == 1)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    dealt = lambda k: F.aggregate(F.filter(bits, lambda _, place: place % (most + 1) == k), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(bit(i)))
    return F.array(*map(dealt, range(most + 1)))


def _children(rows: DataFrame) -> DataFrame:
    """(node, fp) of each child that a member of a node goes to; rows have node, fp and masks."""
    told = rows.select("node", "fp", F.posexplode("masks").alias("k", "mask"))
    return settle(told.select(F.xxhash64("node", "k", F.col("fp").bitwiseAND(F.col("mask"))).alias("node"), "fp"), "members")


def links(fps: DataFrame, most: int = 4, leaf: int = LEAF) -> DataFrame:
    """(a, b): links of the distinct fingerprints of `fps` (fp long) that connect all those within `most` bits of each other."""
    if leaf < 1 << most:
        raise ValueError("a node to be split needs more than `most` free bits, so a leaf takes 2 ** most members at least")
    found = None
    members = _children(fps.select(F.lit(0).cast("long").alias("node"), "fp", child_masks(F.lit(-1).cast("long"), most).alias("masks")))
    while True:
        # Counted before they are gathered, so that no node of more than `leaf` members ever is.
        counted = members.groupBy("node").agg(F.count("*").alias("many"), F.expr("bit_or(fp) ^ bit_and(fp)").alias("free"))
        large = settle(counted.where(F.col("many") > leaf).select("node", child_masks(F.col("free"), most).alias("masks")), "nodes")
        split = not large.isEmpty()
        small = members
        if split:  # a node may hold most of the rows: its members are dealt by salt, too
            large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            members = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
            small = members.join(large, ["node", "salt"], "left_anti")
        leaves = small.groupBy("node").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")
        own = settle(leaves.mapInArrow(lambda it: _linked(it, most), "a long, b long"), "links")
        found = own if found is None else found.union(own)
        if not split:
            return found
        members = _children(members.join(large, ["node", "salt"]))


def simhash_classes(docs: DataFrame, size: int = 4, most: int = 4, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs (doc_id long, text string).

    fingerprint is 16 lowercase hex digits, component_id the smallest doc_id that links reach.  Texts that are null or without words
    have fingerprint 0, which links like any other; a text of fewer than `size` words is one shingle.  Rows that repeat a
    doc_id are fingerprinted each, and all their classes are one; a row without a doc_id gets a null component_id and links
    nothing.  An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = settle(docs.mapInArrow(lambda it: _fingerprints(it, size), "doc_id long, fp long"), "fingerprints")
    fps = settle(known.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    pairs = links(fps, most, leaf)
    several = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("times")).where("times > 1 and a <> b")
    more = known.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("fp").alias("b"))
    parts = connected_components(pairs.union(more), "a", "b")
    placed = fps.join(parts, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("component", "fp").alias("at"))
    component = settle(placed.groupBy("at").agg(F.min("least").alias("component_id")), "least")
    of_fp = settle(placed.select("fp", "at").join(component, "at").select(F.col("fp").alias("own"), "component_id"), "classes")
    out = known.join(of_fp, F.col("fp") == F.col("own"), "left")
    name = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", name.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
