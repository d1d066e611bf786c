"""N-gram Jaccard join with token-combination prefixes: classes of linked documents.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Two sets link when
100 * intersection >= percent * union.  A set of n tokens can miss at most
e = n - ceil(percent * n / 100) of them in a link.

1. Most documents link with nothing, and that shows early: a fixed share of all hash values, twice
   the part that a link may miss, is counted over all documents.  A document with more than e tokens of that share
   that no other document holds is out.  The count is one shuffle of (token, document) pairs.
2. Of the others, equal sets become one.  Their texts are hashed again, and the frequencies of all
   their tokens are counted; those of one document are left out and count as missed.
3. Tokens are ordered by (frequency, hash) and fall into classes of frequency, each with its k: rare tokens
   are indexed singly, frequent ones in combinations of two, the most frequent in threes.  By its hash each token of the
   upper classes belongs to one of g groups, g in proportion to e, and combinations are made within a group only, so
   their number grows with the set's size and not with its square.  The prefix is extended until
   its tokens, less k - 1 for each group met, exceed what a set can miss: two linked sets
   that share no combination would share at most k - 1 prefix tokens of each group, and so too
   few.  g follows the power of two below the set's size; a set that may link with larger
   ones of the next power is indexed with theirs too.
4. Signatures of rare tokens have at most `classes[0]` members: they are joined with themselves.  Members of
   another signature are first compared with its member that has lost the fewest tokens before it; only
   members that this leaves in different components are compared with each other, within bands of sizes that can link; in a
   crowd of more than `crowd`, sets that are made of the same long passages meet in longer combinations of whole passages
   instead (crowds.py), so templates don't make all their texts candidates of each other.
   A pair is dropped where what follows the signature in either order, and k - 1 tokens of each group before it,
   are too few for a link, which holds for no linked pair at its first common signature.
   Candidates are verified on all their shared tokens.

Links compare hashes: two different n-grams of one pair of documents count as one with odds of about
n * n / 2 ** 64 for sets of n tokens (5e-14 for a thousand tokens).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.llm.crowds import FEW, band, crowd_candidates, elements
from scholarframe.llm.shingles import mix, token_sets
from scholarframe.operators.components import connected_components
from scholarframe.plans.tables import settle
from scholarframe.plans.workers import handing_back

#: Upper bounds of the frequency classes but the last; the class at place i indexes combinations of i + 1 tokens.
CLASSES = (64, 4096)
#: Members of a signature beyond which those made of few heavy elements are compared by elements.
CROWD = 16
#: Tokens of a group that a prefix has, more or less.
GROUP = 8
#: Bits of the sieve of document ids, as a power of two: 8 MB, whatever the table.
SIEVE_BITS = 26
#: Rows of one Arrow batch of (token, document) pairs, more or less.
FLUSH = 1 << 18
#: Rows of texts, sets or pairs that a worker, and Spark beside it, holds as one Arrow batch.
BATCH_ROWS = 2048

_SIZED = "doc_id long, n int, fp binary"
_SETS = "ref long, doc_id long, n int, tokens array<bigint>"
_SIGNS = "ref long, n int, tokens binary, rare array<bigint>, rare_left array<int>, often array<bigint>, often_left array<int>"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    """Columns of a Spark schema's names; lists become arrays of the types named there."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def spare(n: int, percent: int) -> int:
    """Tokens that a set of n can miss in a link."""
    return n - -(-percent * n // 100)


def fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _sized(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Set size and fingerprint of each document."""
    for batch in batches:
        sets = [(len(s), fingerprint(s)) for s in token_sets(_texts(batch), size)]
        yield _batch([batch.column("doc_id"), [n for n, _ in sets], [f for _, f in sets]], _SIZED)


def _sampled(batches: Iterator[pa.RecordBatch], size: int, per_mille: int) -> Iterator[pa.RecordBatch]:
    """(token, doc_id) for the sampled hash values of each document."""
    tokens, ids, held = [], [], 0

    def flush() -> pa.RecordBatch:
        many = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), many))], ["token", "doc_id"])

    for batch in batches:
        for i, own in zip(batch.column("doc_id").to_pylist(), token_sets(_texts(batch), size), strict=True):
            own = own[(own >> np.uint64(20)) % np.uint64(1000) < per_mille]
            tokens.append(own)
            ids.append(i)
            held += len(own)
            if held >= FLUSH:
                yield flush()
                tokens, ids, held = [], [], 0
    if tokens:
        yield flush()


def _numbered_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sets of those documents whose text has the fingerprint asked for, each with a number of its own."""
    ref = TaskContext.get().partitionId() << 36
    for batch in batches:
        rows: list[tuple] = []
        for i, fp, own in zip(batch.column("doc_id").to_pylist(), batch.column("fp").to_pylist(), token_sets(_texts(batch), size), strict=True):
            if fingerprint(own) == fp:
                rows.append((ref, i, len(own), own.view(np.int64)))
                ref += 1
        yield _batch(list(zip(*rows, strict=True)) if rows else [[]] * 4, _SETS)


@cache
def _groups(level: int, percent: int, classes: int) -> int:
    """Groups of each upper class for sets of 2 ** level tokens up to twice as many, and smaller ones that link
    with those; 0 where such sets are too small to lose k - 1 tokens a group, so that all tokens are indexed singly."""
    least = max(1, -(-percent * (1 << level) // 100))
    room = -(-percent * least // 100) - 1
    return min(max(1, spare(2 << level, percent) // GROUP), room // max(1, classes * (classes - 1) // 2))


@cache
def _choices(many: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(many), k)), np.int64).reshape(-1, k)


def _combined(tokens: np.ndarray) -> np.ndarray:
    """One hash for each row of tokens, whatever their order in the row."""
    out = np.full(len(tokens), tokens.shape[1], np.uint64)
    for column in np.sort(tokens, axis=1).T:
        out = mix(out * np.uint64(0xA0761D6478BD642F) + column)
    return out


def signatures(n: int, tokens: np.ndarray, dfs: np.ndarray, percent: int, classes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Rare tokens, and hashes of combinations of others, that a set of n tokens is indexed by, each with the most tokens
    that can be common to a pair whose first common signature it is.

    tokens are those that other sets hold too, in order of (frequency, hash); dfs are their frequencies.
    """
    many, e = len(tokens), spare(n, percent)
    alone = n - many
    kind = np.searchsorted(np.array(classes), dfs)
    rare, rare_left, often, often_left = ([tokens[:0].astype(np.int64)] for _ in range(4))
    for level in range(n.bit_length() - 1, (100 * n // percent).bit_length()):
        groups = _groups(level, percent, len(classes) + 1)
        cell = np.where((kind > 0) & (groups > 0), (tokens % np.uint64(max(1, groups))).astype(np.int64) * len(classes) + kind, 0)
        k = np.where(cell > 0, kind + 1, 1)
        order = np.argsort(cell, kind="stable")
        sorted_cells = cell[order]
        place = np.empty(many, np.int64)
        place[order] = np.arange(many) - np.searchsorted(sorted_cells, sorted_cells)
        # A token among the first k - 1 of its cell adds nothing to what the prefix can count on.
        counts = place >= k - 1
        reach = np.flatnonzero(alone + np.cumsum(counts) > e)
        stop = int(reach[0]) + 1 if len(reach) else many
        left = many - np.arange(many) + np.cumsum(~counts) - ~counts
        single = np.flatnonzero(cell[:stop] == 0)
        rare.append(tokens[single].view(np.int64))
        rare_left.append(left[single])
        own = order[(order < stop) & (sorted_cells > 0)]
        for part in np.split(own, np.flatnonzero(np.diff(cell[own])) + 1) if len(own) else []:
            chosen = part[_choices(len(part), int(k[part[0]]))]
            often.append(_combined(tokens[chosen]).view(np.int64))
            often_left.append(left[chosen[:, -1]])
    return *_once(np.concatenate(rare), np.concatenate(rare_left)), *_once(np.concatenate(often), np.concatenate(often_left))


def _once(keys: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the largest of its numbers."""
    order = np.lexsort((-left, keys))
    keys = keys[order]
    first = np.diff(keys, prepend=keys[:1] - 1) != 0
    return keys[first], left[order][first].astype(np.int32)


def _signed(batches: Iterator[pa.RecordBatch], percent: int, classes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        shared = batch.column("shared")
        ends = shared.offsets.to_numpy() - shared.offsets[0].as_py()
        flat = shared.flatten()
        dfs, tokens = flat.field("df").to_numpy(), flat.field("token").to_numpy().view(np.uint64)
        for k, (ref, n) in enumerate(zip(batch.column("ref").to_pylist(), batch.column("n").to_pylist(), strict=True)):
            d, t = dfs[ends[k] : ends[k + 1]], tokens[ends[k] : ends[k + 1]]
            if n - len(t) > spare(n, percent):
                continue
            order = np.lexsort((t, d))
            rows.append((ref, n, np.sort(t).tobytes(), *signatures(n, t[order], d[order], percent, classes)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield _batch(cols, _SIGNS)


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for na, nb, ta, tb in zip(*(batch.column(k).to_pylist() for k in ("na", "nb", "ta", "tb")), strict=True):
            x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(100 * common >= percent * (na + nb - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets link."""
    side = lambda x: signs.select(F.col("ref").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ta", "tb")
    return full.mapInArrow(lambda it: handing_back(_verified(it, percent)), "a long, b long")


def _candidates(known: DataFrame, sized: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, fp, times) of the documents that the sampled hash values don't rule out; a doc_id of several rows always stays."""
    per_mille = min(1000, 20 * (100 - percent))
    pairs = known.mapInArrow(lambda it: handing_back(_sampled(it, size, per_mille)), "token long, doc_id long")
    once = pairs.groupBy("token").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last")
    rows = once.select("doc_id", F.lit(1).alias("alone"), F.lit(0).alias("times")).union(sized.where("doc_id is not null").select("doc_id", F.lit(0), F.lit(1)))
    counted = rows.groupBy(F.col("doc_id").alias("id")).agg(F.sum("alone").alias("alone"), F.sum("times").alias("times"))
    may = (F.col("times") > 1) | (F.col("alone") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
    return sized.where("n > 0").join(counted.where("times > 0"), F.col("doc_id") == F.col("id")).where(may).select("doc_id", "n", "fp", "times")


def _sieved(docs: DataFrame, ids: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """Rows of docs whose doc_id may be among `ids`: a bit for the hash of each, in blocks that are broadcast.

    It only spares the join that follows most texts that it would drop; the blocks have 2 ** bits bits at most."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    block, place = F.shiftright(slot, 15), slot.bitwiseAND(F.lit(32767).cast("long"))
    blocks = ids.select(block.alias("block"), place.alias("place")).groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("place") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.expr("shiftright(byte, cast(place % 8 AS int)) & 1") == 1
    told = docs.select("doc_id", "text", block.alias("block"), place.alias("place")).join(F.broadcast(blocks), "block")
    return told.withColumn("byte", byte).where(known).select("doc_id", "text")


def jaccard_classes(docs: DataFrame, size: int = 4, percent: int = 85, classes: tuple[int, ...] = CLASSES, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document: component_id is the smallest doc_id that links reach.

    docs has doc_id (long) and text (string); other columns are ignored.  A null or empty text
    has no tokens and links with nothing.  Rows that repeat a doc_id count as documents of
    their own; each yields a row, and the classes of that doc_id are one.  A null doc_id gets
    a null component_id and links nothing.  An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    sized = settle(docs.mapInArrow(lambda it: handing_back(_sized(it, size)), _SIZED), "sizes", BATCH_ROWS)
    able = settle(_candidates(docs.where("doc_id is not null"), sized, size, percent), "able", BATCH_ROWS)
    # Equal sets are one class; only its smallest document goes on.
    reps = settle(able.groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    wanted = reps.select(F.col("rep").alias("doc_id"), "fp")
    asked = _sieved(docs, wanted).join(wanted, "doc_id")
    sets = settle(asked.mapInArrow(lambda it: handing_back(_numbered_sets(it, size)), _SETS), "sets", BATCH_ROWS)

    # Frequencies, and each set's tokens that others hold.
    held = sets.select("ref", F.explode("tokens").alias("token"))
    # Settled, so that both sides of the join are plain shuffles and a token that very many sets hold can be split.
    often = settle(held.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "frequencies")
    shared = held.join(often, "token").groupBy("ref").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    shared = shared.join(sets.select("ref", "n"), "ref")
    signs = settle(shared.select("ref", "n", "shared").mapInArrow(lambda it: handing_back(_signed(it, percent, classes)), _SIGNS), "signatures", BATCH_ROWS)

    def postings(rows: DataFrame, kind: str, tag: str, *more: str) -> DataFrame:
        """A row for each signature; left: the most tokens that can be common from this one on."""
        out = rows.select("ref", "n", *more, F.explode(F.arrays_zip(F.col(kind).alias("sig"), F.col(f"{kind}_left").alias("left"))).alias("p"))
        return out.select("p.sig", F.col("ref").alias(tag or "ref"), F.col("n").alias(f"n{tag}"), F.col("p.left").alias(f"left{tag}"), *more)

    # At the first common signature of a pair, all that stands before it in either order is not common, but for k - 1 tokens a group.
    most = F.least("lefta", "leftb")
    may_link = 100 * most >= percent * (F.col("na") + F.col("nb") - most)

    rare = postings(signs, "rare", "a").join(postings(signs, "rare", "b"), "sig").where((F.col("a") < F.col("b")) & may_link).select("a", "b")
    combined = postings(signs, "often", "a")
    pivot = F.min(F.struct((F.col("na") - F.col("lefta")).alias("lost"), F.col("a").alias("b"), F.col("na").alias("nb"), F.col("lefta").alias("leftb")))
    pivots = settle(combined.groupBy("sig").agg(pivot.alias("p"), F.count("*").alias("members")).where("members > 1").select("sig", "p"), "pivots")
    star = combined.join(pivots, "sig").select("a", "na", "lefta", "p.*").where((F.col("a") != F.col("b")) & may_link)
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = settle(_linked(rare.union(star).distinct(), signs, percent), "links", BATCH_ROWS)
    parts = connected_components(links, "a", "b")

    placed = signs.join(parts, F.col("ref") == F.col("id"), "left").withColumn("at", F.coalesce("component", "ref"))
    placed = postings(placed, "often", "", "at")
    mixed = placed.groupBy("sig").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("members")).where("lo <> hi")
    apart = settle(placed.join(mixed.select("sig", (F.col("members") > crowd).alias("crowded")), "sig"), "apart")
    if not apart.isEmpty():
        # Sets of crowds that are made of few heavy elements are compared by those; pairs of others by the signatures.
        crowds = apart.where("crowded").select("ref", "at").distinct()
        listed = elements(sets.join(crowds.select("ref"), "ref", "left_semi"), percent)
        listed = settle(listed.where(F.size(F.filter("el", lambda e: e["before"] <= F.col("budget"))) <= FEW).join(crowds, "ref"), "heavy")
        by_elements = crowd_candidates(listed, percent)
        apart = apart.join(listed.select("ref", F.lit(True).alias("known")), "ref", "left")
        heavy = F.col("crowded") & F.coalesce("known", F.lit(False))
        side = lambda x, bands, slots: apart.select("sig", bands.alias("band"), slots.alias("slot"), *(F.col(c).alias(f"{t}{x}") for c, t in (("ref", ""), ("n", "n"), ("left", "left"), ("at", "at"))))
        own = band(F.col("n"), percent)
        # The smaller set asks in its own band and the next; two heavy sets of a crowd have no slot in common.
        smaller = side("a", F.explode(F.array(own, own + 1)), F.when(heavy, 1).otherwise(0))
        larger = side("b", own, F.when(heavy | ~F.col("crowded"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).withColumn("slot", F.explode("slot"))
        first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
        across = smaller.join(larger, ["sig", "band", "slot"]).where(first & (F.col("ata") != F.col("atb")) & may_link).select("a", "b")
        more = settle(_linked(across.union(by_elements).distinct(), signs, percent), "links", BATCH_ROWS)
        if not more.isEmpty():
            parts = connected_components(links.union(more), "a", "b")

    # A class of sets is named by its smallest document.
    placed = sets.select("ref", "doc_id").join(parts, F.col("ref") == F.col("id"), "left").select("doc_id", F.coalesce("component", "ref").alias("at"))
    least = settle(placed.groupBy("at").agg(F.min("doc_id").alias("component")), "least")
    of_rep = settle(placed.join(least, "at").groupBy(F.col("doc_id").alias("rep")).agg(F.min("component").alias("component")), "classes")
    member = able.join(reps, ["fp", "n"]).select("doc_id", "rep", "times")
    if not able.where("times > 1").isEmpty():
        # A doc_id of several rows joins the classes of all its sets.
        several = member.where("times > 1").join(of_rep, "rep").select("doc_id", "component")
        of_rep = connected_components(several.union(of_rep.select("rep", "component")), "doc_id", "component").withColumnRenamed("id", "rep")
    final = member.join(of_rep, "rep").groupBy(F.col("doc_id").alias("known")).agg(F.min("component").alias("component"))
    out = sized.join(final, F.col("doc_id") == F.col("known"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
