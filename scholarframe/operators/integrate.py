"""Entity resolution: records of the same work are clustered and reconciled field by field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.functions.text import let, normalize_doi, normalize_title, surname, work_key
from scholarframe.operators.components import connected_components
from scholarframe.plans.tables import settle
from scholarframe.plans.workers import handing_back

#: Rank of sources; all others come after.
PRIORITY = ("crossref", "openalex", "europepmc", "pubmed", "doaj")
#: Titles of a surname, and characters in them, that one task compares with each other at once; larger surnames are cut into such tiles.
TILE, TILE_CHARS = 1024, 1 << 22
#: Numbers that one step of a comparison holds, and squares of group sizes that make a task.
AT_ONCE, PAIRS = 1 << 18, 1 << 22


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler with a prefix of four and scale 0.1 at any base similarity; transpositions stay fractional."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    ours = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            ours.append(c)
    if not ours:
        return 0.0
    theirs = [c for c, unused in zip(b, free, strict=True) if not unused]
    m = len(ours)
    swaps = sum(x != y for x, y in zip(ours, theirs, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    return jaro + 0.1 * _prefix(a, b) * (1 - jaro)


class Profiles:
    """Texts by their characters: codes in a row, and for each text the places of every character, in order."""

    def __init__(self, texts: list[str]) -> None:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, codes = np.unique(codes, return_inverse=True)
        codes = codes.astype(np.uint8 if len(kinds) <= 1 << 8 else np.uint16 if len(kinds) <= 1 << 16 else np.int32)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(self.lengths)
        own = np.repeat(np.arange(len(texts), dtype=np.uint16 if len(texts) <= 1 << 16 else np.int64), self.lengths)
        order = np.argsort(codes, kind="stable")
        order = order[np.argsort(own[order], kind="stable")]
        self.places = (order - (ends - self.lengths)[own]).astype(np.int32)  # by text, then by character
        self.cut = [codes[end - n : end] for end, n in zip(ends.tolist(), self.lengths.tolist(), strict=True)]
        counts = np.bincount(own.astype(np.int64) * len(kinds) + codes, minlength=len(texts) * len(kinds)).reshape(len(texts), len(kinds))
        self.first = (np.cumsum(counts).reshape(counts.shape) - counts).astype(np.int32)  # where the places of a text's character begin
        self.counts = counts.astype(np.int16 if counts.max(initial=0) < 1 << 15 else np.int32)
        self.begins = np.full((len(texts), 4), -1, np.int32)
        for at in range(4):
            held = np.flatnonzero(self.lengths > at)
            self.begins[held, at] = codes[(ends - self.lengths)[held] + at]


def _in_order(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... as many as asked of each, one after the other."""
    ends = np.cumsum(many, dtype=np.int32)
    return np.repeat(starts - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


def _within_reach(held: Profiles, at: np.ndarray, ours: np.ndarray, our_many: np.ndarray, theirs: np.ndarray, their_many: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, place in ours, place in theirs) of matches, one character an item, whose places are gone through from the at-th on, all items at once."""
    i, k, live, found = at.copy(), at.copy(), np.arange(len(ours)), []
    while len(live):
        p, q = held.places[ours[live] + i[live]], held.places[theirs[live] + k[live]]
        far = reach[live]
        met, late = np.abs(p - q) <= far, q < p - far
        found.append((live[met], p[met], q[met]))
        i[live] += ~late
        k[live] += met | late
        live = live[(i[live] < our_many[live]) & (k[live] < their_many[live])]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _jaro(held: Profiles, x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Jaro similarity of pairs of texts, in time linear in them; `shared` has how often each character stands in both.

    Equal characters are matched in order, so the k-th of one text meets the k-th of the other as long as all of that character lie within
    reach; the others are gone through one by one."""
    a, b = held.lengths[x], held.lengths[y]
    reach = np.maximum(a, b) // 2 - 1
    pair, code = np.nonzero(shared)
    many = shared[pair, code].astype(np.int32)
    ours, theirs = held.first[x[pair], code], held.first[y[pair], code]
    i, j = held.places[_in_order(ours, many)], held.places[_in_order(theirs, many)]
    at = np.repeat(pair.astype(np.int32), many)
    far = np.flatnonzero(np.abs(i - j) > reach.astype(np.int32)[at])
    if len(far):
        # The places before a character's first that is out of reach stand.
        ends = np.cumsum(many)
        odd, first = np.unique(np.searchsorted(ends, far, "right"), return_index=True)
        stands = many.copy()
        stands[odd] = far[first] - (ends - many)[odd]
        kept = _in_order(ends - many, stands)
        own, other = x[pair[odd]], y[pair[odd]]
        item, p, q = _within_reach(held, stands[odd], ours[odd], held.counts[own, code[odd]], theirs[odd], held.counts[other, code[odd]], reach[pair[odd]])
        i, j, at = np.concatenate([i[kept], p]), np.concatenate([j[kept], q]), np.concatenate([at[kept], pair[odd][item]])
    matched = np.bincount(at, minlength=len(x))

    def in_text(texts: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
        taken = np.zeros(lengths.sum(), bool)
        taken[(np.cumsum(lengths) - lengths)[at] + places] = True
        return np.concatenate([held.cut[k] for k in texts.tolist()])[taken]

    moved = np.flatnonzero(in_text(x, a, i) != in_text(y, b, j))
    swaps = np.bincount(np.repeat(np.arange(len(x)), matched)[moved], minlength=len(x)) / 2
    m = np.maximum(matched, 1)
    return np.where(matched > 0, (m / a + m / b + (m - swaps) / m) / 3, 0.0)


def _alike(held: Profiles, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether `jaro_winkler` of each pair of texts, by their numbers, reaches the threshold.

    At most as many characters match as the pair has in common by count, which rules many pairs out; the others are compared."""
    out = (x == y) & (threshold <= 1)
    step = max(1, AT_ONCE // max(64, held.counts.shape[1]))
    for start in range(0, len(x), step):
        own, other = x[start : start + step], y[start : start + step]
        shared = np.minimum(held.counts[own], held.counts[other])
        most = shared.sum(1, dtype=np.int64)
        begin = held.begins[own]
        prefix = 0.1 * np.cumprod((begin == held.begins[other]) & (begin >= 0), axis=1).sum(1)
        a, b = held.lengths[own], held.lengths[other]
        bound = (most / np.maximum(a, 1) + most / np.maximum(b, 1) + 1) / 3
        left = np.flatnonzero((bound + prefix * (1 - bound) >= threshold - 1e-9) & (most > 0) & (own != other))
        chars = np.cumsum((a + b)[left])
        for part in np.split(left, np.flatnonzero(np.diff(chars // AT_ONCE)) + 1) if len(left) else ():
            jaro = _jaro(held, own[part], other[part], shared[part])
            out[start + part] = jaro + prefix[part] * (1 - jaro) >= threshold
    return out


def similar(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """Whether `jaro_winkler` of each pair reaches the threshold."""
    texts = list(dict.fromkeys([*a, *b]))
    number = {t: k for k, t in enumerate(texts)}
    return _alike(Profiles(texts), np.array([number[t] for t in a], int), np.array([number[t] for t in b], int), threshold)


def _prefix(a: str, b: str) -> int:
    """Characters that both begin with, four at most."""
    return next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))


def _met(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    """(a, b): the texts of whole groups (block, x, y) that are similar and may be of one year; where x <> y, only those of two sides meet."""
    column = lambda c: rows.column(c).to_numpy()
    group, n = _numbered_groups(rows), column("n").astype(np.int64)
    order = np.lexsort((n, group))
    group, n = group[order], n[order]
    ident, side, bare, unbound, lo, hi = (column(c)[order] for c in ("text_id", "side", "bare", "open", "lo", "hi"))
    held = Profiles(rows.column("t").take(pa.array(order)).to_pylist())
    # No match is longer than the shorter text, so lengths within this share only can link.
    share = max(5 * threshold - 4, 1e-3)
    width = n.max() + 1
    longest = np.minimum(np.floor((n + 1e-6) / share), n.max()).astype(np.int64)
    partners = np.searchsorted(group * width + n, group * width + longest, "right") - np.arange(len(n)) - 1
    first, second, done = [], [], np.cumsum(partners)
    for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(done // AT_ONCE)) + 1):
        x = np.repeat(part, partners[part])
        y = np.repeat(part + 1 - (done[part] - partners[part]), partners[part]) + np.arange(done[part[0]] - partners[part[0]], done[part[-1]])
        may = (bare[x] | bare[y]) & (unbound[x] | unbound[y] | ((lo[x] <= hi[y] + 1) & (lo[y] <= hi[x] + 1))) & ((side[x] < 0) | (side[x] != side[y]))
        x, y = x[may], y[may]
        alike = _alike(held, x, y, threshold)
        first.append(ident[x[alike]])
        second.append(ident[y[alike]])
    a, b = np.concatenate(first), np.concatenate(second)
    return pa.record_batch([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _numbered_groups(rows: pa.Table) -> np.ndarray:
    """The number of each row's group (block, x, y), whose rows follow each other."""
    new = np.zeros(max(len(rows) - 1, 0), bool)
    for name in ("block", "x", "y"):
        column = rows.column(name)
        new |= pc.not_equal(column.slice(1), column.slice(0, max(len(rows) - 1, 0))).to_numpy()
    return np.concatenate([np.zeros(min(len(rows), 1), np.int64), np.cumsum(new)])


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """`_met` over rows sorted by group: several small groups at once, large ones alone."""
    waiting: list[pa.Table] = []
    for batch in handing_back(batches):
        rows = pa.Table.from_batches([batch])
        while len(rows):
            rows = pa.concat_tables([*waiting, rows])
            group, chars = _numbered_groups(rows), np.cumsum(rows.column("n").to_numpy())
            begins = np.flatnonzero(np.diff(group)) + 1
            # What is sure to be whole, up to the group that fills a tile.
            enough = begins[(begins >= TILE) | (chars[begins - 1] >= TILE_CHARS)]
            if not len(enough):
                waiting = [rows]
                break
            yield _met(rows.slice(0, enough[0]), threshold)
            waiting, rows = [], rows.slice(enough[0])
    if waiting:
        yield _met(pa.concat_tables(waiting), threshold)


def _tiled(texts: DataFrame) -> DataFrame:
    """texts with the groups (block, x, y) in which they are compared, and their side of each.

    A surname of few titles is one group. Of others, each year is cut into tiles of at most about TILE titles, as are those of no or several
    years; a group is a tile by itself, or two that may have titles of neighbouring years."""
    texts = texts.withColumn("year", F.when(~F.col("open") & (F.col("lo") == F.col("hi")), F.col("lo")))
    sizes = settle(texts.groupBy("block", "year").agg(F.count("*").alias("many"), F.sum("n").alias("chars")), "sizes")
    large = sizes.groupBy("block").agg(F.sum("many").alias("many"), F.sum("chars").alias("chars")).where((F.col("many") > TILE) | (F.col("chars") > TILE_CHARS)).select("block")
    parts = settle(sizes.join(large, "block").select("block", "year", F.ceil(F.greatest(F.col("many") / TILE, F.col("chars") / TILE_CHARS)).cast("int").alias("parts")), "parts")
    tile = lambda part: F.concat_ws("/", F.coalesce(F.col("year").cast("string"), F.lit("any")), part.cast("string"))
    tiles = parts.select("block", "year", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("block", "year", tile(F.col("part")).alias("tile"))
    side = lambda x: tiles.select("block", F.col("year").alias(f"{x}_year"), F.col("tile").alias(x))
    near = F.col("x_year").isNull() | F.col("y_year").isNull() | (F.abs(F.col("x_year") - F.col("y_year")) <= 1)
    groups = side("x").join(side("y"), "block").where((F.col("x") <= F.col("y")) & near).select("block", "x", "y")
    alone = F.array(F.struct(F.lit(-1).alias("side"), F.col("x").alias("tile")))
    sides = F.when(F.col("x") == F.col("y"), alone).otherwise(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("tile")) for k, c in enumerate("xy"))))
    asked = groups.select("block", "x", "y", F.explode(sides).alias("s")).select("block", "x", "y", "s.side", "s.tile")
    p = parts.select(F.col("block").alias("p_block"), F.col("year").alias("p_year"), "parts")
    dealt = texts.join(p, (F.col("block") == F.col("p_block")) & F.col("year").eqNullSafe(F.col("p_year")))
    dealt = dealt.withColumn("tile", tile(F.pmod(F.xxhash64("text_id"), F.col("parts")))).join(asked, ["block", "tile"])
    whole = texts.join(parts.select("block").distinct(), "block", "left_anti").select("*", F.lit("").alias("x"), F.lit("").alias("y"), F.lit(-1).alias("side"))
    shown = ("block", "x", "y", "side", "text_id", "t", "n", "bare", "open", "lo", "hi")
    return whole.select(*shown).unionByName(dealt.select(*shown))


def similar_texts(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of text_id of one block whose texts are similar, one of them with a record without a DOI, and that may be of neighbouring years.

    texts has block, text_id, t (not empty), its length n, bare, open (some record has no year), lo and hi (the first and last year)."""
    tiled = settle(_tiled(texts), "tiled")
    sizes = tiled.groupBy("block", "x", "y").agg(F.count("*").alias("many")).agg(F.sum(F.col("many") * F.col("many"))).first()[0] or 0
    least = tiled.sparkSession.sparkContext.defaultParallelism
    dealt = tiled.repartition(int(min(max(2 * least, sizes // PAIRS), 50_000)), "block", "x", "y").sortWithinPartitions("block", "x", "y")
    return dealt.mapInArrow(lambda it: _compared(it, threshold), "a long, b long")


#: Fixed values of the same-work guard: characters of an abstract that count, and the least Jaccard of their words.
SAME_WORK = (1000, 0.3)


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the normalised words of two abstracts' beginnings; null where either has none to compare."""
    words = lambda text: F.array_distinct(F.filter(F.split(normalize_title(F.substring(text, 1, SAME_WORK[0])), " "), lambda w: w != ""))
    both = lambda p: F.when((F.size(p["a"]) > 0) & (F.size(p["b"]) > 0), F.size(F.array_intersect(p["a"], p["b"])) / F.size(F.array_union(p["a"], p["b"])))
    return let(F.struct(words(F.coalesce(a, F.lit(""))).alias("a"), words(F.coalesce(b, F.lit(""))).alias("b")), both)


def same_work(a: Column, b: Column) -> Column:
    """Whether two works of one hashed key may be the same: their abstracts overlap, or one has none to tell by."""
    return F.coalesce(word_overlap(a, b) >= SAME_WORK[1], F.lit(True))


def doi_edges(works: DataFrame) -> DataFrame:
    """Star edges from each record to the first of its DOI: linear in the records, whatever the group."""
    keyed = works.select("ord", normalize_doi(F.col("doi")).alias("key")).where("key is not null")
    firsts = keyed.groupBy("key").agg(F.min("ord").alias("first"))
    return keyed.join(firsts, "key").where("ord <> first").select("first", "ord")


def fuzzy_edges(works: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Pairs with the same surname, years at most one apart (null passes) and similar titles; one side lacks a DOI.

    Records of one block, year and title are the same pair, so distinct ones meet and equal ones are stars.  A title is compared with each
    other one of its block once, whatever its years: groups of titles are compared in their task, and only similar pairs leave it."""
    keyed = works.select("ord", "year", normalize_doi(F.col("doi")).isNull().alias("bare"), surname(F.col("authors")).alias("block"), normalize_title(F.col("title")).alias("t"))
    keyed = settle(keyed, "keyed").where("block is not null and t <> ''")  # a filter before would normalise each title twice
    keys = settle(keyed.groupBy("block", "year", "bare", "t").agg(F.min("ord").alias("rep")), "keys")
    held = F.collect_list(F.struct("rep", "year", "bare"))
    texts = keys.groupBy("block", "t").agg(F.min("rep").alias("text_id"), F.bool_or("bare").alias("bare"), F.bool_or(F.col("year").isNull()).alias("open"), F.coalesce(F.min("year"), F.lit(0)).alias("lo"), F.coalesce(F.max("year"), F.lit(0)).alias("hi"), held.alias("held"))
    texts = settle(texts.withColumn("n", F.length("t")), "texts")
    found = settle(similar_texts(texts.drop("held"), threshold), "similar")
    own = texts.where("bare and size(held) > 1").select(F.col("text_id").alias("a"), F.col("text_id").alias("b"))
    side = lambda x: texts.select(F.col("text_id").alias(x), F.explode("held").alias("h")).select(x, *(F.col(f"h.{c}").alias(f"{x}_{c}") for c in ("rep", "year", "bare")))
    near = F.col("a_year").isNull() | F.col("b_year").isNull() | (F.abs(F.col("a_year") - F.col("b_year")) <= 1)
    met = found.unionByName(own).join(side("a"), "a").join(side("b"), "b").where((F.col("a") != F.col("b")) | (F.col("a_rep") < F.col("b_rep")))
    alike = settle(met.where((F.col("a_bare") | F.col("b_bare")) & near).select("a_rep", "b_rep", "a_bare", "b_bare"), "alike")
    k = keys.select("rep", *(F.col(c).alias(f"k_{c}") for c in ("block", "year", "bare", "t")))
    same = (F.col("block") == F.col("k_block")) & F.col("year").eqNullSafe(F.col("k_year")) & (F.col("bare") == F.col("k_bare")) & (F.col("t") == F.col("k_t"))
    members = settle(keyed.join(k, same).select("ord", "rep", "bare"), "members")
    # Records without a DOI match their own key; those with one match only a key without.
    own = members.where("bare and ord <> rep").select(F.col("rep").alias("first"), "ord")
    bare = alike.where("a_bare and b_bare").select(F.col("a_rep").alias("first"), F.col("b_rep").alias("ord"))
    mixed = alike.where("a_bare <> b_bare").select(F.when(F.col("a_bare"), F.col("a_rep")).otherwise(F.col("b_rep")).alias("first"), F.when(F.col("a_bare"), F.col("b_rep")).otherwise(F.col("a_rep")).alias("rep"))
    # All of these are linked by one of the keys without, so the others need only the first of them.
    lead = mixed.groupBy("rep").agg(F.min("first").alias("first")).join(members.select("rep", "ord"), "rep").select("first", "ord")
    return own.union(bare).union(mixed.select("first", "rep")).union(lead)


def cluster(works: DataFrame, edges: DataFrame) -> DataFrame:
    """works with `cluster`, the smallest ord of the record's component."""
    parts = connected_components(edges, "first", "ord")
    return works.join(parts, works.ord == parts.id, "left").withColumn("cluster", F.coalesce("component", "ord")).drop("id", "component")


def source_rank() -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source_id")), F.lit(0)), F.lit(len(PRIORITY) + 1))


def pick_bibliographic(works: DataFrame) -> Column:
    """Aggregate: the whole `biblio` struct of the highest source that has any of its fields, never fields of two sources."""
    fields = works.schema["biblio"].dataType.fieldNames()
    some = F.coalesce(*(F.col(f"biblio.{f}").cast("string") for f in fields)).isNotNull()
    return F.min_by(F.when(some, F.col("biblio")), F.when(some, F.struct(source_rank(), "ord")))


def union_topics(works: DataFrame) -> DataFrame:
    """(cluster, topics): array<struct<name, score>>, each name once with its largest score, best first, ties by first sight."""
    said = works.select("cluster", "ord", F.posexplode("topics").alias("i", "t"))
    best = said.groupBy("cluster", "t.name").agg(F.max("t.score").alias("score"), F.min(F.struct("ord", "i")).alias("first"))
    listed = best.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "first", "name", "score"))).alias("all"))
    return listed.select("cluster", F.transform("all", lambda t: F.struct(t["name"].alias("name"), t["score"].alias("score"))).alias("topics"))


def reconcile(works: DataFrame) -> DataFrame:
    """One row per cluster, every field by its own rule of survivorship; `works` has a cluster column.

    Where works have a struct `biblio` or an array `topics` of (name, score), the result has them too. Where they have `abstract_length`,
    `abstract` is what is asked of an abstract of that length, and that of the longest survives."""
    rows = works.withColumn("prio", source_rank()).withColumn("n_doi", normalize_doi(F.col("doi")))
    said = lambda c: F.nullif(F.col(c), F.lit(""))

    def first(value: Column, when: Column, *order: Column) -> Column:
        return F.min_by(F.when(when, value), F.when(when, F.struct(*order)))

    def longest(value: str) -> Column:
        return F.max_by(said(value), F.when(said(value).isNotNull(), F.struct(F.length(value), -F.col("ord"))))

    titled = said("title").isNotNull() & (F.col("title") != "Untitled")
    reduced = F.max_by("abstract", F.when(F.col("abstract_length") > 0, F.struct("abstract_length", -F.col("ord")))) if "abstract_length" in works.columns else longest("abstract")
    tier = F.when(F.col("source_id") == "unpaywall", 0).when(F.coalesce("is_oa", F.lit(False)), 1).otherwise(2)
    orcids = F.size(F.filter("authors", lambda a: a["orcid"].isNotNull()))
    merged = rows.groupBy("cluster").agg(
        F.coalesce(first(F.col("title"), titled, F.col("prio"), F.col("ord")), longest("title"), F.lit("Untitled")).alias("title"),
        reduced.alias("abstract"),
        first(F.col("n_doi"), F.col("n_doi").isNotNull(), (F.col("source_id") != "crossref").alias("x"), F.col("ord")).alias("doi"),
        F.max_by("authors", F.struct(orcids, F.size("authors"), -F.col("ord"))).alias("authors"),
        first(F.col("venue"), said("venue").isNotNull(), F.col("prio"), F.col("ord")).alias("venue"),
        F.max("citation_count").alias("citation_count"),
        F.coalesce(F.bool_or("is_oa"), F.lit(False)).alias("is_oa"),
        first(F.col("pdf_url"), said("pdf_url").isNotNull(), tier.alias("tier"), F.col("ord")).alias("pdf_url"),
        F.sort_array(F.collect_list(F.struct("ord", "source_id", "source_record_id", "citation_count"))).alias("sources"),
        *([pick_bibliographic(works).alias("biblio")] if "biblio" in works.columns else []),
    )
    if "topics" in works.columns:
        merged = merged.join(union_topics(works), "cluster", "left")
    # The commonest year; of ties that whose first record ranks highest, then the first seen.
    years = rows.where("year is not null").groupBy("cluster", "year").agg(F.count("*").alias("n"), F.min(F.struct("ord", "prio")).alias("f"))
    year = years.groupBy("cluster").agg(F.max_by("year", F.struct("n", -F.col("f.prio"), -F.col("f.ord"))).alias("year"))
    return merged.join(year, "cluster", "left").withColumn("work_key", work_key(F.col("doi"), F.col("title"), F.col("year"), surname(F.col("authors")), F.col("venue")))


def cluster_by_doi(works: DataFrame) -> DataFrame:
    """works with `cluster`, the smallest ord of the record's DOI, or its own: equality needs no iteration."""
    keyed = works.withColumn("key", normalize_doi(F.col("doi")))
    firsts = keyed.where("key is not null").groupBy("key").agg(F.min("ord").alias("cluster"), F.count("*").alias("n")).where("n > 1").drop("n")
    with_doi = keyed.where("key is not null").join(firsts, "key", "left").withColumn("cluster", F.coalesce("cluster", "ord"))
    return with_doi.drop("key").unionByName(keyed.where("key is null").drop("key").withColumn("cluster", F.col("ord")))
