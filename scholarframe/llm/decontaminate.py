"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Words are runs of bytes other than ASCII space, punctuation and control bytes, A-Z lower-cased.
A text is normalised to its words, one space around each; a pattern is an item's run of `window`
consecutive words, spaces included, so that a match begins and ends at word bounds.  Each task
builds the automaton once and scans each text once; offsets map matches back to the words and
to the original bytes.  Patterns are made and grouped by Spark and written to the shared folder in
blocks of about `block` by their hash; a worker reads and holds one block at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.plans.tables import settle, shared_dir
from scholarframe.plans.workers import handing_back

#: Patterns that one automaton holds, more or less, about 100 bytes each and some hundreds more in its states.
BLOCK_PATTERNS = 200_000
#: Bytes of rows scanned between two builds of an automaton, where there are several blocks.
GATHERED = 64 << 20
#: Every ASCII byte outside words becomes a space; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")

_built: dict[tuple[str, int], object] = {}


class Blocks(NamedTuple):
    """Where the patterns are, and in how many blocks."""

    folder: str
    number: int


def fold(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows(text: bytes, window: int) -> set[str]:
    """An item's patterns: its runs of `window` words, or all its words if it has fewer."""
    words = fold(text)
    runs = [words[k : k + window] for k in range(max(1, len(words) - window + 1))] if words else []
    return {f" {b' '.join(run).decode('latin-1')} " for run in runs}


def _block(folder: str, block: int) -> Iterator[tuple[bytes, list[str]]]:
    """A block's patterns with their items; a block without any has no folder."""
    from pyarrow import dataset
    from pyarrow.fs import FileSystem, FileType

    files, root = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    if files.get_file_info(f"{root}/block={block}").type == FileType.NotFound:
        return
    for batch in dataset.dataset(f"{root}/block={block}", format="parquet", filesystem=files).to_batches(columns=["pattern", "items"]):
        yield from zip(batch.column("pattern").to_pylist(), batch.column("items").to_pylist(), strict=True)


def _automaton(held: Blocks, block: int):
    """A block's automaton; a worker holds the last one it built."""
    key = held.folder, block
    if key not in _built:
        import ahocorasick

        _built.clear()
        automaton = ahocorasick.Automaton()
        automaton.add_word("  ", (1, ()))
        for pattern, items in _block(*key):
            automaton.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, tuple(items)))
        automaton.make_automaton()
        _built[key] = automaton
    return _built[key]


def scan(text: bytes, automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, first and last word of every match, and the items found."""
    words = fold(text)
    found = list(automaton.iter(f" {b' '.join(words).decode('latin-1')} ")) if words else []
    if not found:
        return len(words), [], set()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = np.searchsorted(ends, [end for end, _ in found]).tolist()
    return len(words), [(at - many + 1, at) for at, (_, (many, _)) in zip(last, found, strict=True)], set().union(*(names for _, (_, names) in found))


def merge(runs: list[tuple[int, int]]) -> list[list[int]]:
    """Runs of words with no word twice, in order."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


_FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first_byte:long,end_byte:long>>"
_SPANS = pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64())]))


def _gathered(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """The batches as they are for one block; for several, joined, so that a worker that holds one
    automaton at a time builds each of them once for `GATHERED` bytes and not once for a batch."""
    if blocks == 1:
        yield from batches
        return
    own: list[pa.RecordBatch] = []
    for batch in batches:
        own.append(batch)
        if sum(b.nbytes for b in own) >= GATHERED:
            yield from pa.Table.from_batches(own).combine_chunks().to_batches()
            own = []
    if own:
        yield from pa.Table.from_batches(own).combine_chunks().to_batches()


def _scanned(batches: Iterator[pa.RecordBatch], held: Blocks) -> Iterator[pa.RecordBatch]:
    for batch in _gathered(batches, held.number):
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        n_words = [0] * len(texts)
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for block in range(held.number):
            automaton = _automaton(held, block)
            for k, text in enumerate(texts):
                n_words[k], own, names = scan(text, automaton)
                runs[k] += own
                items[k] |= names
        n_hit, spans = [], []
        for text, own in zip(texts, map(merge, runs), strict=True):
            at = [m.span() for m in _WORD.finditer(text.translate(FOLD))] if own else []
            n_hit.append(sum(b - a + 1 for a, b in own))
            spans.append([{"first_byte": at[a][0], "end_byte": at[b][1]} for a, b in own])
        cols = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(sorted, items), pa.list_(pa.string())), pa.array(spans, _SPANS)]
        yield pa.record_batch(cols, ["doc_id", "n_words", "n_hit", "items", "spans"])


def _blocks(benchmark: DataFrame, window: int, block: int) -> Blocks:
    """The benchmark's patterns with the items that hold each, in the shared folder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = [p.encode("latin-1") for p in windows(text or b"", window)]
                yield pa.record_batch([pa.array(own, pa.binary()), pa.array([item] * len(own), pa.string())], ["pattern", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, "pattern binary, item string")
    held = settle(rows.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items")), "patterns")
    number = max(1, -(-held.count() // block))
    folder = f"{shared_dir(benchmark.sparkSession)}/blocks-{uuid.uuid4().hex}"
    held.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(number))).repartition(number, "block").write.partitionBy("block").parquet(folder)
    return Blocks(folder, number)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = BLOCK_PATTERNS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each document.

    docs has doc_id (long) and text, benchmark item_id and text; other columns are ignored.  A
    null text has no words.  Rows that repeat a doc_id are scanned each for itself, and null ids
    are kept.  spans are byte ranges of the UTF-8 text, merged.  An item without an id hits words but has no name
    in items.  Repeated items count once.  An empty benchmark hits nothing.  With several blocks a document is scanned once per
    block and its runs are united.
    """
    held = _blocks(benchmark, window, block)
    return docs.select("doc_id", "text").mapInArrow(lambda it: handing_back(_scanned(it, held)), _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = BLOCK_PATTERNS) -> DataFrame:
    """The rows of docs, all their columns kept, whose text no pattern occurs in."""
    held = _blocks(benchmark, window, block)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, held.number):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            good = [True] * len(texts)
            for block in range(held.number):
                automaton = _automaton(held, block)
                good = [ok and not scan(text, automaton)[1] for ok, text in zip(good, texts, strict=True)]
            yield batch.select(names).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lambda it: handing_back(run(it)), docs.schema)
