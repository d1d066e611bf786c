"""Pages into passages, positioned text into tables.  A document or page is one task's unit of work: both
operators go through a text or page from its start, so they are small helpers inside Spark's grouping."""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.functions.text import normalize_page

TARGET, OVERLAP = 1400, 200
_CHUNK = "chunk_index int, page_start int, page_end int, content string"


def break_at(text: str, start: int, end: int) -> int:
    """Where to end a passage: after the last paragraph, else sentence, else blank of its last 30 %, else at `end`."""
    floor = start + int((end - start) * 0.7)
    for marks in (("\n\n",), (". ", "? ", "! "), (" ",)):
        last, mark = max((text.rfind(m, floor, end), m) for m in marks)
        if last >= 0:
            return last + len(mark)
    return end


def chunk_text(pages: list[tuple[int, str]], target: int = TARGET, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, str]]:
    """(index, first page, last page, content) of overlapping passages over normalised pages."""
    pages = [(n, t) for n, t in pages if t]
    text = "\n\n".join(t for _, t in pages)
    ends, at = [], 0
    for k, (_, t) in enumerate(pages):
        at += len(t) + (2 if k else 0)
        ends.append(at)
    from bisect import bisect_right

    page = lambda pos: pages[bisect_right(ends, pos)][0]
    start = index = 0
    while start < len(text):
        hard = min(start + target, len(text))
        end = hard if hard == len(text) else break_at(text, start, hard)
        content = text[start:end].strip()
        if content:
            yield index, page(start), page(end - 1), content
            index += 1
        if end >= len(text):
            return
        start = max(start + 1, end - overlap)


def chunk_pages(pages: DataFrame, key: str, page_number: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, page_start, page_end, content) of each document; a document's pages meet in one row first."""
    plain = pages.select(key, F.col(page_number).cast("int").alias("n"), normalize_page(F.coalesce(text, F.lit(""))).alias("t"))
    whole = plain.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("pages"))
    kind = whole.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, *c) for k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in chunk_text([(p["n"], p["t"]) for p in own], target, overlap)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [key, "chunk_index", "page_start", "page_end", "content"])

    return whole.mapInArrow(run, f"{key} {kind}, {_CHUNK}")


Item = tuple[str, float, float, float, float]  # text, x, y, width, height
GAP_RATIO, MIN_LINES, MIN_COLUMNS, MIN_CONFIDENCE, CELL_CHARS = 2.2, 3, 2, 0.35, 25
_CAPTION = re.compile(r"(?:Table|TABLE|Tab\.)\s*\d+")


def lines_of(items: list[Item]) -> list[list[Item]]:
    """Items by baseline, top first: one within half the median height of a line's first item belongs to it."""
    usable = [i for i in items if i[0].strip()]
    out: list[list[Item]] = []
    if usable:
        near = max(1.0, median(i[4] for i in usable) * 0.5)
        for item in sorted(usable, key=lambda i: -i[2]):
            if out and abs(out[-1][0][2] - item[2]) <= near:
                out[-1].append(item)
            else:
                out.append([item])
    return [sorted(line, key=lambda i: i[1]) for line in out]


def _threshold(items: list[Item]) -> float:
    return max(GAP_RATIO * median(i[3] / len(i[0]) if i[0] else i[3] for i in items), 1.0)


def has_columns(line: list[Item]) -> bool:
    return len(line) > 1 and any(b[1] - (a[1] + a[3]) > _threshold(line) for a, b in zip(line, line[1:]))


def bands_of(items: list[Item], threshold: float) -> list[list[float]]:
    """Intervals of x that items cover, merged where they are at most `threshold` apart."""
    out: list[list[float]] = []
    for start, end in sorted((i[1], i[1] + i[3]) for i in items):
        if out and start - out[-1][1] <= threshold:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def confidence(grid: list[list[str]]) -> float:
    """Share of filled cells, times rows of the commonest fill, times short cells, to two places."""
    cells = [c for row in grid for c in row if c]
    if not cells:
        return 0.0
    filled = [sum(map(bool, row)) for row in grid]
    common = max(map(filled.count, filled)) / len(grid)
    short = sum(len(c) <= CELL_CHARS for c in cells) / len(cells)
    return int(len(cells) / (len(grid) * len(grid[0])) * common * short * 100 + 0.5) / 100


def tables_of(items: list[Item]) -> Iterator[tuple[str | None, list[list[str]], float]]:
    """(caption, grid, confidence) of each run of three lines or more with column gaps."""
    lines = lines_of(items)
    marks = [has_columns(line) for line in lines] + [False]
    start = None
    for k, mark in enumerate(marks):
        if mark and start is None:
            start = k
        if mark or start is None:
            continue
        region, first, start = lines[start:k], start, None
        if len(region) < MIN_LINES:
            continue
        flat = [i for line in region for i in line]
        bands = bands_of(flat, _threshold(flat))
        grid = [[""] * len(bands) for _ in region]
        for row, line in zip(grid, region, strict=True):
            for text, x, _, width, _ in line:
                overlap = [min(x + width, b) - max(x, a) for a, b in bands]
                column = overlap.index(max(overlap))
                row[column] = f"{row[column]} {text.strip()}".strip()
        sure = confidence(grid)
        if len(bands) >= MIN_COLUMNS and sure >= MIN_CONFIDENCE:
            around = [" ".join(i[0].strip() for i in lines[j]).strip() for j in (first - 1, k) if 0 <= j < len(lines)]
            yield next((t for t in around if _CAPTION.match(t)), None), grid, sure


_TABLE = "table_index int, caption string, grid array<array<string>>, confidence double"


def detect_tables(items: DataFrame, key: str) -> DataFrame:
    """(key, table_index, caption, grid, confidence); items(key, ord, text, x, y, width, height) of one page meet in one row."""
    page = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "text", "x", "y", "width", "height"))).alias("items"))
    kind = page.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            # Column by column: a row of structs as dicts costs more than what is found in it.
            flat = batch.column(1).flatten()
            items = list(zip(*(pc.struct_field(flat, c).to_pylist() for c in ("text", "x", "y", "width", "height")), strict=True))
            end = 0
            for k, many in zip(batch.column(0).to_pylist(), pc.list_value_length(batch.column(1)).to_pylist(), strict=True):
                start, end = end, end + many
                rows += [(k, n, *t) for n, t in enumerate(tables_of(items[start:end]))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.list_(pa.string())), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [key, "table_index", "caption", "grid", "confidence"])

    return page.mapInArrow(run, f"{key} {kind}, {_TABLE}")
