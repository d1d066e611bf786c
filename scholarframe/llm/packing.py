"""Sum-of-squares packing of token sequences into fixed-length training sequences.

Documents are tokenised in tasks, cut into pieces only where they are longer than a sequence, and written
down; the pieces are dealt by a hash of their place there to groups of about `group_pieces`, whatever their
ids, so that no task sees more than one group.  Each group places its pieces, longest first, where the sum of
squares of the numbers of open sequences per residual gap becomes smallest; a new sequence is
opened only for a piece that fits into no open one.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.plans.tables import settle
from scholarframe.plans.workers import give_back, handing_back

#: Bytes of text tokenised at once.
SLICE = 4 << 20
#: Texts that a worker, and Spark beside it, holds as one Arrow batch.
BATCH_ROWS = 4096
#: Words whose ids a worker remembers, some 200 bytes each, in two halves: when the younger half is full the older one
#: goes, and words that were met meanwhile have moved on into the younger.
REMEMBERED = 600_000
#: Pieces of a packing group, more or less.
GROUP_PIECES = 8_192
_SEPARATOR = "|"
#: One closing mark after an ASCII letter or digit or a Latin letter that no normalisation changes.
_CLOSING = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,;:!?])(\s|$)"
#: Fixed value: how the vocabulary's file splits a text, white space left out.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

_loaded: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        (mark,) = tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids if _by_words(json.loads(tokenizer.to_str())) else (None,)
        _loaded[path] = tokenizer, mark, [{}, {}]
    return _loaded[path]


def _by_words(model: dict) -> bool:
    """Whether white space and case change no word's ids: the file has the normalisers and the splitting that
    `token_ids` counts on, and no added token but those that begin with <|."""
    steps = (model.get("normalizer") or {}).get("normalizers") or []
    splits = (model.get("pre_tokenizer") or {}).get("pretokenizers") or []
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    return (
        [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1] == blank
        and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": _SPLIT}
        and (splits[0]["behavior"], splits[0]["invert"], splits[1]["add_prefix_space"]) == ("Removed", True, False)
        and all(x["content"].startswith("<|") for x in model.get("added_tokens") or [])
    )


def _learn(words: list[str], tokenizer, mark: int, known: dict[str, bytes]) -> None:
    """Ids of words new to `known`, four bytes each.  White space separates words for the tokenizer, so one long
    text of them, a separator between each two, has each word's own ids."""
    plain = [w for w in words if _SEPARATOR not in w]
    for at in range(0, len(plain), 4096):
        part = plain[at : at + 4096]
        ids = np.array(tokenizer.encode(f" {_SEPARATOR} ".join(part), add_special_tokens=False).ids, np.int32)
        for word, own in zip(part, np.split(ids, np.flatnonzero(ids == mark)), strict=True):
            known[word] = own[own != mark].tobytes()
    odd = [w for w in words if _SEPARATOR in w]
    for word, code in zip(odd, tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
        known[word] = np.array(code.ids, np.int32).tobytes()


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Each text's ids, as the tokenizer gives them; null is empty.

    The vocabulary lower-cases, drops white space and never joins a letter and a full stop or
    comma, so each distinct word of a slice is tokenised once: ASCII letters are lower-cased and
    closing punctuation is set apart before.  Texts that may hold a special token's string are
    tokenised whole, and so are all texts where the file is of another kind (see `_by_words`).
    """
    tokenizer, mark, known = _tokenizer(path)
    texts = pc.fill_null(texts, "")
    if mark is None:
        for text in texts.to_pylist():
            yield np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return
    special = pc.match_substring(texts, "<|").to_pylist()
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _CLOSING, r"\1 \2\3"))
    coded = words.flatten().dictionary_encode()
    distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    young, old = known
    lacking = [w for w in distinct if w not in young]
    if len(young) + len(lacking) > REMEMBERED // 2:
        known[:] = young, old = {}, young
        lacking = distinct
    young.update((w, old[w]) for w in lacking if w in old)
    _learn([w for w in lacking if w not in young], tokenizer, mark, young)
    own = [young[w] for w in distinct]
    sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
    flat = np.frombuffer(b"".join(own), np.uint32)
    begin, many = (np.cumsum(sizes) - sizes)[code], sizes[code]
    ends = np.cumsum(many)
    ids = flat[np.repeat(begin - (ends - many), many) + np.arange(many.sum())] if len(code) else flat[:0]
    offsets = np.append(0, ends)[words.offsets.to_numpy() - words.offsets[0].as_py()]
    for k, whole in enumerate(special):
        if whole:
            yield np.array(tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
        else:
            yield ids[offsets[k] : offsets[k + 1]]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE, "right")) + at)
        yield texts[at:stop]
        at = stop


def _cut(batches: Iterator[pa.RecordBatch], path: str, limit: int, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        texts, names = batch.column("text"), iter(batch.column("doc_id").to_pylist())
        for part in _slices(texts):
            for ids in token_ids(part, path):
                ids, name = np.append(ids, np.uint32(end_id)).astype("<u4"), next(names)
                for piece, start in enumerate(range(0, len(ids), limit)):
                    own = ids[start : start + limit]
                    rows.append((name, piece, start, len(own), zlib.crc32(own.tobytes())))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], [x.split()[0] for x in _PIECE.split(", ")])


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and `end_id`, cut only beyond `limit`."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: handing_back(_cut(it, tokenizer_path, limit, end_id)), _PIECE)


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces in the given order, the number of the sequence each goes to, and its offset there."""
    count = np.zeros(limit + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(limit + 1)]
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.int64(1 << 60)
    for k, size in enumerate(lengths.tolist()):
        gaps = count[size:]
        # Taking gap g to gap g - size changes the sum by 2 * (count[g - size] - count[g] + 1); a gap
        # that closes adds nothing, so there the change is 1 - 2 * count[g].
        change = 2 * (count[: limit + 1 - size] - gaps + 1)
        change[0] -= 1
        change[gaps == 0] = far
        best = int(change.argmin())
        if change[best] < far:
            gap = best + size
            sequence = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, sequence, made = limit, made, made + 1
        where[k], offset[k] = sequence, limit - gap
        if gap > size:
            count[gap - size] += 1
            open_at[gap - size].append(sequence)
    return where, offset


def _packed(key: tuple, rows: pa.Table, limit: int) -> pa.Table:
    """A group's rows with their places; the order, and so the result, is the same on every attempt."""
    order = [("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "ids_crc32"))]
    rows = rows.drop_columns("pack").sort_by(order)
    where, offset = sum_of_squares(rows.column("length").to_numpy(), limit)
    give_back()
    return rows.append_column("sequence_id", pa.array(where + (key[0].as_py() << 36))).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    docs has doc_id (long) and text (string); other columns are ignored.  A null or empty text
    is the end id alone.  Rows that repeat a doc_id are packed each for itself, a null doc_id
    like any other.  An empty table gives no rows.  Sequence ids are unique, and a sequence's
    pieces lie without gaps from offset 0.
    """
    # Settled, so that a piece's place in the files is the same on every attempt, and the count reads no text.
    pieces = settle(token_pieces(docs, tokenizer_path, limit, end_id), "pieces", BATCH_ROWS)
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack").applyInArrow(lambda key, rows: _packed(key, rows, limit), f"{_PIECE}, sequence_id long, offset long")
