"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts: text, image, audio or document.  A visitor flattens them in
order: every part that is no text becomes one placeholder, whose attachment is recorded with
its turn, reference and the number of tokens that it expands to; texts next to each other are joined and
escaped as one, so no control string can form where two meet.  A conversation is formatted as

    <s>role[INST]content[/INST]</s>

for each turn.  A control string inside a text gets a backslash after its first character, one more
than stands there already, so it neither looks like a control string nor loses anything: removing one
backslash gives the text back.  A placeholder's string inside a text is escaped like the others, so
one that stands bare is a placeholder, and the parts can be read back.  The loss mask is a list of byte ranges over
the texts of the assistant's turns, placeholders left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.text import let

PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
#: Tokens of an attachment by its kind: so many for each unit (tiles, seconds, pages).
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 1024}
_REST = r"(?:/?s>|image>|audio>|document>)"
_ESCAPE = rf"(<(?=\\*{_REST})|\[(?=\\*/?INST\]))"
#: Between texts and placeholders: no characters, but the places before and after each placeholder.
_JOINTS = r"(?=<(?:image|audio|document)>)|(?<=<image>)|(?<=<audio>)|(?<=<document>)"

PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
_NO_ATTACHMENTS = "array<struct<turn:bigint,part:int,kind:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of `escape`: '<' or '[', one backslash or more, and the rest of a control string lose one."""
    return F.regexp_replace(F.regexp_replace(text, rf"<\\(?=\\*{_REST})", "<"), r"\[\\(?=\\*/?INST\])", "[")


def text_part(text: Column) -> Column:
    """A content of one text part; null is empty."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("units"))).cast(PARTS)


def _flatten(parts: Column) -> Column:
    """The content's string: parts in order, joined texts escaped, others a placeholder; an unknown kind counts as its text.

    While texts are joined, a NUL and a letter stand for each placeholder, and a NUL and a t for a NUL of a text."""
    codes = {kind: f"\0{kind[0]}" for kind in PLACEHOLDERS}
    code = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    text = lambda p: F.replace(F.coalesce(p["text"], F.lit("")), F.lit("\0"), F.lit("\0t"))
    joined = escape(F.array_join(F.transform(parts, lambda p: F.coalesce(code[p["kind"]], text(p))), ""))
    for kind, own in codes.items():
        joined = F.replace(joined, F.lit(own), F.lit(PLACEHOLDERS[kind]))
    return F.replace(joined, F.lit("\0t"), F.lit("\0"))


def _pieces(content: Column) -> Column:
    """The content's texts, as they are escaped, and placeholders, in order; none of them empty."""
    return F.filter(F.split(content, _JOINTS), lambda x: x != "")


def _is_placeholder(piece: Column) -> Column:
    return piece.isin(*PLACEHOLDERS.values())


def _text_spans(content: Column, start: Column) -> Column:
    """array<struct<first_byte, bytes>> of the content's texts, where the content begins at byte `start`; without
    placeholders one span, even of an empty content."""
    none = F.array().cast("array<struct<first_byte:bigint,bytes:bigint>>")
    span = lambda at, size: F.struct(at.cast("long").alias("first_byte"), size.cast("long").alias("bytes"))

    def step(state: Column, piece: Column) -> Column:
        size = F.octet_length(piece)
        more = F.when(_is_placeholder(piece), state["spans"]).otherwise(F.concat(state["spans"], F.array(span(state["at"], size))))
        return F.struct((state["at"] + size).cast("long").alias("at"), more.alias("spans"))

    walked = F.aggregate(_pieces(content), F.struct(start.cast("long").alias("at"), none.alias("spans")), step)
    return F.when(content.rlike("<(?:image|audio|document)>"), walked["spans"]).otherwise(F.array(span(start, F.octet_length(content))))


def _attachments(turn: Column, parts: Column) -> Column:
    tokens = F.create_map(*(F.lit(x) for pair in UNIT_TOKENS.items() for x in pair))
    kept = F.filter(F.transform(parts, lambda p, i: F.struct(turn.alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), (F.coalesce(p["units"], F.lit(1)) * tokens[p["kind"]]).alias("tokens"))), lambda a: a["tokens"].isNotNull())
    return kept.cast(_NO_ATTACHMENTS)


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, expanded_tokens) for each conversation.

    turns has conv_id, turn, role and parts (see PARTS); other columns are ignored.  Turns are ordered
    by turn, then role and content, null first; a null role is an empty one and a null content empty, as is a null
    text.  Equal turns each count.  Turns of a null conv_id are one conversation.  An empty table gives no rows.
    loss_spans are (first_byte, bytes) of the UTF-8 output.
    A running sum over a conversation's turns places the spans, so long conversations are sorted and
    spilled by Spark, not folded in memory.
    """
    parts = F.coalesce("parts", F.array().cast(PARTS))
    head = F.concat(F.lit("<s>"), escape(F.coalesce("role", F.lit(""))), F.lit("[INST]"))
    made = turns.select("conv_id", "turn", "role", head.alias("head"), _flatten(parts).alias("content"), _attachments(F.col("turn").cast("long"), parts).alias("attachments"))
    made = made.withColumn("said", F.concat("head", "content", F.lit("[/INST]</s>")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    placed = made.withColumns({
        "n": F.row_number().over(order),
        "end": F.sum(F.octet_length("said")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    start = F.col("end") - F.octet_length("said") + F.octet_length("head")
    spans = F.when(F.col("role") == trained_role, _text_spans(F.col("content"), start))
    ordered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "said", spans.alias("spans"), "attachments"))).alias("all"))
    attached = F.flatten(F.col("all.attachments"))
    return ordered.select(
        "conv_id",
        F.array_join(F.col("all.said"), "").alias("formatted"),
        F.flatten(F.filter(F.col("all.spans"), lambda s: s.isNotNull())).alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The output's turns, parsed back: array<struct<role, text, parts>>.

    parts are array<struct<kind, text>>: joined texts, and placeholders with a null text, whose references the
    attachments hold in the same order.  text is all texts of the turn, placeholders left out."""
    kinds = F.create_map(*(F.lit(x) for kind, mark in PLACEHOLDERS.items() for x in (mark, kind)))
    part = lambda x: F.struct(F.coalesce(kinds[x], F.lit("text")).alias("kind"), F.when(~_is_placeholder(x), unescape(x)).alias("text"))
    content = lambda x: F.substring_index(F.substring_index(x, "[INST]", -1), "[/INST]", 1)

    def turn(x: Column) -> Column:
        parts = F.transform(_pieces(content(x)), part)
        role = unescape(F.substring_index(F.substr(x, F.lit(4)), "[INST]", 1))
        return let(F.struct(role.alias("role"), parts.alias("parts")), lambda t: F.struct(t["role"].alias("role"), F.array_join(t["parts"]["text"], "").alias("text"), t["parts"].alias("parts")))

    return F.transform(F.filter(F.split(formatted, "</s>"), lambda x: x != ""), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, read by the mask's byte ranges."""
    cut = lambda raw: F.transform(spans, lambda s: unescape(F.substr(raw, (s["first_byte"] + 1).cast("int"), s["bytes"].cast("int")).cast("string")))
    return F.array_join(let(formatted.cast("binary"), cut), "")


def digest(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
