"""Fill-in-the-middle transformation by escaped marker injection, in DataFrame functions only.

A text's units are what UNITS matches from left to right: a run of ASCII letters, or any other code point.
To cut between units without a list of them, a delimiter is injected into the text itself:

1. escape: the delimiter and the escape character, where the text has them, become pairs of the escape
   character and a code, each pair one unit still;
2. mark: regexp_replace puts the delimiter behind every unit; now delimiters stand nowhere else;
3. count: the number of units is what the text loses in length without its delimiters;
4. extract: substring_index takes all before the a-th or behind the b-th delimiter, whatever the text's length;
5. unescape, and assemble with the markers in the order of the form.

No array of units is ever built, and rows never leave their partition: one scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.functions.text import let

UNITS = "[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Delimiter and escape character, and the codes behind the latter; any text may hold all four.
CUT, ESCAPE, ESCAPE_CODE, CUT_CODE = "\x01", "\x02", "\x03", "\x04"


def escape(text: Column) -> Column:
    """The text without any delimiter; every escape character in it has a code behind it."""
    safe = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE_CODE))
    return F.replace(safe, F.lit(CUT), F.lit(ESCAPE + CUT_CODE))


def unescape(text: Column) -> Column:
    """The text of an escaped one; injected delimiters go."""
    plain = F.replace(text, F.lit(CUT), F.lit(""))
    plain = F.replace(plain, F.lit(ESCAPE + CUT_CODE), F.lit(CUT))
    return F.replace(plain, F.lit(ESCAPE + ESCAPE_CODE), F.lit(ESCAPE))


def mark(text: Column) -> Column:
    """The escaped text with a delimiter behind each unit."""
    return F.regexp_replace(escape(text), f"{ESCAPE}[{ESCAPE_CODE}{CUT_CODE}]|{UNITS}", f"$0{CUT}")


def count_units(marked: Column) -> Column:
    return (F.char_length(marked) - F.char_length(F.replace(marked, F.lit(CUT), F.lit("")))).cast("long")


def _index(text: Column, count: Column) -> Column:
    """What stands before the count-th delimiter; with a negative count, behind it from the end."""
    return F.call_function("substring_index", text, F.lit(CUT), count.cast("int"))


def cut(marked: Column, n: Column, a: Column, b: Column) -> Column:
    """struct<prefix, middle, suffix> of a marked text of n units: the first a, those up to b, and the rest."""
    head = _index(marked, b)  # b units, b - 1 delimiters
    return F.struct(
        unescape(_index(marked, a)).alias("prefix"),
        unescape(_index(head, a - b)).alias("middle"),
        unescape(_index(marked, b - n - 1)).alias("suffix"),
    )


def draws(key: Column) -> Column:
    """Four unsigned 32-bit numbers of a document, from the digest of its key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return let(digest, lambda d: F.array(*(F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))))


def assemble(form: Column, text: Column, parts: Column) -> Column:
    """The output of a form: psm and spm name the order of prefix, suffix and middle; plain is the text itself."""
    psm = F.concat(F.lit(PREFIX), parts["prefix"], F.lit(SUFFIX), parts["suffix"], F.lit(MIDDLE), parts["middle"])
    spm = F.concat(F.lit(SUFFIX), parts["suffix"], F.lit(PREFIX), parts["prefix"], F.lit(MIDDLE), parts["middle"])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restore(formatted: DataFrame) -> DataFrame:
    """The formatted rows with the column restored: the text, from output and form alone.

    No part holds a marker, so the first of each kind is the one put there.  Step by step, so that each is computed once."""
    psm = F.col("form") == "psm"
    rest = F.when(F.col("form") != "plain", F.substr("output", F.lit(len(PREFIX) + 1)))
    first = F.when(psm, F.substring_index("_rest", SUFFIX, 1)).otherwise(F.substring_index("_rest", PREFIX, 1))
    tail = F.substr("_rest", F.char_length("_first") + F.lit(len(SUFFIX) + 1))
    middle = F.substr("_tail", F.char_length("_behind") + F.lit(len(MIDDLE) + 1))
    split = formatted.withColumn("_rest", rest).withColumn("_first", first).withColumn("_tail", tail)
    split = split.withColumn("_behind", F.substring_index("_tail", MIDDLE, 1)).withColumn("_middle", middle)
    whole = F.when(psm, F.concat("_first", "_middle", "_behind")).otherwise(F.concat("_behind", "_middle", "_first"))
    return split.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(whole)).drop("_rest", "_first", "_tail", "_behind", "_middle")


def fill_middle(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of docs (doc_id, text).

    The cuts and the form follow from doc_id alone.  A text that is empty, or that holds a marker already, stays plain,
    as do plain_percent of the others; of the rest spm_percent are spm.  A null text is an empty one; a null doc_id draws as an empty
    key.  Rows that repeat a doc_id are formatted each; an empty table gives no rows; other columns are ignored.  A long text
    costs its own length, in one row.
    """
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", text.alias("text"), mark(text).alias("marked"), draws(F.col("doc_id")).alias("h"))
    counted = marked.withColumn("n", count_units(F.col("marked")))
    ends = [F.pmod(F.col("h")[k], F.col("n") + 1) for k in (0, 1)]
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("n") == 0) | held | (F.col("h")[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    placed = counted.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    parts = F.when(F.col("form") != "plain", cut(F.col("marked"), F.col("n"), F.col("a"), F.col("b")))
    done = placed.select("doc_id", "text", "n", "form", parts.alias("parts"))
    chars = lambda part: F.char_length(F.col("parts")[part]).cast("long").alias(f"{part}_chars")
    return done.select("doc_id", "n", "form", chars("prefix"), chars("middle"), assemble(F.col("form"), F.col("text"), F.col("parts")).alias("output"))


def digests(formatted: DataFrame) -> DataFrame:
    """The formatted rows with the hex digests of the output and of the text rebuilt from it, instead of the output."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore(formatted).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
