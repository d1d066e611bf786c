"""Scalar text functions as column expressions."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that ranking ignores.
RANK_STOPWORDS = ("a", "an", "the", "of", "in", "on", "for", "and", "or", "to", "is", "are", "with", "by", "at", "from", "as", "this", "that", "using")
#: Words that passage retrieval ignores.
RETRIEVAL_STOPWORDS = ("the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "it", "this", "that", "as", "by", "at", "from", "what", "how", "why", "does", "do", "did", "which", "who")


def trim(text: Column) -> Column:
    """Strips all Unicode white space from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_doi(doi: Column) -> Column:
    """Trimmed, lower-cased, without a resolver or doi: prefix; empty is null."""
    plain = F.regexp_replace(F.lower(trim(doi)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.nullif(plain, F.lit(""))


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Of all code points, those whose compatibility decomposition, without combining marks, holds an ASCII letter or digit:
    characters that become one each, with what they become, and characters that become several (others in it a blank; texts
    are lower-cased before, so several capitals alone count for nothing)."""
    one, to, several = [], [], {}
    for code in range(0x80, 0x110000):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char)
        if plain == char:
            continue
        plain = "".join(c if c.isascii() else " " for c in plain if not 0x300 <= ord(c) <= 0x36F)
        if len(plain) == 1 and plain.isalnum():
            one.append(char)
            to.append(plain)
        elif any(c.isdigit() or c.islower() for c in plain):
            several[char] = plain
    return "".join(one), "".join(to), several


def _any_of(chars) -> str:
    """A pattern of one of the characters, neighbours as ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def fold_accents(text: Column, ligatures: bool = True) -> Column:
    """Compatibility decomposition without combining marks, for characters that hold an ASCII letter or digit.

    Characters that become several are looked up one by one, only in texts that have any; ASCII texts are left as they are."""
    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), _folded(t, ligatures)).otherwise(t))


def _folded(text: Column, ligatures: bool) -> Column:
    one, to, several = _folding()
    text = F.translate(text, one, to)
    if ligatures:
        wide = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # folded to one literal
        each = lambda t: F.transform(F.regexp_extract_all(t, F.lit("(?s)."), 0), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(wide[c], c)))
        text = let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]") & t.rlike(_any_of(several)), F.array_join(each(t), "")).otherwise(t))
    return F.regexp_replace(text, "[̀-ͯ]", "")


def normalize_title(title: Column) -> Column:
    """Lower case, accents folded, runs of anything but a-z and 0-9 to a space, trimmed."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(title)), "[^a-z0-9]+", " "))


def surname(authors: Column) -> Column:
    """Last word of the first author's name, normalised; null without authors."""
    return F.nullif(normalize_title(F.element_at(F.split(trim(F.get(authors, 0)["name"]), r"\s+"), -1)), F.lit(""))


def rank_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_title(F.coalesce(text, F.lit(""))), " "), lambda t: (F.length(t) > 1) & ~t.isin(*RANK_STOPWORDS))


def retrieval_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(*RETRIEVAL_STOPWORDS))


def work_key(doi: Column, title: Column, year: Column, author: Column, venue: Column) -> Column:
    """doi:<sha256> for a work with a DOI, else hash:<sha256> of its normalised parts."""
    parts = F.concat_ws("|", F.coalesce(normalize_title(title), F.lit("")), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(author, F.lit("")), F.coalesce(normalize_title(venue), F.lit("")))
    plain = normalize_doi(doi)
    return F.when(plain.isNotNull(), F.concat(F.lit("doi:"), F.sha2(F.concat(F.lit("doi:"), plain), 256))).otherwise(F.concat(F.lit("hash:"), F.sha2(F.concat(F.lit("hash:"), parts), 256)))


def search_key(query: Column, filters: Column) -> Column:
    return F.sha2(F.to_json(F.struct(F.lower(trim(query)).alias("query"), filters.alias("filters"))), 256)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; zero if either norm is zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norms > 0) & (F.size(a) == F.size(b)), dot(a, b) / norms).otherwise(0.0)


def extract_json(text: Column) -> Column:
    """The text from the first { to the last }, out of a code fence if there is one, as a variant; null if it doesn't parse."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    return F.try_parse_json(F.nullif(F.regexp_extract(F.coalesce(fenced, text), r"(?s)\{.*\}", 0), F.lit("")))


def normalize_page(text: Column) -> Column:
    """Line ends unified, hyphenation undone, hard wraps joined, blanks collapsed; the order of steps matters."""
    for pattern, to in ((r"\r\n?", "\n"), (r"(\w)-\n(\w)", "$1$2"), (r"([^\n])\n(?!\n)", "$1 "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return trim(text)


def count_words(text: Column) -> Column:
    plain = trim(F.coalesce(text, F.lit("")))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, r"\s+")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: trim(s)), lambda s: s != "")


def citation_markers(text: Column) -> Column:
    """Keys of the [[key]] markers, in order, trimmed."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda k: trim(k))


#: A citation marker, [[key]]; brackets that make none are text.
MARKER = r"\[\[([^\]]+)\]\]"


def marker_runs(text: Column) -> Column:
    """The text cut at its markers: array<struct<text, mark, key>>, what stands before each marker, the marker as it is written and
    its trimmed key; the last has the rest and nulls.  Both parts come from the same matches, so the runs joined are the text."""
    marks = lambda t, group: F.regexp_extract_all(t, F.lit(MARKER), group)
    run = lambda t: F.transform(F.split(t, MARKER), lambda piece, i: F.struct(piece.alias("text"), F.get(marks(t, 0), i).alias("mark"), trim(F.get(marks(t, 1), i)).alias("key")))
    return let(text, run)


def marker_segments(text: Column) -> Column:
    """The text cut at its [[key]] markers, in order: array<struct<kind, value>>, a citation's value its trimmed key; no text is empty.
    A null text has null segments, an empty one none."""
    said = lambda r: F.struct(F.lit("text").alias("kind"), r["text"].alias("value"))
    cited = lambda r: F.struct(F.lit("citation").alias("kind"), r["key"].alias("value"))
    both = F.flatten(F.transform(marker_runs(text), lambda r: F.array(said(r), cited(r))))
    return F.filter(both, lambda s: s["value"].isNotNull() & ((s["kind"] == "citation") | (s["value"] != "")))


def keep_markers(text: Column, permitted: Column) -> Column:
    """The text without the markers whose key is not in the array `permitted`."""
    known = lambda r: F.when(F.array_contains(permitted, r["key"]), r["mark"]).otherwise("")
    return F.array_join(F.transform(marker_runs(text), lambda r: F.concat(r["text"], F.coalesce(known(r), F.lit("")))), "")


def remap_markers(text: Column, tags: Column) -> Column:
    """The text with the key of each [[tag]] marker that the map `tags` knows in place of the tag; others stay."""
    known = lambda p: tags[p["value"]]
    piece = lambda p: F.when(p["kind"] == "text", p["value"]).otherwise(F.concat(F.lit("[["), F.coalesce(F.nullif(known(p), F.lit("")), p["value"]), F.lit("]]")))
    return F.array_join(F.transform(marker_segments(text), piece), "")


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.format_string("page %d", first)).otherwise(F.format_string("pages %d-%d", first, last))


def page_citations(text: Column) -> Column:
    """First pages of the [p. N] and [pp. N-M] citations, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[pp?\.\s*(\d{1,4})(?:\s*[-–]\s*\d{1,4})?\]"), 1), lambda p: p.cast("int"))


def first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\d{4}", 0), F.lit("")).cast("int")


def page_range(pages: Column) -> Column:
    """(first, last) of a range written with a hyphen or en dash."""
    parts = F.split(pages, "[-–]")
    return F.struct(F.nullif(trim(F.get(parts, 0)), F.lit("")).alias("first"), F.nullif(trim(F.get(parts, 1)), F.lit("")).alias("last"))


def credits_for_usage(tier: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Whole credits, at least one for any use; fixed values: rates of a thousand tokens by tier."""
    used_in, used_out = F.greatest(F.lit(0), tokens_in), F.greatest(F.lit(0), tokens_out)
    rate_in, rate_out = F.when(tier == "quality", 2.0).otherwise(0.5), F.when(tier == "quality", 6.0).otherwise(1.5)
    return F.when(used_in + used_out == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((used_in * rate_in + used_out * rate_out) / 1000))).cast("long")


def publication_credit(index: Column, base: int) -> Column:
    """Halves with each further publication, six times at most, never below one."""
    return F.when(index <= 0, base).otherwise(F.greatest(F.lit(1), F.floor(base / F.pow(F.lit(2.0), F.least(index, F.lit(6))) + 0.5))).cast("long")


def csv_field(value: Column) -> Column:
    """RFC 4180 quoting; a leading = + - @ tab or return gets a tab, so that no spreadsheet runs it."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("\t"), value)).otherwise(F.coalesce(value, F.lit("")))
    return F.when(safe.rlike('[",\r\n\t]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def safe_stem(title: Column, default: str = "untitled") -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^A-Za-z0-9 _-]", ""), r"\s+", " "))
    return F.coalesce(F.nullif(F.substring(plain, 1, 60), F.lit("")), F.lit(default))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once a row, even where `use` needs it for every element."""
    return F.transform(F.array(value), use)[0]
