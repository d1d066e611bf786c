"""Citations: names, five styles, missing fields, document trees and decks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.text import citation_markers, fold_accents, safe_stem, trim
from scholarframe.operators import trees

#: Words that mark an organisation's name.
CORPORATE = "university|institute|organization|organisation|association|society|department|ministry|centre|center|consortium|group|committee|agency"
#: Record types in citation items, BibTeX and RIS.
CSL_TYPES = {"journal-article": "article-journal", "proceedings-article": "paper-conference", "book-chapter": "chapter", "posted-content": "article", "preprint": "article", "article": "article-journal", "book": "book", "dataset": "dataset", "dissertation": "thesis", "report": "report", "Journal Article": "article-journal", "Review": "article-journal"}
BIBTEX_TYPES = {"article-journal": "article", "paper-conference": "inproceedings", "chapter": "incollection", "book": "book", "thesis": "phdthesis", "report": "techreport", "dataset": "misc", "article": "article", "document": "misc"}
RIS_TYPES = {"article-journal": "JOUR", "paper-conference": "CPAPER", "chapter": "CHAP", "book": "BOOK", "thesis": "THES", "report": "RPRT", "dataset": "DATA", "article": "JOUR", "document": "GEN"}


def deck_references(bullets: DataFrame, works: DataFrame) -> DataFrame:
    """(deck, number, work_key, title): the works that a deck's bullets cite, numbered by where each is cited first, ties by key.

    bullets has deck, slide, bullet and text with [[key]] markers, works work_key and title; keys of no work count for nothing."""
    said = bullets.select("deck", "slide", "bullet", F.posexplode(citation_markers(F.col("text"))).alias("i", "work_key"))
    first = said.groupBy("deck", "work_key").agg(F.min(F.struct("slide", "bullet", "i")).alias("at"))
    known = first.join(works.select("work_key", "title"), "work_key")
    return known.withColumn("number", F.row_number().over(Window.partitionBy("deck").orderBy("at", "work_key"))).select("deck", "number", "work_key", "title")


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key], F.lit(default))


def csl_name(name: Column) -> Column:
    """struct(family, given, literal): 'Family, Given' is plain; one word or an organisation is taken literally."""
    name = trim(name)
    words = F.split(name, r"\s+")
    none = F.lit(None).cast("string")
    literal = F.when(name == "", "Unknown").when((F.size(words) == 1) | name.rlike(rf"(?i)\b({CORPORATE})\b"), name)
    with_comma = F.locate(",", name) > 1
    parts = lambda f, g, l: F.struct(f.alias("family"), g.alias("given"), l.alias("literal"))
    return (
        F.when(with_comma, parts(trim(F.substring_index(name, ",", 1)), trim(F.regexp_replace(name, "^[^,]*,", "")), none))
        .when(literal.isNotNull(), parts(literal, none, literal))
        .otherwise(parts(F.element_at(words, -1), F.array_join(F.slice(words, 1, F.size(words) - 1), " "), none))
    )


def _initials(given: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(given, r"[\s.]+"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), " ")


def inverted_initials(n: Column) -> Column:
    given = F.nullif(_initials(F.coalesce(n["given"], F.lit(""))), F.lit(""))
    return F.coalesce(n["literal"], F.concat(n["family"], F.lit(", "), given), n["family"])


def inverted(n: Column) -> Column:
    return F.coalesce(n["literal"], F.concat(n["family"], F.lit(", "), F.nullif(n["given"], F.lit(""))), n["family"])


def natural(n: Column) -> Column:
    return F.coalesce(n["literal"], F.concat(F.nullif(n["given"], F.lit("")), F.lit(" "), n["family"]), n["family"])


def _end(text: Column) -> Column:
    return F.when(text.rlike("[.?!]$"), text).otherwise(F.concat(text, F.lit(".")))


def _said(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def _link(tail: str) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("https://doi.org/"), _said("doi")), _said("url")), F.lit(tail))


def _but_last(names: Column) -> Column:
    return F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), ", ")


def to_csl(works: DataFrame) -> DataFrame:
    """works with names, csl_type and page; expects authors(array<string>), type, first_page, last_page."""
    page = F.when(_said("first_page").isNotNull(), F.concat_ws("-", "first_page", _said("last_page")))
    kind = F.when(F.col("type").isNull(), F.lit("article-journal")).otherwise(_lookup(CSL_TYPES, F.col("type"), "document"))
    return works.withColumns({"names": F.transform("authors", csl_name), "csl_type": kind, "page": page})


def apa(csl: DataFrame) -> Column:
    names = F.transform("names", inverted_initials)
    many = F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", . . . "), F.element_at(names, -1))
    who = F.when(F.size(names) == 1, names[0]).when(F.size(names) > 20, many).when(F.size(names) > 1, F.concat(_but_last(names), F.lit(", & "), F.element_at(names, -1)))
    volume = F.concat(F.lit(", "), _said("volume"), F.coalesce(F.concat(F.lit("("), _said("issue"), F.lit(")")), F.lit("")))
    source = F.concat(_said("container"), F.coalesce(volume, F.lit("")), F.coalesce(F.concat(F.lit(", "), _said("page")), F.lit("")))
    return F.concat_ws(" ", _end(who), F.concat(F.lit("("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit(").")), _end(F.col("title")), _end(F.coalesce(source, _said("publisher"))), _link(""))


def mla(csl: DataFrame) -> Column:
    n = F.col("names")
    who = F.when(F.size(n) == 1, F.concat(inverted(n[0]), F.lit("."))).when(F.size(n) == 2, F.concat(inverted(n[0]), F.lit(", and "), natural(n[1]), F.lit("."))).when(F.size(n) > 2, F.concat(inverted(n[0]), F.lit(", et al.")))
    year = F.col("year").cast("string")
    details = F.concat_ws(", ", F.concat(F.lit("*"), _said("container"), F.lit("*")), F.concat(F.lit("vol. "), _said("volume")), F.concat(F.lit("no. "), _said("issue")), year, F.concat(F.lit("pp. "), _said("page")))
    bare = F.concat_ws(" ", F.concat(_said("publisher"), F.lit(",")), F.coalesce(F.concat(year, F.lit(".")), F.lit("n.d.")))
    return F.concat_ws(" ", who, F.concat(F.lit('"'), F.regexp_replace("title", r"\.$", ""), F.lit('."')), F.when(_said("container").isNotNull(), F.concat(details, F.lit("."))).otherwise(bare), _link("."))


def chicago(csl: DataFrame) -> Column:
    n = F.col("names")
    rest = F.transform(F.slice(n, 2, F.greatest(F.size(n) - 1, F.lit(0))), natural)
    listed = F.when(F.size(n) == 2, F.concat(inverted(n[0]), F.lit(", and "), F.element_at(rest, 1))).otherwise(F.concat(F.concat_ws(", ", inverted(n[0]), F.nullif(_but_last(rest), F.lit(""))), F.lit(", and "), F.try_element_at(rest, F.lit(-1))))
    who = F.when(F.size(n) == 1, F.concat(inverted(n[0]), F.lit("."))).when(F.size(n) > 10, F.concat(inverted(n[0]), F.lit(", et al."))).when(F.size(n) > 1, F.concat(listed, F.lit(".")))
    source = F.concat(_said("container"), F.coalesce(F.concat(F.lit(" "), _said("volume")), F.lit("")), F.coalesce(F.concat(F.lit(", no. "), _said("issue")), F.lit("")), F.coalesce(F.concat(F.lit(": "), _said("page")), F.lit("")), F.lit("."))
    return F.concat_ws(" ", who, F.concat(F.coalesce(F.col("year").cast("string"), F.lit("n.d")), F.lit(".")), F.concat(F.lit('"'), F.regexp_replace("title", r"\.$", ""), F.lit('."')), F.coalesce(source, F.concat(_said("publisher"), F.lit("."))), _link("."))


def bibtex_escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([&%$#_])", r"\\$1")


def bibtex_key() -> Column:
    word = F.coalesce(F.get(F.filter(F.split("title", r"\s+"), lambda w: F.length(w) > 3), 0), F.lit("untitled"))
    raw = F.concat(F.coalesce(F.get("names", 0)["family"], F.lit("anon")), F.coalesce(F.col("year").cast("string"), F.lit("nd")), word)
    return F.lower(F.regexp_replace(fold_accents(raw, ligatures=False), "[^A-Za-z0-9]", ""))


def bibtex(csl: DataFrame) -> Column:
    entry = _lookup(BIBTEX_TYPES, F.col("csl_type"), "misc")
    who = F.array_join(F.transform("names", lambda n: F.coalesce(F.concat(F.lit("{"), n["literal"], F.lit("}")), inverted(n))), " and ")
    title = F.regexp_replace(bibtex_escape(F.col("title")), r"\b([A-Z][A-Za-z]*[A-Z][A-Za-z0-9]*)\b", "{$1}")
    field = lambda key, value: F.concat(F.lit("  "), key if isinstance(key, Column) else F.lit(key), F.lit(" = {"), value, F.lit("}"))
    journal = F.when(entry == "inproceedings", "booktitle").otherwise("journal")
    fields = [field("author", F.nullif(who, F.lit(""))), field("title", title), field(journal, bibtex_escape(_said("container"))), field("year", F.col("year").cast("string")), field("volume", _said("volume")), field("number", _said("issue")), field("pages", F.regexp_replace(_said("page"), "[-–]", "--")), field("publisher", bibtex_escape(_said("publisher"))), field("doi", _said("doi")), field("url", _said("url"))]
    return F.concat(F.lit("@"), entry, F.lit("{"), bibtex_key(), F.lit(",\n"), F.concat_ws(",\n", *fields), F.lit("\n}"))


def ris(csl: DataFrame) -> Column:
    line = lambda tag, value: F.concat(F.lit(f"{tag}  - "), F.regexp_replace(value, r"\s*\n\s*", " "))
    authors = F.nullif(F.array_join(F.transform("names", lambda n: F.concat(F.lit("AU  - "), inverted(n))), "\n"), F.lit(""))
    year = F.col("year").cast("string")
    pages = F.split("page", "[-–]")
    lines = [line("TY", _lookup(RIS_TYPES, F.col("csl_type"), "GEN")), authors, line("TI", F.col("title")), line("PY", year), line("DA", F.concat(year, F.lit("///"))), line("JO", _said("container")), line("VL", _said("volume")), line("IS", _said("issue")), line("SP", F.get(pages, 0)), line("EP", F.get(pages, 1)), line("PB", _said("publisher")), line("DO", _said("doi")), line("UR", _said("url")), F.lit("ER  - ")]
    return F.concat_ws("\n", *lines)


STYLES = {"apa": apa, "mla": mla, "chicago": chicago, "bibtex": bibtex, "ris": ris}
#: Fields that a style needs, and their names in the note.
REQUIRED = {"apa": ("author", "issued", "container", "volume", "page"), "mla": ("author", "issued", "container", "page"), "chicago": ("author", "issued", "container", "volume", "page")}
FIELD_NAMES = {"author": "author list", "issued": "publication year", "container": "journal or book title", "volume": "volume", "page": "page range"}


def missing_fields(style: str) -> Column:
    """Names of the style's fields that the work lacks; a preprint needs no volume or page."""
    preprint = (F.col("csl_type") == "article") | F.col("container").isNull()
    lacks = {"author": F.size("names") == 0, "issued": F.col("year").isNull(), **{c: _said(c).isNull() for c in ("container", "volume", "page")}}
    tests = [F.when(lacks[f] & ~(preprint if f in ("volume", "page") else F.lit(False)), FIELD_NAMES[f]) for f in REQUIRED.get(style, ())]
    return F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")


def missing_note(missing: Column) -> Column:
    names = F.when(F.size(missing) == 1, missing[0]).otherwise(F.concat(_but_last(missing), F.lit(" and "), F.try_element_at(missing, F.lit(-1))))
    return F.when(F.size(missing) > 0, F.concat(F.lit("Incomplete: no "), names, F.lit(" found for this record. Check the source before submitting.")))


def bibliography(docs: DataFrame, works: DataFrame, key: str, tree: str, text: str) -> DataFrame:
    """(key, position, work_key, text): each document's works in order of citation, each once; an unknown one is marked.

    tree is JSON text of any depth; a null or malformed one cites nothing."""
    cited = trees.cited(trees.nodes(docs, key, tree)).withColumnRenamed("key", key)
    return cited.join(works.select("work_key", F.col(text).alias("text")), "work_key", "left").select(key, "position", "work_key", F.coalesce("text", F.concat(F.lit("[missing: "), F.col("work_key"), F.lit("]"))).alias("text"))


def inline_label(style: str) -> Column:
    """(Surname, year), (Surname & Surname, year) or (Surname et al., year); MLA has no year."""
    n = F.size("names")
    family = lambda k: F.get("names", k)["family"]
    joint = " & " if style == "apa" else " and "
    who = F.when(n == 0, F.lit("Anonymous")).when(n == 1, family(0)).when(n == 2, F.concat(family(0), F.lit(joint), family(1))).otherwise(F.concat(family(0), F.lit(" et al.")))
    year = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    return F.concat(F.lit("("), who, F.lit(")")) if style == "mla" else F.concat(F.lit("("), who, F.lit(", "), year, F.lit(")"))


def deck(slides: DataFrame, key: str) -> DataFrame:
    """(key, filename, markdown): slides(key, title, position, heading, bullets) as a Markdown deck."""
    body = F.concat(F.lit("# "), F.col("heading"), F.lit("\n\n"), F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("- "), b)), "\n"))
    ordered = slides.groupBy(key).agg(F.first("title").alias("title"), F.sort_array(F.collect_list(F.struct("position", body.alias("body")))).alias("all"))
    return ordered.select(key, F.concat(safe_stem(F.col("title"), "deck"), F.lit(".md")).alias("filename"), F.concat(F.lit("---\nmarp: true\n---\n\n# "), F.col("title"), F.lit("\n\n---\n\n"), F.array_join(F.col("all.body"), "\n\n---\n\n")).alias("markdown"))
