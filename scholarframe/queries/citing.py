"""Queries on citations, bibliographies and decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.operators import cite
from scholarframe.plans.tables import table

NAMES = ("Ana Maria Diaz", "Smith, John", "World Health Organization", "Plato")


def csl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as citable works with none to three authors."""
    name = lambda k: F.element_at(F.array(*map(F.lit, NAMES)), ((F.col("doc_id") + k) % 4 + 1).cast("int"))
    works = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("w"), F.col("doc_id")).alias("work_key"),
        F.get(F.split("text", "\n"), 0).alias("title"),
        F.slice(F.array(name(0), name(1), name(2)), 1, (F.col("doc_id") / 4 % 4).cast("int")).alias("authors"),
        F.when(F.col("doc_id") % 13 != 0, (F.col("n_chars") % 36 + 1990).cast("int")).alias("year"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Venue "), F.col("n_chars") % 7)).alias("container"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("n_chars") % 40).cast("string")).alias("volume"),
        F.when(F.col("doc_id") % 2 != 0, (F.col("n_chars") % 9).cast("string")).alias("issue"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("string")).alias("first_page"),
        F.when(F.col("doc_id") % 11 != 0, (F.col("n_chars") + 9).cast("string")).alias("last_page"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("Press & Co")).alias("publisher"),
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("10.5555/"), F.col("doc_id"))).alias("doi"),
        F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("https://w.example/"), F.col("doc_id"))).alias("url"),
        F.when(F.col("doc_id") % 6 == 0, F.lit("preprint")).when(F.col("doc_id") % 6 == 1, F.lit("proceedings-article")).alias("type"),
    )
    return cite.to_csl(works)


def _style(style):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        works = csl(spark, sf_dir)
        return works.select("doc_id", cite.STYLES[style](works).alias("text"))

    query.__name__ = f"cite_{style}"
    return query


def cite_missing(spark, sf_dir):
    works = csl(spark, sf_dir)
    return works.select("doc_id", cite.missing_note(cite.missing_fields("apa")).alias("apa"), cite.missing_note(cite.missing_fields("mla")).alias("mla"))


def cite_all_styles(spark, sf_dir):
    works = csl(spark, sf_dir)
    return works.select("doc_id", *(F.md5(f(works).cast("binary")).alias(s) for s, f in cite.STYLES.items()))


def inline_labels(spark, sf_dir):
    return csl(spark, sf_dir).select("doc_id", cite.inline_label("apa").alias("apa"), cite.inline_label("mla").alias("mla"))


def bibliography(spark, sf_dir):
    """Conversations as documents that cite three works each, one of them twice and one unknown; ids beyond the works are unknown too."""
    leaf = lambda k: F.concat(F.lit('{"type":"citation","attrs":{"workKey":"w'), k, F.lit('"}}'))
    tree = F.concat(F.lit('{"type":"doc","content":[{"type":"p","content":['), leaf(F.col("conv_id") * 3), F.lit(","), leaf(F.lit("none")), F.lit(']},{"type":"p","content":['), leaf(F.col("conv_id")), F.lit(","), leaf(F.col("conv_id") * 3), F.lit("]}]}"))
    docs = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("tree", tree)
    works = csl(spark, sf_dir).select("work_key", cite.inline_label("apa").alias("label"))
    return cite.bibliography(docs, works, "conv_id", "tree", "label")


def deck_export(spark, sf_dir):
    slides = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("deck"), F.lit("Nations: a tour?").alias("title"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("heading"), F.array(F.lit("first"), F.col("n_name")).alias("bullets"))
    return cite.deck(slides, "deck")


QUERIES = {f"cite_{s}": _style(s) for s in cite.STYLES} | {f.__name__: f for f in (cite_missing, cite_all_styles, inline_labels, bibliography, deck_export)}

_CSL = """c AS (SELECT doc_id, 'w' || doc_id AS work_key, string_split(text, chr(10))[1] AS title, (doc_id // 4 % 4)::INT AS n, (doc_id % 4)::INT AS k,
  CASE WHEN doc_id % 13 <> 0 THEN (n_chars % 36 + 1990)::INT END AS year, CASE WHEN doc_id % 5 <> 0 THEN 'Venue ' || (n_chars % 7) END AS container,
  CASE WHEN doc_id % 3 <> 0 THEN (n_chars % 40)::VARCHAR END AS volume, CASE WHEN doc_id % 2 <> 0 THEN (n_chars % 9)::VARCHAR END AS issue,
  CASE WHEN doc_id % 7 <> 0 THEN n_chars::VARCHAR || CASE WHEN doc_id % 11 <> 0 THEN '-' || (n_chars + 9) ELSE '' END END AS page,
  CASE WHEN doc_id % 4 = 0 THEN 'Press & Co' END AS publisher, CASE doc_id % 3 WHEN 1 THEN 'https://doi.org/10.5555/' || doc_id WHEN 2 THEN 'https://w.example/' || doc_id END AS link,
  CASE doc_id % 6 WHEN 0 THEN 'article' WHEN 1 THEN 'paper-conference' ELSE 'article-journal' END AS kind FROM documents),
a AS (SELECT *, [['Diaz, A. M.','Smith, J.','World Health Organization','Plato'][(k + i) % 4 + 1] for i in range(n)] AS ini, [['Diaz, Ana Maria','Smith, John','World Health Organization','Plato'][(k + i) % 4 + 1] for i in range(n)] AS inv,
  [['Ana Maria Diaz','John Smith','World Health Organization','Plato'][(k + i) % 4 + 1] for i in range(n)] AS nat, [['Diaz','Smith','World Health Organization','Plato'][(k + i) % 4 + 1] for i in range(n)] AS fam FROM c)"""
_END = "({0} || CASE WHEN regexp_matches({0}, '[.?!]$') THEN '' ELSE '.' END)"
_Q = "'\"' || regexp_replace(title, '\\.$', '') || '.\"'"
_APA_WHO = "CASE n WHEN 1 THEN ini[1] WHEN 2 THEN ini[1] || ', & ' || ini[2] WHEN 3 THEN ini[1] || ', ' || ini[2] || ', & ' || ini[3] END"
_CHI_WHO = "CASE n WHEN 1 THEN inv[1] || '.' WHEN 2 THEN inv[1] || ', and ' || nat[2] || '.' WHEN 3 THEN inv[1] || ', ' || nat[2] || ', and ' || nat[3] || '.' END"
_MLA_WHO = "CASE n WHEN 1 THEN inv[1] || '.' WHEN 2 THEN inv[1] || ', and ' || nat[2] || '.' WHEN 3 THEN inv[1] || ', et al.' END"
_PRE = "(kind = 'article' OR container IS NULL)"


def _note(*tests: str) -> str:
    listed = f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"
    return f"(SELECT CASE WHEN len(m) = 0 THEN NULL ELSE 'Incomplete: no ' || CASE WHEN len(m) = 1 THEN m[1] ELSE array_to_string(m[1:len(m) - 1], ', ') || ' and ' || m[len(m)] END || ' found for this record. Check the source before submitting.' END FROM (SELECT {listed} AS m))"


_A, _Y, _C = "CASE WHEN n = 0 THEN 'author list' END", "CASE WHEN year IS NULL THEN 'publication year' END", "CASE WHEN container IS NULL THEN 'journal or book title' END"
_V, _P = (f"CASE WHEN {f} IS NULL AND NOT {_PRE} THEN '{name}' END" for f, name in (("volume", "volume"), ("page", "page range")))

ORACLE_SQL = {
    "cite_apa": f"WITH {_CSL} SELECT doc_id, concat_ws(' ', {_END.format(f'({_APA_WHO})')}, '(' || coalesce(year::VARCHAR, 'n.d.') || ').', {_END.format('title')}, {_END.format(chr(40) + 'coalesce(container || coalesce(' + chr(39) + ', ' + chr(39) + ' || volume || coalesce(' + chr(39) + '(' + chr(39) + ' || issue || ' + chr(39) + ')' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) * 2 + ') || coalesce(' + chr(39) + ', ' + chr(39) + ' || page, ' + chr(39) * 2 + '), publisher)' + chr(41))}, link) AS text FROM a",
    "cite_mla": f"WITH {_CSL} SELECT doc_id, concat_ws(' ', {_MLA_WHO}, {_Q}, CASE WHEN container IS NOT NULL THEN concat_ws(', ', '*' || container || '*', 'vol. ' || volume, 'no. ' || issue, year::VARCHAR, 'pp. ' || page) || '.' ELSE concat_ws(' ', publisher || ',', coalesce(year || '.', 'n.d.')) END, link || '.') AS text FROM a",
    "cite_chicago": f"WITH {_CSL} SELECT doc_id, concat_ws(' ', {_CHI_WHO}, coalesce(year::VARCHAR, 'n.d') || '.', {_Q}, coalesce(container || coalesce(' ' || volume, '') || coalesce(', no. ' || issue, '') || coalesce(': ' || page, '') || '.', publisher || '.'), link || '.') AS text FROM a",
    "cite_ris": f"WITH {_CSL} SELECT doc_id, concat_ws(chr(10), 'TY  - ' || CASE WHEN kind = 'paper-conference' THEN 'CPAPER' ELSE 'JOUR' END, CASE WHEN n > 0 THEN array_to_string(list_transform(inv, lambda x: 'AU  - ' || x), chr(10)) END, 'TI  - ' || title, 'PY  - ' || year, 'DA  - ' || year || '///', 'JO  - ' || container, 'VL  - ' || volume, 'IS  - ' || issue, 'SP  - ' || string_split(page, '-')[1], 'EP  - ' || string_split(page, '-')[2], 'PB  - ' || publisher, 'DO  - ' || CASE WHEN doc_id % 3 = 1 THEN '10.5555/' || doc_id END, 'UR  - ' || CASE WHEN doc_id % 3 = 2 THEN link END, 'ER  - ') AS text FROM a",
    "cite_missing": f"WITH {_CSL} SELECT doc_id, {_note(_A, _Y, _C, _V, _P)} AS apa, {_note(_A, _Y, _C, _P)} AS mla FROM a",
    "inline_labels": f"WITH {_CSL} SELECT doc_id, '(' || CASE n WHEN 0 THEN 'Anonymous' WHEN 1 THEN fam[1] WHEN 2 THEN fam[1] || ' & ' || fam[2] ELSE fam[1] || ' et al.' END || ', ' || coalesce(year::VARCHAR, 'n.d.') || ')' AS apa, '(' || CASE n WHEN 0 THEN 'Anonymous' WHEN 1 THEN fam[1] WHEN 2 THEN fam[1] || ' and ' || fam[2] ELSE fam[1] || ' et al.' END || ')' AS mla FROM a",
    "bibliography": f"""
WITH {_CSL}, l AS (SELECT work_key, '(' || CASE n WHEN 0 THEN 'Anonymous' WHEN 1 THEN fam[1] WHEN 2 THEN fam[1] || ' & ' || fam[2] ELSE fam[1] || ' et al.' END || ', ' || coalesce(year::VARCHAR, 'n.d.') || ')' AS label FROM a),
k AS (SELECT conv_id, work_key, min(p) AS p FROM (SELECT conv_id, unnest(['w' || 3 * conv_id, 'wnone', 'w' || conv_id]) AS work_key, unnest([0, 1, 2]) AS p FROM (SELECT DISTINCT conv_id FROM conversations)) GROUP BY ALL)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1)::INT AS position, work_key, coalesce(label, '[missing: ' || work_key || ']') AS text FROM k LEFT JOIN l USING (work_key)""",
    "deck_export": "SELECT n_regionkey AS deck, 'Nations a tour.md' AS filename, '---' || chr(10) || 'marp: true' || chr(10) || '---' || chr(10) || chr(10) || '# Nations: a tour?' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg('# ' || n_name || chr(10) || chr(10) || '- first' || chr(10) || '- ' || n_name, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1",
}
