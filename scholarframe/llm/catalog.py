"""Queries of the training-data operators, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.llm import chat, decontaminate, fill_middle, licenses, line_dedup, packing, periodic, quality, toxicity, urls, warc
from scholarframe.llm.ngram_join import jaccard_classes
from scholarframe.llm.simhash import simhash_classes
from scholarframe.plans.tables import shared_dir, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without repeated windows of three lines; null texts stay null."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of -1, read back from their formatted texts; a null text is an empty one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(probe))
    return chat.digest(chat.format_chats(turns.union(own).withColumn("parts", chat.text_part(F.col("text")))))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; a null text has no words and fails the base."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by what `labels` outside the held-out third say."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that windows of ten words of `benchmark` cover, and the items met; null has no words."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents linked by four-word shingles at 0.85; documents without words link with nothing."""
    return jaccard_classes(table(spark, sf_dir, "documents"), size=4, percent=85)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the license scan that SQL can express: words, and places and labels of the base phrases."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


#: Verdict, and host with path.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs: the longest rule's, else the trees'."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.labelled_by_rules(pages, URL_RULES), URL_RULES)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the URL filter that SQL can express: host, path and the longest rule with its verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    return pages.withColumn("fit", urls.longest_rule(F.col("host"), F.col("path"), URL_RULES)).select("page_id", "host", "path", "fit.rule", "fit.verdict")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens; a null text is the end id alone."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), limit=4096, end_id=1)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC records and read back; a null html is an empty payload."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder, revisit_bytes=1000)
    return warc.read_records(index, folder).drop("url")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut in three and reordered, as digests of the output and of the text rebuilt from it; a null text is an empty one."""
    return fill_middle.digests(fill_middle.fill_middle(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, a tenth of them with a planted loop; a null text has no words."""
    docs = table(spark, sf_dir, "documents")
    return periodic.digests(periodic.periodic_runs(docs.select("doc_id", periodic.looped(F.col("text"), F.col("doc_id")).alias("text"))))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents whose fingerprints of four-word shingles differ in four bits or fewer; texts without words have fingerprint 0."""
    return simhash_classes(table(spark, sf_dir, "documents"), size=4, most=4)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_license_scan": op7_license_scan,
    "op8_url_filter": op8_url_filter,
    "op9_pack": op9_pack,
    "op10_warc": op10_warc,
    "op11_fill_middle": op11_fill_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash": op13_simhash,
    "pipeline": pipeline,
    "license_base": license_base,
    "url_rules": url_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op6_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.r AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(r) AS r FROM reach GROUP BY id) m ON m.id = d.doc_id
""",
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, l.i - 1 AS i, l.line FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(s) + 1), lambda k: {'i': k, 'line': s[k]})) AS l
    FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
said AS (SELECT *, row_number() OVER w AS n FROM lines WHERE regexp_matches(line, '[^ \t-\r]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
wins AS (
  SELECT x.doc_id, x.i AS a, z.i AS b, x.line AS l1, y.line AS l2, z.line AS l3
  FROM said x JOIN said y ON x.doc_id = y.doc_id AND y.n = x.n + 1 JOIN said z ON x.doc_id = z.doc_id AND z.n = x.n + 2),
later AS (SELECT doc_id, a, b FROM wins QUALIFY row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN later r ON l.doc_id = r.doc_id AND l.i BETWEEN r.a AND r.b)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(g.n, 0) AS n_removed
FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id) k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
""",
    "op2_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 20
    + len(regexp_extract_all(text, '<\\*(?:/?s>|image>|audio>|document>)')) + len(regexp_extract_all(text, '\[\\*/?INST\]')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op5_decontaminate": r"""
WITH items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS p
  FROM items WHERE len(w) > 0),
docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
runs AS (
  SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {'i': i, 'p': array_to_string(w[i:i + k - 1], ' ')})) AS r
  FROM docs CROSS JOIN (SELECT DISTINCT k FROM patterns)),
hits AS (SELECT doc_id, runs.k, r.i AS i, item_id FROM runs JOIN patterns ON patterns.k = runs.k AND patterns.p = r.p),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN names n ON n.doc_id = d.doc_id
""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
last AS (SELECT html, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN last USING (html)
""",
    "op11_fill_middle": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS d FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(d, k, 8))::BIGINT) AS h FROM units),
cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""",
    "op12_periodic_runs": r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
hashed AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM documents CROSS JOIN crc),
drawn AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM hashed),
listed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM drawn),
placed AS (
  SELECT doc_id, n, unnest(range(n)) AS i, CASE WHEN h % 10 = 0 THEN g % n ELSE n END AS a, g FROM drawn WHERE n > 0),
said AS (
  SELECT p.doc_id, p.n, p.i, l.word FROM placed p JOIN listed l
    ON l.doc_id = p.doc_id AND l.i = CASE WHEN p.i < p.a THEN p.i ELSE p.a + (p.i - p.a) % (1 + (p.n - p.a) // (3 + p.g % 8)) END),
fives AS (
  SELECT doc_id, n, i, word || ' ' || lead(word, 1) OVER t || ' ' || lead(word, 2) OVER t || ' ' || lead(word, 3) OVER t || ' ' || lead(word, 4) OVER t AS f
  FROM said WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (
  SELECT p.doc_id, p.i, q.i - p.i AS lag FROM fives p JOIN fives q ON p.doc_id = q.doc_id AND p.f = q.f AND q.i > p.i AND 4 * (q.i - p.i) <= p.n),
islands AS (SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, lag, min(i) AS start, count(*) + 4 + lag AS length FROM islands GROUP BY doc_id, lag, island),
runs AS (SELECT doc_id, start, length, min(lag) AS period FROM stretches WHERE length >= greatest(6, 4 * lag) GROUP BY doc_id, start, length),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM said ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, l.start::BIGINT AS start, l.length::BIGINT AS length, l.period::BIGINT AS period, (1000 * l.length // l.period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id LEFT JOIN longest l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "license_base": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
phrases AS (SELECT * FROM (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) t(p, label)),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS place FROM words CROSS JOIN phrases),
found AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels
FROM words w LEFT JOIN found f ON f.doc_id = w.doc_id
""",
    "url_rules": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM parts),
named AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(verdict, h, p)),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT n.page_id, host, path, rule, verdict FROM named n LEFT JOIN best b ON b.page_id = n.page_id
""",
}
