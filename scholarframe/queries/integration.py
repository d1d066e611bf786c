"""Queries on source integration, caches, costs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.functions import text as T
from scholarframe.operators import cite, evidence, integrate, rank, trees
from scholarframe.plans.tables import numbered, settle, table
from scholarframe.plans.views import raw_work
from scholarframe.queries.citing import csl
from scholarframe.queries.works import QUERY, ranked_works

#: Credits that a feature is estimated to cost; others cost 4.
ESTIMATES = {"summary": 2, "query_understanding": 1, "topic_labels": 3, "citation_reasoning": 6, "chat_turn": 4, "document_chat_turn": 8, "synthesis_turn": 10, "paraphrase": 6, "extraction": 12, "table_interpretation": 2, "findings": 5, "matrix_cell": 3, "grounded_draft": 14, "deck_outline": 16, "find_support": 3}


def estimate(feature):
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ESTIMATES.items() for x in pair))[feature], F.lit(4))


def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature is estimated to cost a call, and cost all events as calls of it; one feature has no estimate of its own."""
    named = F.element_at(F.array(*map(F.lit, [*ESTIMATES, "other"])), (F.col("event_id") % (len(ESTIMATES) + 1) + 1).cast("int"))
    calls = table(spark, sf_dir, "events").select(named.alias("feature"))
    return calls.groupBy("feature").agg(F.count("*").alias("calls")).select("feature", estimate(F.col("feature")).alias("estimate"), "calls", (F.col("calls") * estimate(F.col("feature"))).alias("credits"))


def preflight(spark, sf_dir):
    """Whether each customer may run a draft: the account covers the estimate."""
    need = estimate(F.lit("grounded_draft"))
    balance = F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 100)).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", balance.alias("balance"), (balance >= need).alias("allowed"), F.greatest(F.lit(0), need - balance).alias("short"))


def cache_fresh(spark, sf_dir):
    """Cached searches that have not expired, the last of each key."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("key"), "event_id", (F.col("ts") + F.expr("make_dt_interval(0, 0, 15)")).alias("expires"))
    newest = table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("make_dt_interval(3)")).alias("now"))
    return evidence.latest(rows.join(F.broadcast(newest)).where("expires >= now").drop("now"), ["key"], ["expires", "event_id"]).select("key", "event_id")


def search_cache_keys(spark, sf_dir):
    """Cache keys of the benchmark's whole texts as queries: the same for any case and outer blanks."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("  "), F.translate("text", "aeiou", "AEIOU"), F.lit(" ")).alias("q"), F.col("text").alias("p"))
    key = lambda c: T.search_key(F.col(c), F.struct(F.lit(1).alias("oa")))
    return rows.select("item_id", key("q").alias("asked"), key("p").alias("key")).select("item_id", "key", (F.col("asked") == F.col("key")).alias("same"))


def _bibliographic(spark, sf_dir):
    block = F.struct((F.col("ord") % 40).cast("string").alias("volume"), F.when(F.col("ord") % 2 == 0, (F.col("ord") % 9).cast("string")).alias("issue"))
    works = raw_work(spark, sf_dir).withColumn("biblio", F.when(F.col("ord") % 3 != 1, block))
    return works.withColumn("cluster", F.floor(F.col("ord") / 20))


def biblio_block(spark, sf_dir):
    """Each cluster's bibliographic block, whole, from the highest source that has one."""
    merged = integrate.reconcile(_bibliographic(spark, sf_dir))
    return merged.select("cluster", "biblio.volume", "biblio.issue")


def topic_union(spark, sf_dir):
    """Each cluster's topics with their largest score, best first, ties by first sight."""
    topic = lambda tag, many, of: F.struct(F.concat(F.lit(tag), F.col("ord") % many).alias("name"), ((F.col("ord") % of) / (of - 1)).alias("score"))
    works = raw_work(spark, sf_dir).withColumn("cluster", F.floor(F.col("ord") / 20)).withColumn("topics", F.array(topic("t", 7, 11), topic("u", 5, 13)))
    return integrate.reconcile(works).select("cluster", F.array_join(F.col("topics.name"), ",").alias("topics"))


def filter_topics(spark, sf_dir):
    """Works with a topic of the chosen set, among those of a year range."""
    works = raw_work(spark, sf_dir).where("year >= 2000").select("ord", F.array(F.concat(F.lit("t"), F.col("ord") % 7), F.concat(F.lit("u"), F.col("ord") % 5)).alias("topics"))
    return works.where(F.arrays_overlap("topics", F.array(F.lit("t3"), F.lit("u1")))).select("ord")


def known_concepts(spark, sf_dir):
    """Of each label's concepts only those that exist, in order, repeats kept."""
    made = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_brand"), F.lit("Brand#nowhere"), F.col("p_type"), F.col("p_brand")).alias("c"))
    known = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_brand").alias("concept"))
    return evidence.known_only(made, "p_partkey", "c", known, "concept").select("p_partkey", F.array_join("c", ",").alias("kept"))


def support_candidates(spark, sf_dir):
    """Up to eight candidates per customer: own items first, then shared ones not among them."""
    own = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 30).alias("key"), F.lit(0).alias("tier"))
    shared = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(F.broadcast(spark.range(10).select(F.col("id").alias("key"), F.lit(1).alias("tier"))))
    fresh = shared.join(own.select("o_custkey", "key"), ["o_custkey", "key"], "left_anti")
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("tier", "key")
    return own.distinct().unionByName(fresh).withColumn("place", F.row_number().over(w)).where("place <= 8").select("o_custkey", "key", "place")


def contributions(spark, sf_dir):
    """Publications and reviews of each customer from three nested levels, as one list."""
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("items"))
    groups = nested.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "items")).alias("groups"))
    flat = groups.select("l_orderkey", F.explode("groups").alias("g")).select("l_orderkey", F.col("g.l_suppkey").alias("group"), F.explode("g.items").alias("i"))
    works = flat.where("i.l_returnflag <> 'R'").select("l_orderkey", "group", F.col("i.l_linenumber").alias("item"), F.lit("publication").alias("kind"))
    reviews = flat.where("i.l_returnflag = 'R'").select("l_orderkey", "group", F.col("i.l_linenumber").alias("item"), F.lit("peer_review").alias("kind"))
    return works.unionByName(reviews)


def citation_edges(spark, sf_dir):
    """Edges of two lists, null ends dropped, each edge once with the lists that have it."""
    a = table(spark, sf_dir, "lineitem").selectExpr("concat('p', l_partkey % 200) AS citing", "case when l_linenumber <> 3 then concat('s', l_suppkey % 50) end AS cited", "'a' AS list")
    b = table(spark, sf_dir, "lineitem").where("l_quantity > 25").selectExpr("concat('p', l_partkey % 200) AS citing", "concat('s', l_suppkey % 50) AS cited", "'b' AS list")
    return a.unionByName(b).where("cited is not null").groupBy("citing", "cited").agg(F.array_join(F.sort_array(F.collect_set("list")), "").alias("lists"))


def replace_all(spark, sf_dir):
    """Findings after some documents' were replaced: theirs are the new ones only."""
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("version"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("new").alias("version"))
    return old.join(new.select("l_orderkey"), "l_orderkey", "left_anti").unionByName(new)


def source_admin(spark, sf_dir):
    """Sources as administered: sponsors in order, none last."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("sponsor"))
    return numbered(rows, "place", F.col("sponsor").asc_nulls_last(), F.col("s_suppkey")).select("s_suppkey", "place")


def lookback(spark, sf_dir):
    """Snapshots of the last days, the number clamped to 1 to 30."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("now"))
    days = {n: max(1, min(30, n)) for n in (0, 7, 99)}
    return events.join(F.broadcast(last)).agg(*(F.count_if(F.col("ts") >= F.col("now") - F.expr(f"make_dt_interval({d})")).alias(f"asked_{n}") for n, d in days.items()))


def page_slice(spark, sf_dir):
    """The second page of a search, with the number of all matches."""
    # Settled narrow, so that the works are made and ranked once for both.
    ranked = settle(ranked_works(spark, sf_dir, QUERY).select("cluster", "score"), "ranked")
    total = ranked.agg(F.count("*").alias("total"))
    return rank.page(ranked, 2, 15).select("cluster", "score").join(F.broadcast(total))


def attribution(spark, sf_dir):
    """Sponsor names fit for a header: printable ASCII, trimmed, at most 120 characters."""
    name = F.concat(F.lit(" é\t"), F.col("s_name"), F.lit(" ü ")), F.lit("x")
    clean = F.substring(F.trim(F.regexp_replace(name[0], r"[^\x20-\x7E]", "")), 1, 120)
    return table(spark, sf_dir, "supplier").select("s_suppkey", clean.alias("header"))


def interpretation_guard(spark, sf_dir):
    """Whether made-up readings of small grids hold."""
    grid = F.array(F.array(F.col("n_name"), F.lit("Mean (mg/dL)")), F.array(F.lit("a"), F.lit("1")))
    units = F.array(F.lit(None).cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "mg/dl").otherwise("mmol"))
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", evidence.interpretation_holds(grid, (F.col("n_nationkey") % 3).cast("int"), units, F.lit("d")).alias("holds"))


def collection_export(spark, sf_dir):
    """Collections of ten works as RIS text."""
    works = csl(spark, sf_dir)
    entries = works.select(F.floor(F.col("doc_id") / 10).alias("collection"), "doc_id", cite.ris(works).alias("entry"))
    return entries.groupBy("collection").agg(F.sort_array(F.collect_list(F.struct("doc_id", "entry"))).alias("all")).select("collection", F.md5(F.array_join(F.col("all.entry"), "\n\n").cast("binary")).alias("text_md5"), F.size("all").alias("works"))


def manuscript_export(spark, sf_dir):
    """A document tree per nation in Markdown and LaTeX."""
    tree = F.concat(F.lit('{"type":"doc","content":[{"type":"heading","content":[{"type":"text","text":"'), F.col("n_name"), F.lit(' & co"}]},{"type":"p","content":[{"type":"text","text":"50% ","marks":[{"type":"bold"}]},{"type":"citation","attrs":{"workKey":"w'), F.col("n_nationkey"), F.lit('"}}]}]}'))
    docs = table(spark, sf_dir, "nation").select("n_nationkey", tree.alias("tree"))
    seen = settle(trees.nodes(docs, "n_nationkey", "tree"), "nodes")
    label = lambda a, b: seen.where("work_key is not null").select("work_key", F.concat(F.lit(a), F.col("work_key"), F.lit(b)).alias("label")).distinct()
    markdown, latex = trees.body(seen, label("[@", "]"), False), trees.body(seen, label("\\cite{", "}"), True)
    return markdown.join(latex.withColumnRenamed("body", "latex"), "key").select(F.col("key").alias("n_nationkey"), F.col("body").alias("markdown"), "latex")


def manuscript_files(spark, sf_dir):
    """Conversations as manuscripts with headings, lists in lists and citations, some unknown, in four formats."""
    cited = lambda k: F.concat(F.lit('{"type":"citation","attrs":{"workKey":"w'), k.cast("string"), F.lit('"}}'))
    said = lambda t, marks="": F.concat(F.lit('{"type":"text","text":'), F.to_json(F.array(t)).substr(F.lit(2), F.char_length(F.to_json(F.array(t))) - 2), F.lit(f',"marks":[{marks}]}}'))
    node = lambda kind, *content: F.concat(F.lit(f'{{"type":"{kind}","attrs":{{"level":2}},"content":['), F.concat_ws(",", *content), F.lit("]}"))
    first = F.get(F.split(F.col("text"), "\n"), 0)
    inner = node("bulletList", node("listItem", node("p", said(F.lit("inner")))), node("listItem", node("p", cited(F.col("conv_id") + 1))))
    outer = node("orderedList", node("listItem", node("p", said(first)), node("p", cited(F.col("conv_id")))), node("listItem", inner))
    tree = node("doc", node("heading", said(F.lit("100% & more"))), node("p", said(F.lit("It "), '{"type":"italic"},{"type":"bold"}'), cited(F.lit("none")), cited(F.col("conv_id"))), outer, node("blockquote", said(F.lit("a\nb"))))
    docs = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.concat(F.lit("Conversation: "), F.col("conv_id")).alias("title"), tree.alias("tree"))
    key = F.col("doc_id").cast("string")
    works = table(spark, sf_dir, "documents").select(F.concat(F.lit("w"), key).alias("work_key"), F.concat(F.lit("("), key, F.lit(")")).alias("label"), F.concat(F.lit("Work "), F.col("n_chars")).alias("entry"), F.concat(F.lit("b"), key).alias("bib_key"), F.concat(F.lit("@misc{b"), key, F.lit("}")).alias("bibtex"), F.concat(F.lit("TY  - "), key).alias("ris"))
    return trees.export(docs, "conv_id", "title", "tree", works).select(F.col("key").alias("conv_id"), "format", "filename", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.md5(F.col("bib").cast("binary")).alias("bib_md5"))


QUERIES = {f.__name__: f for f in (cost_table, preflight, cache_fresh, search_cache_keys, biblio_block, topic_union, filter_topics, known_concepts, support_candidates, contributions, citation_edges, replace_all, source_admin, lookback, page_slice, attribution, interpretation_guard, collection_export, manuscript_export, manuscript_files)}

from scholarframe.queries.citing import ORACLE_SQL as _CITING  # noqa: E402
from scholarframe.queries.works import RANKED_SQL, RAW_WORK_SQL  # noqa: E402

ORACLE_SQL = {
    "cost_table": "WITH n AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate([*ESTIMATES.items(), ("other", 4)])) + f") t(i, feature, estimate)) SELECT feature, estimate, count(*) AS calls, sum(estimate)::BIGINT AS credits FROM events JOIN n ON event_id % {len(ESTIMATES) + 1} = i GROUP BY ALL",
    "preflight": "SELECT c_custkey, b AS balance, b >= 14 AS allowed, greatest(0, 14 - b) AS short FROM (SELECT c_custkey, greatest(0, floor(c_acctbal / 100))::BIGINT AS b FROM customer)",
    "cache_fresh": "SELECT key, event_id FROM (SELECT event_id % 500 AS key, event_id, ts + INTERVAL 15 MINUTE AS e FROM events) WHERE e >= (SELECT max(ts) - INTERVAL 3 DAY FROM events) QUALIFY row_number() OVER (PARTITION BY key ORDER BY e DESC, event_id DESC) = 1",
    "search_cache_keys": "SELECT item_id, sha256(to_json({'query': lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), 'filters': {'oa': 1}})::VARCHAR) AS key, true AS same FROM benchmark",
    "biblio_block": f"WITH {RAW_WORK_SQL}, b AS (SELECT ord // 20 AS cluster, ord, coalesce(list_position(['crossref','openalex','europepmc','pubmed','doaj'], source_id), 6) AS p FROM raw_work WHERE ord % 3 <> 1) SELECT cluster, (o % 40)::VARCHAR AS volume, CASE WHEN o % 2 = 0 THEN (o % 9)::VARCHAR END AS issue FROM (SELECT cluster, arg_min(ord, {{'p': p, 'o': ord}}) AS o FROM b GROUP BY 1)",
    "topic_union": "WITH t AS (SELECT doc_id // 20 AS c, doc_id AS o, 0 AS i, 't' || (doc_id % 7) AS name, (doc_id % 11) / 10.0::DOUBLE AS s FROM documents UNION ALL SELECT doc_id // 20, doc_id, 1, 'u' || (doc_id % 5), (doc_id % 13) / 12.0::DOUBLE FROM documents), b AS (SELECT c, name, max(s) AS s, min({'o': o, 'i': i}) AS f FROM t GROUP BY ALL) SELECT c AS cluster, string_agg(name, ',' ORDER BY s DESC, f) AS topics FROM b GROUP BY c",
    "filter_topics": f"WITH {RAW_WORK_SQL} SELECT ord FROM raw_work WHERE year >= 2000 AND (ord % 7 = 3 OR ord % 5 = 1)",
    "known_concepts": "WITH k AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_size < 25) SELECT p_partkey, CASE WHEN p_brand IN (SELECT b FROM k) THEN p_brand || ',' || p_brand ELSE '' END AS kept FROM part",
    "support_candidates": "WITH o AS (SELECT DISTINCT o_custkey, o_orderkey % 30 AS key FROM orders), a AS (SELECT o_custkey, key, 0 AS tier FROM o UNION ALL SELECT c_custkey, k, 1 FROM customer, (SELECT unnest(range(10)) AS k) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = c_custkey AND o.key = k)) SELECT o_custkey, key, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY tier, key) AS place FROM a) WHERE place <= 8",
    "contributions": 'SELECT l_orderkey, l_suppkey AS "group", l_linenumber AS item, CASE WHEN l_returnflag = \'R\' THEN \'peer_review\' ELSE \'publication\' END AS kind FROM lineitem',
    "citation_edges": "WITH e AS (SELECT 'p' || (l_partkey % 200) AS citing, 's' || (l_suppkey % 50) AS cited, 'a' AS l FROM lineitem WHERE l_linenumber <> 3 UNION SELECT 'p' || (l_partkey % 200), 's' || (l_suppkey % 50), 'b' FROM lineitem WHERE l_quantity > 25) SELECT citing, cited, string_agg(l, '' ORDER BY l) AS lists FROM e GROUP BY ALL",
    "replace_all": "WITH n AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') SELECT l_orderkey, l_linenumber, 'old' AS version FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM n) UNION ALL SELECT o_orderkey, 0, 'new' FROM n",
    "source_admin": "SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN s_name END NULLS LAST, s_suppkey) AS place FROM supplier",
    "lookback": "SELECT " + ", ".join(f"count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL {d} DAY) AS asked_{n}" for n, d in ((0, 1), (7, 7), (99, 30))) + " FROM events",
    "page_slice": RANKED_SQL + "SELECT cluster, score, (SELECT count(*) FROM scored) AS total FROM scored ORDER BY score DESC, cluster LIMIT 15 OFFSET 15",
    "attribution": "SELECT s_suppkey, s_name AS header FROM supplier",
    "interpretation_guard": "SELECT n_nationkey, n_nationkey % 3 < 2 AND n_nationkey % 2 = 0 AS holds FROM nation",
    "collection_export": _CITING["cite_ris"].replace("SELECT doc_id, concat_ws(chr(10), 'TY", "SELECT doc_id // 10 AS collection, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5, count(*)::INT AS works FROM (SELECT doc_id, concat_ws(chr(10), 'TY", 1) + ") GROUP BY 1",
    "manuscript_files": r"""
WITH d AS (SELECT conv_id AS i, string_split(text, chr(10))[1] AS t, chr(10) AS n FROM conversations WHERE turn = 0),
w AS (SELECT doc_id AS i, n_chars FROM documents),
x AS (
  SELECT d.*, a.i IS NOT NULL AS k0, b.i IS NOT NULL AS k1, a.n_chars AS c0, b.n_chars AS c1,
    replace(regexp_replace(replace(t, '\', '\textbackslash{}'), '([&%$#_{}])', '\\1', 'g'), '~', '\textasciitilde{}') AS e FROM d LEFT JOIN w a ON a.i = d.i LEFT JOIN w b ON b.i = d.i + 1),
m AS (
  SELECT *, '[missing citation]' AS q, CASE WHEN k0 THEN '(' || i || ')' ELSE '[missing citation]' END AS m0, CASE WHEN k1 THEN '(' || (i + 1) || ')' ELSE '[missing citation]' END AS m1,
    CASE WHEN k0 THEN '\cite{b' || i || '}' ELSE '\textbf{[missing citation]}' END AS l0, CASE WHEN k1 THEN '\cite{b' || (i + 1) || '}' ELSE '\textbf{[missing citation]}' END AS l1,
    replace(e, '^', '\textasciicircum{}') AS f,
    concat_ws(n || n, CASE WHEN k0 THEN '@misc{b' || i || '}' END, CASE WHEN k1 THEN '@misc{b' || (i + 1) || '}' END) AS bib, concat_ws(n || n, CASE WHEN k0 THEN 'TY  - ' || i END, CASE WHEN k1 THEN 'TY  - ' || (i + 1) END) AS ris FROM x),
f AS (
  SELECT i, 'markdown' AS format, '.md' AS ending, '# Conversation: ' || i || n || n || '## 100% & more' || n || n || '***It ***' || q || m0 || n || n || '1. ' || t || ' ' || m0 || n || '2. - inner' || n || '- ' || m1 || n || n || '> a' || n || '> b'
    || n || n || '## References' || n || n || '- ' || q || ' (wnone)' || n || '- ' || coalesce('Work ' || c0, q || ' (w' || i || ')') || n || '- ' || coalesce('Work ' || c1, q || ' (w' || (i + 1) || ')') AS content, NULL AS bib FROM m
  UNION ALL SELECT i, 'latex', '.tex', '\documentclass{article}' || n || '\usepackage[utf8]{inputenc}' || n || '\title{Conversation: ' || i || '}' || n || '\begin{document}' || n || '\maketitle' || n || n
    || '\subsection{100\% \& more}' || n || n || '\textbf{\emph{It }}\textbf{[missing citation]}' || l0 || n || n || '\begin{enumerate}' || n || '  \item ' || f || ' ' || l0 || n || '  \item \begin{itemize}' || n || '  \item inner' || n || '  \item ' || l1 || n || '\end{itemize}' || n || '\end{enumerate}'
    || n || n || '\begin{quote}' || n || 'a' || n || 'b' || n || '\end{quote}' || n || n || '\bibliographystyle{plain}' || n || '\bibliography{Conversation ' || i || '}' || n || '\end{document}', bib FROM m
  UNION ALL SELECT i, 'bibtex', '.bib', bib, NULL FROM m UNION ALL SELECT i, 'ris', '.ris', ris, NULL FROM m)
SELECT i AS conv_id, format, 'Conversation ' || i || ending AS filename, md5(content) AS content_md5, md5(bib) AS bib_md5 FROM f""",
    "manuscript_export": "SELECT n_nationkey, '# ' || n_name || ' & co' || chr(10) || chr(10) || '**50% **[@w' || n_nationkey || ']' AS markdown, '\\section{' || replace(n_name, '_', '\\_') || ' \\& co}' || chr(10) || chr(10) || '\\textbf{50\\% }\\cite{w' || n_nationkey || '}' AS latex FROM nation",
}
