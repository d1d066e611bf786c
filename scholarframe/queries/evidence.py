"""Queries on guards, matrices, exports and library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarframe.functions import text as T
from scholarframe.operators import evidence as E
from scholarframe.plans.tables import table

ALLOWED = ["k1", "k2", "k5"]


def quote_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether words 3 to 8 of each document, in capitals, stand in it, and in the next document."""
    docs = table(spark, sf_dir, "documents")
    words = F.split("text", r"\s+")
    quoted = docs.select("doc_id", "text", F.translate(F.array_join(F.slice(words, 3, 6), "  "), "etaoinshr", "ETAOINSHR").alias("quote"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return quoted.join(after, "doc_id", "left").select("doc_id", E.quote_appears(F.col("text"), F.col("quote")).alias("own"), E.quote_appears(F.col("other"), F.col("quote")).alias("next"))


def _drafts(spark, sf_dir):
    """Conversations' turns with markers that their position decides."""
    marks = F.when(F.col("turn") % 3 == 0, F.lit(" [[k1]]. ")).when(F.col("turn") % 3 == 1, F.lit(" [[ k9 ]] [[k2]]! ")).otherwise(F.lit("? "))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.regexp_replace("text", r"\.\s", "; "), marks, F.lit("Then more.")).alias("text"))


def sentence_guard(spark, sf_dir):
    return E.validate_draft(_drafts(spark, sf_dir), "id", "text", ALLOWED).select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "dropped_uncited", "dropped_foreign")


def outline_guard(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## "), x)).when(i % 3 == 1, F.concat(F.lit("- "), x, F.lit(" [[k1]] [[z]]"))).otherwise(F.concat(F.lit("* "), x)))
    made = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_join(lines, "\n").alias("text"))
    return E.validate_outline(made, "id", "text", ALLOWED)


def page_citations(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("See [p. "), F.col("doc_id") % 90, F.lit("] and [pp. "), F.col("n_chars"), F.lit("–"), F.col("n_chars") + 2, F.lit("], not [p.].")).alias("t"))
    return made.select("doc_id", F.array_join(F.transform(T.page_citations(F.col("t")), lambda p: p.cast("string")), ",").alias("pages"))


def text_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.count_words(F.col("text")).alias("words"), F.size(T.sentences(F.col("text"))).alias("sentences"))


def page_normalize(spark, sf_dir):
    plain = F.regexp_replace("html", "<[^>]*>", "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.normalize_page(plain).cast("binary")).alias("text_md5"))


def extract_json(spark, sf_dir):
    wrapped = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Sure:\n```json\n"), F.when(F.col("event_id") % 7 == 0, F.lit("{")).otherwise(F.lit("")), F.col("props"), F.lit("\n```")).alias("t"))
    return wrapped.select("event_id", F.try_variant_get(T.extract_json(F.col("t")), "$.k", "long").alias("k"), T.extract_json(F.col("t")).isNotNull().alias("parsed"))


def _matrix(spark, sf_dir):
    """Parts as matrix rows, seven a matrix; suppliers' last digit as its columns; cells from lineitem."""
    rows = table(spark, sf_dir, "part").selectExpr("cast(p_partkey / 7 AS bigint) AS matrix_id", "p_partkey AS row_id")
    columns = rows.select("matrix_id").distinct().join(F.broadcast(spark.range(5).select(F.col("id").alias("column_id"))))
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row_id"), (F.col("l_suppkey") % 5).alias("column_id")).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")).alias("x"))
    cells = cells.selectExpr("cast(row_id / 7 AS bigint) AS matrix_id", "row_id", "column_id", "x.l_quantity AS value", "case when x.l_returnflag = 'R' then 'error' else 'found' end AS status", "x.l_orderkey AS page")
    return rows, columns, cells


def missing_pairs(spark, sf_dir):
    return E.missing_pairs(*_matrix(spark, sf_dir))


def matrix_counts(spark, sf_dir):
    """Rows, columns and tallies of each matrix; children are counted before they are joined."""
    rows, columns, cells = _matrix(spark, sf_dir)
    r, c = rows.groupBy("matrix_id").agg(F.count("*").alias("rows")), columns.groupBy("matrix_id").agg(F.count("*").alias("columns"))
    t = cells.groupBy("matrix_id").agg(F.count_if(F.col("status") == "found").alias("found"), F.count_if(F.col("status") == "error").alias("errors"))
    joined = r.join(c, "matrix_id", "left").join(t, "matrix_id", "left").na.fill(0)
    return joined.withColumn("estimate", (F.col("rows") * F.col("columns") - F.col("found")) * 3)


def matrix_export_wide(spark, sf_dir):
    cells = _matrix(spark, sf_dir)[2].where("status = 'found'").selectExpr("row_id", "column_id AS position", "cast(cast(value AS int) AS string) AS value", "'mg' AS unit", "page", "concat('q', page) AS quote")
    return E.export_wide(cells, 3)


def csv_export(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("=SUM("), F.col("c_name"), F.lit(")"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('say "'), F.col("c_name"), F.lit('", ok'))).otherwise(F.col("c_name")).alias("name"), "c_mktsegment", "c_nationkey")
    return E.to_csv(rows, "c_custkey", ["name", "c_mktsegment", "c_nationkey"])


def markdown_export(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat(F.col("n_name"), F.lit("|x")).alias("n_name"))
    return E.to_markdown(rows, "n_regionkey", ["n_name", "n_nationkey"], "n_nationkey")


def library_list(spark, sf_dir):
    """Saved orders of each customer with the customer's name, latest first."""
    saved = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return saved.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").select("o_custkey", "o_orderkey", "c_name", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())).alias("place"))


def collection_counts(spark, sf_dir):
    items = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("items"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(items, "c_custkey", "left").na.fill(0)


def collection_items(spark, sf_dir):
    """Items of each collection with what they name, those of unknown parts too."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left").select("l_orderkey", "l_linenumber", "p_name")


def saved_membership(spark, sf_dir):
    """Each part, whether any order saved it, and whether any sent it back."""
    kept = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.lit(True).alias("saved"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    marked = table(spark, sf_dir, "part").select("p_partkey").join(kept, "p_partkey", "left")
    return marked.select("p_partkey", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("saved", "returned")))


def next_position(spark, sf_dir):
    top = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("m"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(top, "o_orderkey", "left").select("o_orderkey", (F.coalesce("m", F.lit(-1)) + 1).alias("next"))


def resolve_works(spark, sf_dir):
    """A customer's own snapshot first, else the part's record, else nothing."""
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("own"))
    shared = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("shared"))
    return asked.join(own, "key", "left").join(shared, "key", "left").select("key", F.coalesce("own", "shared").alias("title"))


def upsert_latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = E.latest(orders.where("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderkey").alias("rev"), "o_orderstatus", F.lit(None).cast("string").alias("note")), ["o_custkey"], ["rev"]).withColumn("note", F.concat(F.lit("n"), F.col("rev")))
    new = E.latest(orders.where("o_orderkey % 2 = 1").select("o_custkey", F.col("o_orderkey").alias("rev"), "o_orderstatus", F.lit(None).cast("string").alias("note")), ["o_custkey"], ["rev"])
    return E.upsert(old, new, ["o_custkey"], keep_old=["note"])


def embedding_misses(spark, sf_dir):
    """Documents whose vector is missing or of another model."""
    cached = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS doc_id", "case when label % 3 <> 0 then concat('m', label % 2) end AS model")
    return table(spark, sf_dir, "documents").select("doc_id").join(cached, "doc_id", "left").where(~F.col("model").eqNullSafe(F.lit("m1"))).select("doc_id")


def revision_ring(spark, sf_dir):
    """The 20 newest events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("k")).where("k <= 20")


def adopt_session(spark, sf_dir):
    """Anonymous rows of a session get its user; others stay."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 50 AS session", "case when o_orderkey % 3 = 0 then o_custkey end AS owner")
    return rows.select("o_orderkey", F.when((F.col("session") == 7) & F.col("owner").isNull(), 9999).otherwise(F.col("owner")).alias("owner"))


def collection_reorder(spark, sf_dir):
    """New positions for the ids of a list, unknown ones ignored; others keep theirs."""
    order = spark.createDataFrame([(i, k) for k, i in enumerate((5, 3, 424242, 1))], "l_linenumber int, new int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(F.broadcast(order), "l_linenumber", "left").select("l_orderkey", "l_linenumber", F.coalesce("new", "l_linenumber").alias("position"))


def delete_cascade(spark, sf_dir):
    """Lines left after some orders went."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


def document_ingest(spark, sf_dir):
    """First document of each owner and content; later copies are the same document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return docs.groupBy("source", "sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("uploads"))


def topic_aggregate(spark, sf_dir):
    """The 40 heaviest topics: part types, weighted by discount; weights under 0.02 don't count."""
    lines = table(spark, sf_dir, "lineitem").where("l_discount >= 0.02").select("l_partkey", "l_orderkey", "l_discount")
    topics = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_brand", "p_type").alias("name")), "l_partkey")
    total = topics.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("l_discount"), 6).alias("weight"))
    return total.orderBy(F.col("weight").desc(), F.col("n").desc(), "name").limit(40)


def topic_drop_universal(spark, sf_dir):
    """Of the top topics, those that not every region has."""
    t = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_regionkey", "n_name")), "c_nationkey")
    topics = t.select("n_regionkey", "c_mktsegment").union(t.select("n_regionkey", "n_name")).distinct().toDF("region", "name")
    total = table(spark, sf_dir, "region").agg(F.count("*").alias("total"))
    top = topics.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(40)
    return top.join(F.broadcast(total)).where("total < 5 or n < total").select("name", "n")


QUERIES = {f.__name__: f for f in (quote_guard, sentence_guard, outline_guard, page_citations, text_counts, page_normalize, extract_json, missing_pairs, matrix_counts, matrix_export_wide, csv_export, markdown_export, library_list, collection_counts, collection_items, saved_membership, next_position, resolve_works, upsert_latest, embedding_misses, revision_ring, adopt_session, collection_reorder, delete_cascade, document_ingest, topic_aggregate, topic_drop_universal)}

_SQ = "lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"
_MATRIX = "r AS (SELECT p_partkey // 7 AS matrix_id, p_partkey AS row_id FROM part), c AS (SELECT DISTINCT matrix_id, unnest(range(5)) AS column_id FROM r), x AS (SELECT l_partkey AS row_id, l_suppkey % 5 AS column_id, min({'a': l_orderkey, 'b': l_linenumber, 'q': l_quantity, 'f': l_returnflag}) AS x FROM lineitem GROUP BY ALL), cells AS (SELECT row_id // 7 AS matrix_id, row_id, column_id, x.q AS value, CASE WHEN x.f = 'R' THEN 'error' ELSE 'found' END AS status, x.a AS page FROM x)"
_DRAFT = "d AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '\\.\\s', '; ', 'g') || CASE turn % 3 WHEN 0 THEN ' [[k1]]. ' WHEN 1 THEN ' [[ k9 ]] [[k2]]! ' ELSE '? ' END || 'Then more.' AS t FROM conversations), s AS (SELECT id, generate_subscripts(a, 1) AS pos, trim(unnest(a)) AS s FROM (SELECT id, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM d))"

ORACLE_SQL = {
    "quote_guard": f"WITH q AS (SELECT doc_id, text, translate(array_to_string((string_split_regex(text, '\\s+'))[3:8], '  '), 'etaoinshr', 'ETAOINSHR') AS quote, lead(text) OVER (ORDER BY doc_id) AS other FROM documents) SELECT doc_id, {_SQ.format('quote')} <> '' AND contains({_SQ.format('text')}, {_SQ.format('quote')}) AS own, {_SQ.format('quote')} <> '' AND contains({_SQ.format('other')}, {_SQ.format('quote')}) AS next FROM q",
    "sentence_guard": f"WITH {_DRAFT}, k AS (SELECT *, len(regexp_extract_all(s, '\\[\\[[^\\]]+\\]\\]')) AS n, len(regexp_extract_all(s, '\\[\\[\\s*(k1|k2|k5)\\s*\\]\\]')) AS kept, trim(regexp_replace(replace(s, '[[ k9 ]]', ''), '\\s{{2,}}', ' ', 'g')) AS clean FROM s WHERE s <> '') SELECT id, md5(coalesce(string_agg(clean, chr(10) ORDER BY pos) FILTER (kept > 0), '')) AS text_md5, count(*) FILTER (kept = 0) AS dropped_uncited, sum(n - kept)::BIGINT AS dropped_foreign FROM k GROUP BY id",
    "outline_guard": "WITH l AS (SELECT conv_id * 1000 + turn AS id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, trim(unnest(string_split(text, chr(10)))) AS line FROM conversations), g AS (SELECT id, i // 3 AS slide, max(CASE WHEN i % 3 = 0 THEN line END) AS title, count(*) FILTER (i % 3 = 1) AS bullets, count(*) FILTER (i % 3 = 2 AND line <> '') AS uncited FROM l GROUP BY ALL) SELECT id, count(*) FILTER (bullets > 0) AS slides, sum(bullets)::BIGINT AS bullets, sum(uncited)::BIGINT AS dropped_uncited, sum(bullets)::BIGINT AS dropped_foreign, count(*) FILTER (bullets = 0) AS dropped_slides FROM g WHERE title <> '' GROUP BY id",
    "page_citations": "SELECT doc_id, (doc_id % 90)::VARCHAR || CASE WHEN n_chars < 9998 THEN ',' || n_chars ELSE '' END AS pages FROM documents",
    "text_counts": "SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) END AS words, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS sentences FROM documents",
    "extract_json": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN (props::JSON->>'$.k')::BIGINT END AS k, event_id % 7 <> 0 AS parsed FROM events",
    "missing_pairs": f"WITH {_MATRIX} SELECT r.matrix_id, row_id, column_id FROM r JOIN c USING (matrix_id) ANTI JOIN (SELECT * FROM cells WHERE status <> 'error') d USING (matrix_id, row_id, column_id)",
    "matrix_counts": f"WITH {_MATRIX} SELECT matrix_id, rows, 5 AS columns, coalesce(found, 0) AS found, coalesce(errors, 0) AS errors, (rows * 5 - coalesce(found, 0)) * 3 AS estimate FROM (SELECT matrix_id, count(*) AS rows FROM r GROUP BY 1) LEFT JOIN (SELECT matrix_id, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'error') AS errors FROM cells GROUP BY 1) USING (matrix_id)",
    "matrix_export_wide": f"WITH {_MATRIX}, f AS (SELECT row_id, column_id AS p, value::INT || ' mg' AS v, page::VARCHAR AS g, 'q' || page AS q FROM cells WHERE status = 'found') SELECT row_id, " + ", ".join(f"coalesce(max({e}) FILTER (p = {p}), '') AS {n}_{p}" for p in range(3) for n, e in (("value", "v"), ("page", "g"), ("quote", "q"))) + " FROM f GROUP BY row_id",
    "csv_export": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '"' || chr(9) || '=SUM(' || c_name || ')"' WHEN 1 THEN '"say ""' || c_name || '"", ok"' ELSE c_name END || ',' || c_mktsegment || ',' || c_nationkey AS line FROM customer""",
    "markdown_export": "SELECT n_regionkey, '| n_name | n_nationkey |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || '\\|x | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS table FROM nation GROUP BY 1",
    "library_list": "SELECT o_custkey, o_orderkey, c_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "collection_counts": "SELECT c_custkey, count(o_orderkey) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "collection_items": "SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey",
    "saved_membership": "SELECT p_partkey, count(l_partkey) > 0 AS saved, coalesce(bool_or(l_returnflag = 'R'), false) AS returned FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
    "next_position": "SELECT o_orderkey, coalesce(max(l_linenumber), -1) + 1 AS next FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "resolve_works": "SELECT k AS key, coalesce(c_name, CASE WHEN p_partkey % 2 = 0 THEN p_name END) AS title FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) LEFT JOIN customer ON c_custkey = k LEFT JOIN part ON p_partkey = k",
    "upsert_latest": "WITH o AS (SELECT o_custkey, max(o_orderkey) AS rev, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey, max(o_orderkey) AS rev, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(n.rev, o.rev) AS rev, coalesce(n.s, o.s) AS o_orderstatus, 'n' || o.rev AS note FROM o FULL JOIN n ON o.o_custkey = n.o_custkey",
    "embedding_misses": "SELECT doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE (CASE WHEN label % 3 <> 0 THEN 'm' || (label % 2) END) IS DISTINCT FROM 'm1'",
    "revision_ring": "SELECT user_id, event_id, k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20",
    "adopt_session": "SELECT o_orderkey, CASE WHEN o_custkey % 50 = 7 AND o_orderkey % 3 <> 0 THEN 9999 WHEN o_orderkey % 3 = 0 THEN o_custkey END AS owner FROM orders",
    "collection_reorder": "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 5 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 3 ELSE l_linenumber END AS position FROM lineitem",
    "delete_cascade": "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "document_ingest": "SELECT source, sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS uploads FROM documents GROUP BY ALL",
    "topic_aggregate": "SELECT p_brand || ' ' || p_type AS name, count(*) AS n, round(sum(l_discount), 6) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount >= 0.02::DOUBLE GROUP BY 1 ORDER BY weight DESC, n DESC, name LIMIT 40",
    "topic_drop_universal": "WITH t AS (SELECT DISTINCT n_regionkey AS r, unnest([c_mktsegment, n_name]) AS name FROM customer JOIN nation ON n_nationkey = c_nationkey), top AS (SELECT name, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, name LIMIT 40) SELECT name, n FROM top WHERE n < (SELECT count(*) FROM region) OR (SELECT count(*) FROM region) < 5",
}
