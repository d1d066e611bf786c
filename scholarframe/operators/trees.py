"""Documents as trees of nodes, kept as variants: unnested level by level and rendered by ordered aggregation.

A node has a type, content (an array of nodes), text, marks and attrs.  A round takes all nodes of one level in all documents to
their children, so there are as many rounds as the deepest tree has levels, whatever the number of documents.  A node's place is its
path, the positions from the root down, and the order of paths is the reading order.

Blocks are the root's children, and the nodes inside the items of a list.  All that stands under a block that is no list is
inline: its texts and citations are joined in their order.  Lists are put together from the innermost out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.functions.text import safe_stem
from scholarframe.plans.tables import settle

#: How a missing work is shown, and the characters that LaTeX reads.
MISSING = "[missing citation]"
LISTS = ("bulletList", "orderedList")


def latex_escape(text: Column) -> Column:
    """Body text in which LaTeX's reserved characters stand for themselves, in the order of steps that the braces need."""
    text = F.replace(text, F.lit("\\"), F.lit("\\textbackslash{}"))
    text = F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")
    return F.replace(F.replace(text, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\textasciicircum{}"))


def _told(rows: DataFrame) -> DataFrame:
    """rows (key, path, owner, role, v) with the node's own fields."""
    of = lambda path, kind: F.expr(f"try_variant_get(v, '{path}', '{kind}')")
    marks = F.expr("transform(try_variant_get(v, '$.marks', 'array<variant>'), m -> try_variant_get(m, '$.type', 'string'))")
    text = F.expr("CASE WHEN schema_of_variant(variant_get(v, '$.text')) = 'STRING' THEN try_variant_get(v, '$.text', 'string') END")
    return rows.select("key", "path", "owner", "role", of("$.type", "string").alias("type"), text.alias("text"), marks.alias("marks"), of("$.attrs.level", "double").alias("level"), of("$.attrs.workKey", "string").alias("work_key"), "v")


def nodes(docs: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, path, owner, role, type, text, marks, level, work_key) of all nodes below the root, of trees of any depth.

    role is block, item or inline; owner is the path of the block that an inline node is in.  A text that is null or no JSON object has no nodes; content
    that is no array has no children; citations and nodes with a text are not looked into."""
    none = F.array().cast("array<int>")
    level = docs.select(F.col(key).alias("key"), none.alias("path"), none.alias("owner"), F.lit("root").alias("role"), F.try_parse_json(F.col(tree)).alias("v")).where("v is not null")
    level = _told(level)
    found = None
    while True:
        leaf = F.coalesce(F.col("type") == "citation", F.lit(False)) | F.col("text").isNotNull()
        inside = level.where(~leaf | (F.col("role") == "root"))
        children = inside.select("key", "path", "owner", "role", "type", F.posexplode(F.expr("try_variant_get(v, '$.content', 'array<variant>')")).alias("pos", "v"))
        path = F.concat("path", F.array(F.col("pos").cast("int")))
        is_list = (F.col("role") == "block") & F.coalesce(F.col("type").isin(*LISTS), F.lit(False))
        role = F.when((F.col("role") == "root") | (F.col("role") == "item"), "block").when(is_list, "item").otherwise("inline")
        owner = F.when(F.col("role") == "inline", F.col("owner")).otherwise(F.col("path"))
        level = settle(_told(children.select("key", path.alias("path"), owner.alias("owner"), role.alias("role"), "v")), "level")
        if level.isEmpty():
            break
        own = level.drop("v")
        found = own if found is None else found.unionByName(own)
    return found if found is not None else level.drop("v")


def cited(tree: DataFrame) -> DataFrame:
    """(key, position, work_key): the works that each document cites, once, in reading order."""
    first = tree.where("type = 'citation' and work_key <> ''").groupBy("key", "work_key").agg(F.min("path").alias("at"))
    listed = first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "work_key"))).alias("all"))
    return listed.select("key", F.posexplode("all").alias("position", "x")).select("key", "position", "x.work_key")


def _joined(c: Column, part: str, by: Column | str) -> Column:
    """What the group's rows have, in the order of their paths."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", c.alias(part)))), lambda x: x[part]), by)


def body(tree: DataFrame, labels: DataFrame, latex: bool) -> DataFrame:
    """(key, body): each document's blocks rendered in Markdown or LaTeX, blank ones left out, a blank line between.

    labels has work_key and label, what a citation of the work is shown as; others are shown as missing."""
    marked = lambda mark: F.coalesce(F.array_contains("marks", mark), F.lit(False))
    wrap = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    text = latex_escape(F.col("text")) if latex else F.col("text")
    text = F.when(marked("italic"), wrap("\\emph{", text, "}") if latex else wrap("*", text, "*")).otherwise(text)
    text = F.when(marked("bold"), wrap("\\textbf{", text, "}") if latex else wrap("**", text, "**")).otherwise(text)
    shown = F.coalesce("label", F.lit("\\textbf{" + MISSING + "}" if latex else MISSING))
    leaves = tree.where("role = 'inline' and (type = 'citation' or text is not null)").join(labels.select("work_key", "label"), "work_key", "left")
    pieces = leaves.withColumn("piece", F.when(F.col("type") == "citation", shown).otherwise(text))
    inner = pieces.groupBy("key", F.col("owner").alias("own")).agg(_joined(F.col("piece"), "piece", "").alias("inner"))
    blocks = tree.where("role = 'block'").withColumn("own", F.col("path")).join(inner, ["key", "own"], "left").withColumn("inner", F.coalesce("inner", F.lit("")))
    level = F.coalesce("level", F.lit(1.0))
    if latex:
        command = F.when(level <= 1, "section").when(level == 2, "subsection").otherwise("subsubsection")
        heading, quote = F.concat(F.lit("\\"), command, F.lit("{"), F.col("inner"), F.lit("}")), wrap("\\begin{quote}\n", F.col("inner"), "\n\\end{quote}")
    else:
        heading = F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), level.cast("int")))), F.lit(" "), F.col("inner"))
        quote = F.concat(F.lit("> "), F.replace(F.col("inner"), F.lit("\n"), F.lit("\n> ")))
    plain = F.when(F.col("type") == "heading", heading).when(F.col("type") == "blockquote", quote).otherwise(F.col("inner"))
    told = settle(blocks.select("key", "path", "type", plain.alias("out")), "blocks")
    is_list = F.coalesce(F.col("type").isin(*LISTS), F.lit(False))
    items = settle(tree.where("role = 'item'").select("key", F.col("path").alias("item")), "items")
    done = told.where(~is_list).select("key", "path", "out")
    lists = settle(told.where(is_list).select("key", "path", "type", F.size("path").alias("depth")), "lists")
    for depth in sorted((r["depth"] for r in lists.select("depth").distinct().collect()), reverse=True):
        own = lists.where(F.col("depth") == depth)
        # A list's items are one step below it, an item's blocks two.
        said = done.where(F.size("path") == depth + 2).withColumn("item", F.slice("path", 1, depth + 1)).groupBy("key", "item").agg(_joined(F.col("out"), "out", " ").alias("out"))
        of_items = items.where(F.size("item") == depth + 1).join(said, ["key", "item"], "left").withColumn("out", F.coalesce("out", F.lit("")))
        of_items = of_items.withColumn("list", F.slice("item", 1, depth)).withColumnRenamed("item", "path")
        rows = of_items.groupBy("key", F.col("list").alias("own")).agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "out"))), lambda x: x["out"]).alias("rows"))
        put = own.withColumn("own", F.col("path")).join(rows, ["key", "own"], "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<string>")))
        bullet = F.col("type") == "bulletList"
        if latex:
            env = F.when(bullet, "itemize").otherwise("enumerate")
            lines = F.array_join(F.transform("rows", lambda x: F.concat(F.lit("  \\item "), x)), "\n")
            out = F.concat(F.lit("\\begin{"), env, F.lit("}\n"), lines, F.lit("\n\\end{"), env, F.lit("}"))
        else:
            out = F.array_join(F.transform("rows", lambda x, i: F.when(bullet, F.concat(F.lit("- "), x)).otherwise(F.concat((i + 1).cast("string"), F.lit(". "), x))), "\n")
        done = settle(done.unionByName(put.select("key", "path", out.alias("out"))), "blocks")
    whole = done.where(F.size("path") == 1).where(F.col("out").rlike(r"\S"))
    return whole.groupBy("key").agg(_joined(F.col("out"), "out", "\n\n").alias("body"))


def export(docs: DataFrame, key: str, title: str, tree: str, works: DataFrame) -> DataFrame:
    """(key, format, filename, content, bib) of each document in Markdown, LaTeX, BibTeX and RIS; bib is LaTeX's companion file.

    works has work_key, label (in a text), entry (in the references), bib_key, bibtex and ris.  Documents without nodes have empty bodies and lists."""
    seen = settle(nodes(docs, key, tree), "nodes")
    order = settle(cited(seen).join(works, "work_key", "left"), "cited")
    list_of = lambda c, by, name: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", c.alias("c")))), lambda x: x["c"]), by).alias(name)
    lost = F.concat(F.lit(MISSING + " ("), F.col("work_key"), F.lit(")"))
    lists = order.groupBy("key").agg(list_of(F.concat(F.lit("- "), F.coalesce("entry", lost)), "\n", "references"), list_of(F.col("bibtex"), "\n\n", "bibtex"), list_of(F.col("ris"), "\n\n", "ris"))
    markdown, latex = body(seen, works.select("work_key", "label"), False), body(seen, works.select("work_key", F.concat(F.lit("\\cite{"), F.col("bib_key"), F.lit("}")).alias("label")), True)
    named = docs.select(F.col(key).alias("key"), F.col(title).alias("title")).join(markdown.withColumnRenamed("body", "markdown"), "key", "left").join(latex.withColumnRenamed("body", "latex"), "key", "left").join(lists, "key", "left")
    named = named.na.fill("", ["markdown", "latex", "references", "bibtex", "ris"])
    stem = safe_stem(F.col("title"), "manuscript")
    md = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("markdown"), F.lit("\n\n## References\n\n"), F.col("references"))
    tex = F.concat(F.lit("\\documentclass{article}\n\\usepackage[utf8]{inputenc}\n\\title{"), latex_escape(F.col("title")), F.lit("}\n\\begin{document}\n\\maketitle\n\n"), F.col("latex"), F.lit("\n\n\\bibliographystyle{plain}\n\\bibliography{"), stem, F.lit("}\n\\end{document}"))
    none = F.lit(None).cast("string")
    file = lambda kind, ending, content, bib=none: F.struct(F.lit(kind).alias("format"), F.concat(stem, F.lit(ending)).alias("filename"), content.alias("content"), bib.alias("bib"))
    files = F.array(file("markdown", ".md", md), file("latex", ".tex", tex, F.col("bibtex")), file("bibtex", ".bib", F.col("bibtex")), file("ris", ".ris", F.col("ris")))
    return named.select("key", F.inline(files))
