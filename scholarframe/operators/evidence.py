"""Evidence: guards on quotations and citations, matrices with their exports, library tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.text import citation_markers, csv_field, keep_markers, sentences, trim


def squeeze(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def quote_appears(source: Column, quote: Column) -> Column:
    """Containment after white space and case are evened out; an empty quote appears nowhere."""
    return (squeeze(quote) != "") & F.contains(squeeze(source), squeeze(quote))


def keep_quoted(findings: DataFrame) -> DataFrame:
    """Findings whose quote stands in the source and whose value stands in the quote."""
    return findings.where(quote_appears(F.col("source"), F.col("quote")) & quote_appears(F.col("quote"), F.col("value")))


def findings_once(findings: DataFrame, group: str, order: str) -> DataFrame:
    """Each group's findings whose quote and value stand where they should, each field and value once, the first."""
    kept = keep_quoted(findings)
    return kept.withColumn("_k", F.row_number().over(Window.partitionBy(group, "field", "value").orderBy(order))).where("_k = 1").drop("_k")


def known_only(rows: DataFrame, key: str, names: str, known: DataFrame, name: str) -> DataFrame:
    """(key, names): of each row's array `names` those that `known` has, in order, repeats kept; none gives an empty array."""
    one = rows.select(key, F.posexplode_outer(names).alias("_i", "_n"))
    met = one.join(known.select(F.col(name).alias("_n"), F.lit(True).alias("_known")).distinct(), "_n", "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("_known"), F.struct("_i", "_n"))))
    return met.groupBy(key).agg(F.transform(kept, lambda x: x["_n"]).alias(names))


def interpretation_holds(grid: Column, header_row: Column, units: Column, description: Column) -> Column:
    """Header within the grid, a unit or null per column, every unit written in some cell, and a description."""
    cells = F.transform(F.flatten(grid), squeeze)
    unit = lambda u: u.isNull() | (u == "") | F.exists(cells, lambda c: F.contains(c, squeeze(u)))
    return (header_row >= 0) & (header_row < F.size(grid)) & (F.size(units) == F.size(F.get(grid, 0))) & F.forall(units, unit) & (trim(F.coalesce(description, F.lit(""))) != "")


def validate_draft(drafts: DataFrame, key: str, text: str, allowed: list[str]) -> DataFrame:
    """Per draft: kept sentences, foreign markers taken out, and how many sentences and citations were dropped.

    Keys are compared as they are, whatever characters they hold; without any allowed key every sentence goes."""
    permitted = F.array(*map(F.lit, allowed)).cast("array<string>")
    one = drafts.select(key, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    cited = one.withColumn("all", citation_markers(F.col("sentence"))).withColumn("kept", F.filter("all", lambda k: F.array_contains(permitted, k)))
    clean = trim(F.regexp_replace(keep_markers(F.col("sentence"), permitted), r"\s{2,}", " "))
    kept = F.when(F.size("kept") > 0, F.struct("pos", clean.alias("s")))
    return cited.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["s"]), "\n").alias("text"),
        F.count_if(F.size("kept") == 0).alias("dropped_uncited"),
        F.sum(F.size("all") - F.size("kept")).alias("dropped_foreign"),
    )


def validate_outline(drafts: DataFrame, key: str, text: str, allowed: list[str]) -> DataFrame:
    """Slides (# headings) and their bullets with a permitted citation; bullets before a heading don't count."""
    permitted = F.array(*map(F.lit, allowed))
    lines = drafts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.regexp_extract("line", r"^#{1,3}\s+(.+)$", 1)
    bullet = trim(F.regexp_extract("line", r"^\s*[-*]\s+(.+)$", 1))
    marked = lines.withColumns({"title": trim(heading), "is_heading": F.col("line").rlike(r"^#{1,3}\s+.+$"), "bullet": bullet})
    slides = marked.withColumn("slide", F.count_if("is_heading").over(w)).where("slide > 0")
    cited = slides.withColumn("all", citation_markers(F.col("bullet"))).withColumn("kept", F.filter("all", lambda k: F.array_contains(permitted, k)))
    is_bullet = ~F.col("is_heading") & (F.col("bullet") != "")
    per_slide = cited.groupBy(key, "slide").agg(
        F.max(F.when(F.col("is_heading"), F.col("title"))).alias("title"),
        F.count_if(is_bullet & (F.size("kept") > 0)).alias("bullets"),
        F.count_if(is_bullet & (F.size("kept") == 0)).alias("uncited"),
        F.sum(F.when(is_bullet, F.size("all") - F.size("kept")).otherwise(0)).alias("foreign"),
    ).where("title <> ''")
    return per_slide.groupBy(key).agg(F.count_if(F.col("bullets") > 0).alias("slides"), F.sum("bullets").alias("bullets"), F.sum("uncited").alias("dropped_uncited"), F.sum("foreign").alias("dropped_foreign"), F.count_if(F.col("bullets") == 0).alias("dropped_slides"))


def missing_pairs(rows: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs of a matrix without a cell, or whose cell failed; a matrix's own rows and columns meet, nothing else."""
    done = cells.where("status <> 'error'").select("matrix_id", "row_id", "column_id")
    return rows.join(columns, "matrix_id").join(done, ["matrix_id", "row_id", "column_id"], "left_anti")


def export_wide(cells: DataFrame, columns: int) -> DataFrame:
    """One line per row: value with unit, page and quote for each column position from 0."""
    value = F.concat_ws(" ", "value", "unit")
    picked = [F.coalesce(F.max(F.when(F.col("position") == p, e)), F.lit("")).alias(f"{name}_{p}") for p in range(columns) for name, e in (("value", value), ("page", F.col("page").cast("string")), ("quote", F.col("quote")))]
    return cells.groupBy("row_id").agg(*picked)


def to_csv(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, line): the row's RFC 4180 line; lines are joined with CRLF by whoever writes the file."""
    return rows.select(key, F.concat_ws(",", *(csv_field(F.col(c).cast("string")) for c in columns)).alias("line"))


def to_markdown(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """(key, table): a Markdown table of each group's rows."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}\n"
    lines = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))).alias("lines"))
    return lines.select(key, F.concat(F.lit(head), F.array_join(F.col("lines.line"), "\n")).alias("table"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] = ()) -> DataFrame:
    """old with new's rows in place of or besides its own; columns of `keep_old` stay where new has null."""
    cols = [c for c in old.columns if c not in keys]
    o, n = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in cols), F.lit(1).alias("_o")), new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in cols), F.lit(1).alias("_n"))
    pick = lambda c: F.coalesce(f"n_{c}", f"o_{c}") if c in keep_old else F.when(F.col("_n") == 1, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    return o.join(n, keys, "full").select(*keys, *(pick(c).alias(c) for c in cols))
