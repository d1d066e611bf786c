"""Training-corpus pipeline: each stage's rows are written as Parquet and read back as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from scholarframe.llm.catalog import tokenizer_path
from scholarframe.plans.tables import importable, settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go.

    A null or empty text is scored as one without words; repeated rows and null ids are judged each; an empty table stays
    empty; without labels all stay."""
    importable(spark)
    docs = docs.select(*COLUMNS)
    scored = toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.where("score < 0.7").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out of the texts, and n_chars follows; all rows stay but
    those whose every line went.

    A null text and its n_chars stay null; rows equal in id and text lose the same lines; a null id comes before others."""
    importable(spark)
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    gone = (F.col("n_removed") > 0) & (F.trim("text") == "")
    count = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", count).select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, that with the smallest id stays.

    Texts that are null or without words link with nothing and stay, as do rows without an id; rows that repeat
    the smallest id of a class are the same document and all stay."""
    importable(spark)
    docs = docs.select(*COLUMNS)
    classes = ngram_join.jaccard_classes(docs, size=5, percent=80)
    later = classes.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all words of a shorter item, go.

    A null text has no words and stays; repeated rows and null ids are judged each; an empty benchmark drops nothing."""
    importable(spark)
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their places in sequences of 4096 tokens.

    A null or empty text is the end id alone; repeated rows and null ids are packed each."""
    importable(spark)
    return packing.pack(docs, tokenizer_path(), limit=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL can express neither the trees nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is settled in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
