"""Readers of recorded source payloads: JSON and XML files into one record shape.

Every reader takes a path that Spark can open and returns RECORD's columns.  Malformed files cost only
themselves: JSON is read permissively and missing fields are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.functions.text import first_year, trim

RECORD = ("source_id", "source_record_id", "doi", "title", "abstract", "authors", "year", "venue", "citation_count", "is_oa", "pdf_url", "landing_page_url")
AUTHORS = "array<struct<name:string,orcid:string>>"

RECORD_SCHEMA = f"source_id string, source_record_id string, doi string, title string, abstract string, authors {AUTHORS}, year int, venue string, citation_count bigint, is_oa boolean, pdf_url string, landing_page_url string"


def abstract_from_index(index: Column) -> Column:
    """Text of an inverted index word -> positions; null or empty is null."""
    words = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " "), F.lit(""))


def inverted_index(texts: DataFrame, key: str) -> DataFrame:
    """(key, index) of (key, words): each text's words with their positions, made within its row, so that no word is shuffled.  Null words are a null index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, words, places, lengths = [0], [], [], [0]
            for own in batch.column(1).to_pylist():
                at: dict[str, list[int]] = {}
                for i, word in enumerate(own or ()):
                    at.setdefault(word, []).append(i)
                words.extend(at)
                for p in at.values():
                    places.extend(p)
                    lengths.append(len(places))
                ends.append(len(words))
            positions = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(places, pa.int32()))
            maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()), positions)
            index = pc.if_else(batch.column(1).is_valid(), maps, pa.nulls(len(maps), maps.type)) if batch.column(1).null_count else maps
            yield pa.record_batch([batch.column(0), index], [key, "index"])

    return texts.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, index map<string, array<int>>")


def strip_prefix(value: Column) -> Column:
    """A DOI, ORCID or work id without its resolver's address."""
    return F.nullif(F.regexp_replace(value, r"^https?://(?:dx\.)?(?:doi|orcid|openalex)\.org/", ""), F.lit(""))


def _record(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    types = {"authors": AUTHORS, "year": "int", "citation_count": "bigint", "is_oa": "boolean"}
    return df.select(*((F.lit(source) if c == "source_id" else columns.get(c, F.lit(None)).cast(types.get(c, "string"))).alias(c) for c in RECORD))


#: Where a source's payload has its entries, and where an entry has its year.
ENTRIES = {
    "openalex": (("results",), ("publication_year",)),
    "crossref": (("message", "items"), ("published", "date-parts", 0, 0)),
    "europepmc": (("resultList", "result"), ("pubYear",)),
    "doaj": (("results",), ("bibjson", "year")),
    "semanticscholar": (("data",), ("year",)),
    "core": (("results",), ("yearPublished",)),
}


def _json(spark: SparkSession, path: str | DataFrame, schema: str, root: str) -> DataFrame:
    """A payload's entries, from files of whole payloads, or from rows whose column `payload` is one entry each."""
    if isinstance(path, DataFrame):
        whole = F.concat(F.lit("".join(f'{{"{k}":' for k in root.split("."))), F.lit("["), F.col("payload"), F.lit("]" + "}" * len(root.split("."))))
        rows = path.where("payload is not null").select(F.from_json(whole, schema).alias("p")).select("p.*")
    else:
        rows = _payloads(spark, path, schema)
    return rows.select(F.explode(root).alias("r")).select("r.*")


def _payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole payloads: one a line in a folder or file named .jsonl, one a file in any other."""
    return spark.read.schema(schema).option("multiLine", not path.rstrip("/").endswith(".jsonl")).json(path)


def _names(people: str, name: str, orcid: str | None = None) -> Column:
    return F.expr(f"transform({people}, a -> named_struct('name', {name}, 'orcid', {orcid or 'cast(null AS string)'}))")


def openalex(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, "results array<struct<id:string,doi:string,title:string,display_name:string,publication_year:int,cited_by_count:bigint,primary_location:struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string>>,open_access:struct<is_oa:boolean,oa_url:string>,authorships:array<struct<author:struct<display_name:string,orcid:string>>>,abstract_inverted_index:map<string,array<int>>>>", "results")
    return _record(rows, "openalex", source_record_id=strip_prefix(F.col("id")), doi=strip_prefix(F.col("doi")), title=F.coalesce("title", "display_name"), abstract=abstract_from_index(F.col("abstract_inverted_index")), authors=_names("authorships", "a.author.display_name", "regexp_replace(a.author.orcid, '^https?://orcid.org/', '')"), year=F.col("publication_year"), venue=F.col("primary_location.source.display_name"), citation_count=F.col("cited_by_count"), is_oa=F.col("open_access.is_oa"), pdf_url=F.coalesce("primary_location.pdf_url", "open_access.oa_url"), landing_page_url=F.col("primary_location.landing_page_url"))


def crossref(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, "message struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string,ORCID:string>>,published:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,`is-referenced-by-count`:bigint,abstract:string,link:array<struct<URL:string,`content-type`:string>>,URL:string,page:string>>>", "message.items")
    pdf = F.expr("get(filter(link, l -> l.`content-type` = 'application/pdf'), 0).URL")
    text = F.nullif(trim(F.regexp_replace(F.regexp_replace("abstract", "<[^>]+>", " "), r"\s+", " ")), F.lit(""))
    return _record(rows, "crossref", source_record_id=F.col("DOI"), doi=F.lower("DOI"), title=F.get("title", 0), abstract=text, authors=_names("author", "concat_ws(' ', a.given, a.family)", "regexp_replace(a.ORCID, '^https?://orcid.org/', '')"), year=F.expr("get(get(published.`date-parts`, 0), 0)"), venue=F.get("container-title", 0), citation_count=F.col("is-referenced-by-count"), pdf_url=pdf, landing_page_url=F.col("URL"))


def europepmc(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, "resultList struct<result:array<struct<id:string,pmid:string,doi:string,title:string,authorString:string,journalTitle:string,pubYear:string,citedByCount:bigint,isOpenAccess:string,abstractText:string,pageInfo:string>>>", "resultList.result")
    people = F.filter(F.transform(F.split(F.regexp_replace("authorString", r"\.$", ""), ","), lambda a: trim(a)), lambda a: a != "")
    return _record(rows, "europepmc", source_record_id=F.col("id"), doi=F.lower("doi"), title=F.col("title"), abstract=F.col("abstractText"), authors=F.transform(people, lambda a: F.struct(a.alias("name"), F.lit(None).cast("string").alias("orcid"))), year=F.col("pubYear").try_cast("int"), venue=F.col("journalTitle"), citation_count=F.col("citedByCount"), is_oa=F.col("isOpenAccess") == "Y")


def doaj(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, "results array<struct<id:string,bibjson:struct<title:string,author:array<struct<name:string>>,journal:struct<title:string>,year:string,abstract:string,identifier:array<struct<type:string,id:string>>,link:array<struct<type:string,url:string>>>>>", "results").select("id", "bibjson.*")
    return _record(rows, "doaj", source_record_id=F.col("id"), doi=F.expr("lower(get(filter(identifier, i -> i.type = 'doi'), 0).id)"), title=F.col("title"), abstract=F.col("abstract"), authors=_names("author", "a.name"), year=F.col("year").try_cast("int"), venue=F.col("journal.title"), is_oa=F.lit(True), landing_page_url=F.expr("get(filter(link, l -> l.type = 'fulltext'), 0).url"))


def semanticscholar(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, "data array<struct<paperId:string,title:string,abstract:string,year:int,venue:string,citationCount:bigint,openAccessPdf:struct<url:string>,externalIds:struct<DOI:string>,authors:array<struct<name:string>>>>", "data")
    return _record(rows, "semanticscholar", source_record_id=F.col("paperId"), doi=F.lower("externalIds.DOI"), title=F.col("title"), abstract=F.col("abstract"), authors=_names("authors", "a.name"), year=F.col("year"), venue=F.nullif("venue", F.lit("")), citation_count=F.col("citationCount"), is_oa=F.col("openAccessPdf.url").isNotNull(), pdf_url=F.col("openAccessPdf.url"))


def core(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, "results array<struct<id:string,doi:string,title:string,abstract:string,authors:array<struct<name:string>>,yearPublished:int,publisher:string,journals:array<struct<title:string>>,downloadUrl:string>>", "results")
    return _record(rows, "core", source_record_id=F.col("id"), doi=F.lower("doi"), title=F.col("title"), abstract=F.col("abstract"), authors=_names("authors", "a.name"), year=F.col("yearPublished"), venue=F.coalesce(F.get("journals", 0)["title"], F.col("publisher")), is_oa=F.lit(True), pdf_url=F.col("downloadUrl"))


def unpaywall(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, "results array<struct<score:double,response:struct<doi:string,title:string,year:int,journal_name:string,is_oa:boolean,best_oa_location:struct<url:string,url_for_pdf:string>,z_authors:array<struct<given:string,family:string>>>>>", "results").select("response.*")
    return _record(rows, "unpaywall", source_record_id=F.col("doi"), doi=F.lower("doi"), title=F.col("title"), authors=_names("z_authors", "concat_ws(' ', a.given, a.family)"), year=F.col("year"), venue=F.col("journal_name"), is_oa=F.col("is_oa"), pdf_url=F.coalesce("best_oa_location.url_for_pdf", "best_oa_location.url"))


def arxiv(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries, by Spark's XML reader; a title may be one element or several."""
    schema = "id string, published string, title array<string>, summary string, author array<struct<name:string>>, `arxiv:doi` array<string>, link array<struct<_href:string,_title:string,_rel:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    flat = lambda c: F.nullif(trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return _record(rows, "arxiv", source_record_id=F.regexp_extract("id", r"abs/(.+?)(?:v\d+)?$", 1), doi=F.lower(F.get("arxiv:doi", 0)), title=flat(F.get("title", 0)), abstract=flat(F.col("summary")), authors=_names("author", "a.name"), year=first_year(F.col("published")), venue=F.lit("arXiv"), is_oa=F.lit(True), pdf_url=F.expr("get(filter(link, l -> l._title = 'pdf'), 0)._href"), landing_page_url=F.col("id"))


def pubmed(spark: SparkSession, summaries: str, abstracts: str) -> DataFrame:
    """Summaries keyed by uid, left-joined with the abstracts' labelled parts in their order."""
    one = "struct<uid:string,title:string,pubdate:string,source:string,fulljournalname:string,authors:array<struct<name:string>>,articleids:array<struct<idtype:string,value:string>>>"
    raw = spark.read.schema("result string").option("multiLine", True).json(summaries)
    rows = raw.select(F.explode(F.map_values(F.from_json("result", "map<string,string>"))).alias("v")).select(F.from_json("v", one).alias("r")).where("r.uid is not null").select("r.*")
    part = "MedlineCitation struct<PMID:string,Article:struct<Abstract:struct<AbstractText:array<string>>>>"
    texts = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(part).load(abstracts)
    texts = texts.select(F.col("MedlineCitation.PMID").alias("uid"), F.nullif(F.array_join("MedlineCitation.Article.Abstract.AbstractText", " "), F.lit("")).alias("abstract"))
    rows = rows.join(texts, "uid", "left")
    return _record(rows, "pubmed", source_record_id=F.col("uid"), doi=F.expr("lower(get(filter(articleids, i -> i.idtype = 'doi'), 0).value)"), title=F.col("title"), abstract=F.col("abstract"), authors=_names("authors", "a.name"), year=first_year(F.col("pubdate")), venue=F.coalesce("fulljournalname", "source"))


#: Rows of a page that a source gives at most.
PAGE_SIZES = {"openalex": 50, "crossref": 50, "europepmc": 50, "doaj": 50, "semanticscholar": 100, "core": 100}


def page_window(source: str, page: Column, per_page: Column) -> Column:
    """(limit, offset) of a page of a source, pages from 1; null asks for the first page, of 20 rows, and so does a page or a size below 1."""
    asked = F.when(per_page >= 1, per_page).otherwise(20)
    limit = F.least(asked, F.lit(PAGE_SIZES.get(source, 50)))
    return F.struct(limit.cast("long").alias("limit"), (F.greatest(F.coalesce(page, F.lit(1)) - 1, F.lit(0)) * limit).cast("long").alias("offset"))


#: Sources that take a range of years.
YEAR_SOURCES = ("openalex", "crossref", "europepmc", "doaj", "semanticscholar")


def year_filter(source: str, year_from: Column, year_to: Column, this_year: int) -> Column:
    """The source's own words for a range of years; null where none is asked for, and for a source that takes no range."""
    asked = F.coalesce(year_from, year_to).isNotNull()
    if source not in YEAR_SOURCES:
        return F.lit(None).cast("string")
    first, last = F.coalesce(year_from, F.lit(1000)).cast("string"), F.coalesce(year_to, F.lit(this_year)).cast("string")
    if source == "crossref":
        parts = (F.concat(F.lit("from-pub-date:"), year_from.cast("string"), F.lit("-01-01")), F.concat(F.lit("until-pub-date:"), year_to.cast("string"), F.lit("-12-31")))
        return F.when(asked, F.concat_ws(",", *parts))
    if source == "doaj":
        return F.when(asked, F.concat(F.lit("bibjson.year:["), first, F.lit(" TO "), last, F.lit("]")))
    if source == "semanticscholar":  # an open end is left empty
        return F.when(asked, F.concat(F.coalesce(year_from.cast("string"), F.lit("")), F.lit("-"), F.coalesce(year_to.cast("string"), F.lit(""))))
    if source == "europepmc":
        return F.when(asked, F.concat(F.lit("PUB_YEAR:["), first, F.lit(" TO "), last, F.lit("]")))
    return F.when(asked, F.concat(F.lit("publication_year:"), first, F.lit("-"), last))


def opencitations(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(doi, title, year) of a list of citing or cited works, DOIs only."""
    rows = _payloads(spark, path, "citing string, cited string")
    return rows.select(F.col(kind).alias("doi"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year")).where("doi is not null")


def semanticscholar_edges(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(doi, title, year) of a list of citing or cited papers; entries without a paper go."""
    paper = f"{kind}Paper"
    rows = _json(spark, path, f"data array<struct<{paper}:struct<title:string,year:int,externalIds:struct<DOI:string>>>>", "data").where(f"{paper} is not null")
    return rows.select(F.col(f"{paper}.externalIds.DOI").alias("doi"), F.col(f"{paper}.title").alias("title"), F.col(f"{paper}.year").alias("year"))


def publications(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, title, year) of an author's works; ids are bare, entries without one go."""
    rows = _json(spark, path, "results array<struct<id:string,display_name:string,publication_year:int>>", "results").where("id <> ''")
    return rows.select(F.regexp_replace("id", r"^https?://openalex\.org/", "").alias("id"), F.lit("publication").alias("kind"), F.coalesce("display_name", F.lit("Untitled work")).alias("title"), F.col("publication_year").alias("year"))


def peer_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, title, year) of a person's reviews, out of three nested levels; entries without a number go."""
    summary = "struct<`put-code`:bigint,`completion-date`:struct<year:struct<value:string>>>"
    groups = _json(spark, path, f"group array<struct<`peer-review-group`:array<struct<`peer-review-summary`:array<{summary}>>>>>", "group")
    flat = groups.select(F.explode("peer-review-group").alias("g")).select(F.explode("g.peer-review-summary").alias("s")).where("s.`put-code` is not null")
    return flat.select(F.col("s.put-code").cast("string").alias("id"), F.lit("peer_review").alias("kind"), F.lit("Peer review").alias("title"), F.col("s.completion-date.year.value").try_cast("int").alias("year"))


READERS = {"openalex": openalex, "crossref": crossref, "europepmc": europepmc, "doaj": doaj, "semanticscholar": semanticscholar, "core": core, "unpaywall": unpaywall, "arxiv": arxiv}


def fan_out(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(records of all sources that can be read, status of each): one failure costs a status row, not the search."""
    found, status = [], []
    for source, path in paths.items():
        try:
            rows = READERS[source](spark, path)
            rows.limit(1).collect()  # a whole row, so that it is parsed
            found.append(rows)
            status.append((source, "ok", None))
        except (AnalysisException, Py4JJavaError, PySparkException, KeyError) as error:
            status.append((source, "error", type(error).__name__))
    empty = spark.createDataFrame([], RECORD_SCHEMA)
    return reduce(DataFrame.unionByName, found, empty), spark.createDataFrame(status, "source_id string, status string, error string")


