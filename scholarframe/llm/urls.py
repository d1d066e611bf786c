"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

In DataFrame functions only.  A rule names a host, which stands for its subdomains too, and a path's
beginning; the longest rule that fits decides.  Other URLs are judged by trees that learn from
labelled URLs.  Shares of blocked URLs, by suffix, by class of the path's first segment and by both, are cross-fitted: a URL that
trains gets those of the other folds' rows, so that no row's feature tells its own label.

A URL may also be known without a label.  Such rows train as not blocked, and scores are divided by the mean score of
held-out blocked rows: with labels missing at random among the blocked, that is the chance of being blocked (Elkan and Noto, 2008).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.functions.text import let
from scholarframe.llm.trees import BoostedTrees, sample_share
from scholarframe.plans.tables import settle

SAMPLE_ROWS = 20_000
#: Folds of labelled rows, by their url and page_id.
FOLDS = 5
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "host_length", "labels", "hyphens", "fragment", "secure", "extension", "suffix_log_count", "suffix_block_rate", "section_block_rate", "suffix_section_block_rate"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null; of equal length, the first in order.

    rules: (verdict, host followed by path from its first /).  One null-safe chain of conditions, longest first."""
    parts = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = (host == domain) | F.endswith(host, F.lit("." + domain))
        parts.append(F.when(fits & F.startswith(path, F.lit(slash + rest)), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*parts) if parts else F.lit(None).cast("struct<verdict:string,rule:string>")


def section(path: Column) -> Column:
    """The class of a path's first segment: itself, if it has two letters, else one of four names, so 680 at most."""
    first = F.lower(F.regexp_extract(path, r"^/([^/]*)", 1))
    return F.when(first == "", "empty").when(first.rlike("^[a-z]{2}$"), first).when(first.rlike("^[0-9]+$"), "digits").when(first.rlike("^[a-z]+$"), "word").otherwise("other")


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    def of(at: Column) -> Column:
        total = F.greatest(F.size(at), F.lit(1)).cast("double")
        share = lambda c: F.size(F.filter(at, lambda x: x == c)) / total
        return F.aggregate(F.array_distinct(at), F.lit(0.0), lambda sum_, c: let2(share(c), sum_))

    let2 = lambda p, sum_: sum_ - p * F.log2(p)
    return let(F.filter(F.split(text, ""), lambda c: c != ""), of)


def lexical(urls: DataFrame) -> DataFrame:
    """urls with the lexical features of `url`, its host's suffix of two labels, and its section."""
    url = F.coalesce("url", F.lit(""))
    at_host, at_path = host(F.col("url")), path(F.col("url"))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    size = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return urls.withColumns({
        "length": F.char_length(url).cast("double"),
        "depth": count(at_path, "/[^/]"),
        "digits": count(url, "[0-9]") / size,
        "entropy": _entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "host_length": F.char_length(at_host).cast("double"),
        "labels": count(at_host, "[.]"),
        "hyphens": count(url, "[-_]"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https")).cast("double"),
        "extension": at_path.rlike(r"\.[A-Za-z0-9]+$").cast("double"),
        "suffix": F.substring_index(at_host, ".", -2),
        "section": section(at_path),
    })


def _key(labelled: DataFrame) -> Column:
    """What tells labelled rows apart."""
    return F.struct(*(c for c in ("url", "page_id") if c in labelled.columns))


def fold_of(labelled: DataFrame) -> Column:
    return F.pmod(F.xxhash64(_key(labelled), F.lit("fold")), F.lit(FOLDS)).cast("int")


#: What shares of blocked URLs are taken by.
SHARES = (("suffix",), ("section",), ("suffix", "section"))


def block_counts(labelled: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(names, labelled, blocked, labelled_by_fold, blocked_by_fold): counts over all rows; those without a label are not blocked."""
    by = {"suffix": F.substring_index(host(F.col("url")), ".", -2), "section": section(path(F.col("url")))}
    rows = labelled.select(*(by[n].alias(n) for n in names), fold_of(labelled).alias("fold"), F.coalesce("blocked", F.lit(0)).cast("long").alias("blocked"))
    by_fold = lambda value: F.array(*(F.sum(F.when(F.col("fold") == k, value).otherwise(F.lit(0))) for k in range(FOLDS)))
    return rows.groupBy(*names).agg(F.count("*").alias("labelled"), F.sum("blocked").alias("blocked"), by_fold(F.lit(1)).alias("labelled_by_fold"), by_fold(F.col("blocked")).alias("blocked_by_fold"))


def with_share(rows: DataFrame, known: DataFrame, names: tuple[str, ...], fold: str | None = None) -> DataFrame:
    """rows with `<names>_block_rate`, the smoothed share of blocked ones among the known rows of their suffix, section or both; with
    `fold`, a column of the rows, among those of other folds."""
    joined = rows.join(known, list(names), "left")
    blocked, labelled = F.coalesce("blocked", F.lit(0)), F.coalesce("labelled", F.lit(0))
    if fold:
        blocked, labelled = (all_ - F.coalesce(F.get(f"{c}_by_fold", fold), F.lit(0)) for all_, c in ((blocked, "blocked"), (labelled, "labelled")))
    return joined.withColumn("_".join((*names, "block_rate")), (blocked + 1.0) / (labelled + 2.0)).drop("labelled", "blocked", "labelled_by_fold", "blocked_by_fold")


def _with_shares(rows: DataFrame, suffixes: DataFrame, known: dict[tuple[str, ...], DataFrame], fold: str | None = None) -> DataFrame:
    out = rows.join(suffixes, "suffix", "left").withColumn("suffix_log_count", F.log1p(F.coalesce("seen", F.lit(0)).cast("double"))).drop("seen")
    for names, counts in known.items():
        # Sections are 680 at most, by their definition.
        out = with_share(out, F.broadcast(counts) if names == ("section",) else counts, names, fold)
    return out


def drawn(labelled: DataFrame, blocked: int, others: int, sample_rows: int) -> DataFrame:
    """labelled's rows for the trees, with their weight: about half of sample_rows of the blocked and as many of the others, so that rare blocked
    URLs are not lost among them; a row weighs as many as it stands for.  Each row of a repeated url is drawn for itself by its page_id."""
    shares = [sample_share(n, sample_rows // 2) for n in (blocked, others)]
    share = F.when(F.coalesce(F.col("blocked") == 1, F.lit(False)), shares[0]).otherwise(shares[1])
    return labelled.withColumn("weight", 1_000_000.0 / share).where(F.pmod(F.xxhash64(_key(labelled), F.lit("sample")), F.lit(1_000_000)) < share)


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each page; score is the trees' for blocking.

    pages has page_id and url, labelled has url, blocked (0, 1, or null for no label) and page_id, by which rows of one url are drawn apart;
    without page_id they are drawn together.  Other columns are ignored.  Shares of blocked URLs count all rows of labelled.  A null url has an
    empty host and path and is judged by the trees.  Without rows that are blocked and others, the trees' verdict is the
    commoner kind, allow if there are none.  Repeated rows each give a row; an empty table none.
    """
    labelled = labelled.select("url", F.col("blocked").cast("int").alias("blocked"), *(c for c in ("page_id",) if c in labelled.columns))
    rows = lexical(pages.select("page_id", "url"))
    suffixes = settle(rows.groupBy("suffix").agg(F.count("*").alias("seen")), "suffixes")
    known = {names: settle(block_counts(labelled, names), "_".join(names)) for names in SHARES}
    sums = known["section",].agg(F.sum("labelled").alias("all"), F.sum("blocked").alias("blocked")).first()
    blocked, total = sums["blocked"] or 0, sums["all"] or 0
    sample = drawn(labelled, blocked, total - blocked, sample_rows).select("url", "weight", "blocked", F.coalesce("blocked", F.lit(0)).alias("label"), fold_of(labelled).alias("fold"))
    ready = settle(_with_shares(lexical(sample.withColumnRenamed("blocked", "told")), suffixes, known, "fold"), "features")
    trees = BoostedTrees(FEATURES, rounds=12).fit(ready, "label", F.col("fold") == 0, "weight")
    found = _found_share(trees, ready)
    page = F.struct("page_id", "url").alias("page")
    scored = trees.score(_with_shares(rows, suffixes, known).select(page, *FEATURES), "page")
    scored = scored.select("page.page_id", F.least(F.lit(1.0), F.col("score") / found).alias("score"), host(F.col("page.url")).alias("host"), path(F.col("page.url")).alias("path"))
    ruled = scored.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def _found_share(trees: BoostedTrees, ready: DataFrame) -> float:
    """Mean score of the held-out blocked rows, where rows without a label trained as not blocked; else 1."""
    if trees.trees is None or ready.where("told is null").isEmpty():
        return 1.0
    held = ready.where("fold = 0 and label = 1").select(F.struct("weight").alias("row"), *FEATURES)
    mean = trees.score(held, "row").agg(F.sum(F.col("score") * F.col("row.weight")) / F.sum("row.weight")).first()[0]
    return max(mean or 1.0, 0.05)


def held_out(labelled: DataFrame, by: Column, fold: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(kind, n, blocked, found, flagged): labelled rows of one fold, judged without rules by what the others teach, counted by the value of `by`,
    a column over page_id, host, path and verdict.  Recall is found by blocked, precision found by flagged.

    labelled has page_id (distinct), url and blocked; rows without a label teach, but aren't counted."""
    of = fold_of(labelled)
    told = labelled.where((of == fold) & F.col("blocked").isNotNull())
    out = judge(told, labelled.where(of != fold), [], sample_rows).join(told.select("page_id", F.col("blocked").alias("truth")), "page_id")
    flagged = F.col("verdict") == "block"
    return out.groupBy(by.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("truth") == 1).alias("blocked"), F.count_if(flagged & (F.col("truth") == 1)).alias("found"), F.count_if(flagged).alias("flagged"))


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, url, blocked) of all pages: weak labels, where no others are at hand.

    blocked is 1 where a rule blocks, 0 where one allows, and null, no label, where none fits."""
    fit = longest_rule(host(F.col("url")), path(F.col("url")), rules)
    return pages.select("page_id", "url", (fit["verdict"] == "block").cast("int").alias("blocked"))
