"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

Features are densities of a lexicon of insults, of words and of word beginnings that the labelled
sample shows to be toxic, their nearness to a second person, and rates of capitals, punctuation and
obfuscated words.  The sample's size is a parameter; every document is scored from its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.functions.text import let
from scholarframe.llm.trees import BoostedTrees, sample_share, sampled
from scholarframe.plans.tables import settle

#: General insults in English; the labelled sample adds what other languages use.
LEXICON = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "jerk", "fool", "imbecile", "filthy", "vermin")
SECOND_PERSON = ("you", "your", "yours", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "tu", "toi", "te", "ton", "ta", "vous", "votre", "usted", "ustedes", "tus", "su")
#: Rows of the labelled sample, in expectation.
SAMPLE_ROWS = 12_000
#: Words before and after a hit in which a second person is near.
NEAR = 3
FEATURES = ["log_words", "seed", "seed_rate", "learned", "learned_rate", "starts", "starts_rate", "all_hits", "near_you", "near_rate", "capitals", "marks", "shouts", "obfuscated"]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _hit(word: Column, terms: set[str]) -> Column:
    return word.isin(*sorted(terms)) if terms else F.lit(False)


def features(docs: DataFrame, learned: set[str], starts: set[str]) -> DataFrame:
    """(row, FEATURES) for each document: row is the whole row of docs; a null text counts as an empty one."""
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    known = set(LEXICON)
    begins = lambda w: _hit(F.substring(w, 1, 4), {s for s in starts if len(s) == 4}) | _hit(F.substring(w, 1, 5), {s for s in starts if len(s) == 5})
    any_hit = lambda w: _hit(w, known | learned) | begins(w)

    def counted(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: any_hit(x["w"]))

        def of(found: Column) -> Column:
            many = lambda test: F.size(F.filter(found, test)).cast("double")
            begin = lambda x: F.greatest(x["i"] - NEAR, F.lit(0))
            near = lambda x: F.arrays_overlap(F.slice(words, begin(x) + 1, x["i"] + NEAR + 1 - begin(x)), F.array(*map(F.lit, SECOND_PERSON)))
            return F.struct(F.size(words).cast("double").alias("n"), F.size(found).cast("double").alias("all_hits"), many(lambda x: _hit(x["w"], known)).alias("seed"), many(lambda x: _hit(x["w"], learned)).alias("learned"), many(lambda x: begins(x["w"])).alias("starts"), many(near).alias("near_you"))

        return let(hits, of)

    out = docs.withColumn("x", let(_words(text), counted))
    n = F.greatest(F.col("x.n"), F.lit(1.0))
    chars = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    without = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    return out.withColumns({
        "log_words": F.log1p("x.n"),
        **{c: F.col(f"x.{c}") for c in ("seed", "learned", "starts", "all_hits", "near_you")},
        "seed_rate": F.col("x.seed") / n,
        "learned_rate": F.col("x.learned") / n,
        "starts_rate": F.col("x.starts") / n,
        "near_rate": F.col("x.near_you") / n,
        "capitals": without(r"\p{Lu}+") / chars,
        "marks": without(r"[^\p{L}\p{N}\s]+") / chars,
        "shouts": without("[!?]+") / chars,
        "obfuscated": F.regexp_count(text, F.lit(r"\p{L}[0-9@$*!|]+\p{L}")).cast("double") / n,
    }).select("row", *FEATURES)


def _learn_terms(sample: DataFrame) -> tuple[set[str], set[str]]:
    """Words, and beginnings of four or five letters, that toxic rows of the sample hold far more often than others.

    Equal texts count once, as toxic if any of them is.  How many terms there are is bounded by the sample alone: each
    stands in three toxic texts at least, and in one of 250."""
    words = F.array_distinct(_words(F.coalesce("text", F.lit(""))))
    long = F.filter(words, lambda w: F.char_length(w) >= 5)
    starts = F.array_union(F.transform(long, lambda w: F.concat(F.substring(w, 1, 4), F.lit("*"))), F.transform(long, lambda w: F.concat(F.substring(w, 1, 5), F.lit("*"))))
    texts = sample.groupBy("text").agg(F.max(F.col("toxic").cast("long")).alias("t"))
    rows = texts.select("t", F.explode(F.concat(words, F.array_distinct(starts))).alias("term"))
    total = texts.agg(F.sum("t").alias("t"), F.count("*").alias("n")).first()
    bad, good = (total.t or 0), (total.n or 0) - (total.t or 0)
    odds = ((F.col("t") + 0.5) / (bad + 1.0)) / ((F.col("n") - F.col("t") + 0.5) / (good + 1.0))
    terms = rows.groupBy("term").agg(F.sum("t").alias("t"), F.count("*").alias("n")).where((F.col("t") >= max(3, bad // 250)) & (odds >= 25))
    found = [r.term for r in terms.select("term").collect()]
    return {x for x in found if x[-1] != "*"}, {x[:-1] for x in found if x[-1] == "*"}


class ToxicityModel:
    def __init__(self, trees: BoostedTrees, learned: set[str], starts: set[str]):
        self.trees, self.learned, self.starts = trees, learned, starts

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with score, in place of a column of that name; its other columns are kept, whatever their names."""
        scored = self.trees.score(features(docs, self.learned, self.starts), "row")
        return scored.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "score"), "score")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learns from about `sample_rows` labelled rows outside the held-out third.

    docs has doc_id and text, labels doc_id and toxic; other columns are ignored.  Rows without a label or an id
    are not learned from; of several labels of an id the toxic one counts.  The sample's ids have a known bound, so they are
    broadcast to the texts.
    """
    able = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    share = sample_share(able.count(), sample_rows)
    chosen = able.where(sampled(F.col("doc_id"), share)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")
    # The trees see each half with the terms of the other one, so that terms met by chance don't count.
    halves = [sample.where(F.pmod(F.xxhash64("text"), F.lit(2)) == k) for k in (0, 1)]
    crossed = [features(halves[k], *_learn_terms(halves[1 - k])) for k in (0, 1)]
    ready = settle(crossed[0].union(crossed[1]).select("row.doc_id", "row.toxic", *FEATURES), "features")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0
    return ToxicityModel(BoostedTrees(FEATURES).fit(ready, "toxic", fold), *_learn_terms(sample))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document; repeated rows each have one, a null id is never held out.

    Other columns are ignored.  A null or empty text is scored as a text without words; an empty table gives no rows,
    and without labels every score is 0."""
    scored = fit(docs, labels, sample_rows).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
