"""Explanations of whole searches: projection of what was observed, what is wrong with it, and a few sentences in two languages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an explanation does not say.
LIMITATIONS = ("SELECTION_EVIDENCE_ONLY", "RESULT_CONTENT_NOT_VERIFIED", "CONFIDENCE_NOT_FACTUAL_PROBABILITY", "MISSING_EVIDENCE_NOT_NEGATIVE_EVIDENCE")

#: The sentences, English and Romanian; of pairs the first is for one, the second, with its number, for other counts.
SENTENCES = {
    "en": {
        "asked": ("You searched for “", "”."), "asked nothing": "You searched your files.",
        "found": (" Found ", " result.", " results."),
        "tiers": (" Among the images, ", ", ", ", and ", "."),
        "best": ("1 is a complete match", " are complete matches"), "partial": ("1 is a partial match", " are partial matches"), "related": ("1 is a related match", " are related matches"),
        "all": " All displayed images cover the whole search.",
        "some": " Complete matches cover the whole search; the others match only part of it.",
        "parts": " No displayed image covers the whole search; partial matches cover only part of it.",
        "no tiers": " These results are shown because they are the closest available matches.",
    },
    "ro": {
        "asked": ("Ai căutat „", "”."), "asked nothing": "Ai căutat în fișierele tale.",
        "found": (" Am găsit ", " rezultat.", " rezultate."),
        "tiers": (" Dintre imagini, ", ", ", ", iar ", "."),
        "best": ("1 este o potrivire completă", " sunt potriviri complete"), "partial": ("1 este o potrivire parțială", " sunt potriviri parțiale"), "related": ("1 este un rezultat asociat", " sunt rezultate asociate"),
        "all": " Toate imaginile afișate acoperă întreaga căutare.",
        "some": " Potrivirile complete acoperă întreaga căutare; celelalte corespund doar unei părți.",
        "parts": " Nicio imagine afișată nu acoperă întreaga căutare; potrivirile parțiale corespund doar unei părți.",
        "no tiers": " Aceste rezultate sunt afișate deoarece sunt cele mai apropiate potriviri disponibile.",
    },
}


def tier_counts(results: DataFrame) -> DataFrame:
    """query_id, results, best, partial, related: how many results a query has, and of its images how many of each tier (null tiers count among results only)."""
    image = F.upper("modality") == "IMAGE"
    n = lambda t: F.count_if(image & (F.col("tier") == t))
    return results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), n("BEST").alias("best"), n("PARTIAL").alias("partial"), n("RELATED").alias("related"))


def compact(counts: DataFrame, language: str = "en") -> DataFrame:
    """query_id, text: what was asked, how much was found, and how far the images answer it.

    ``counts`` has query_id, query (null or blank where it is not known), results, best, partial
    and related. Tiers are told only where an image is a complete or partial match.
    """
    s = SENTENCES[language]
    some = lambda name, c: F.when(F.col(c) == 1, s[name][0]).otherwise(F.concat(F.col(c).cast("string"), F.lit(s[name][1])))
    asked = F.when(F.trim(F.coalesce("query", F.lit(""))) != "", F.concat(F.lit(s["asked"][0]), "query", F.lit(s["asked"][1]))).otherwise(s["asked nothing"])
    found = F.concat(F.lit(s["found"][0]), F.col("results").cast("string"), F.when(F.col("results") == 1, s["found"][1]).otherwise(s["found"][2]))
    start, between, last, end = map(F.lit, s["tiers"])
    tiers = F.concat(start, some("best", "best"), between, some("partial", "partial"), last, some("related", "related"), end)
    meaning = F.when(F.col("best") == 0, s["parts"]).when(F.col("partial") + F.col("related") == 0, s["all"]).otherwise(s["some"])
    rest = F.when(F.col("best") + F.col("partial") > 0, F.concat(tiers, meaning)).otherwise(s["no tiers"])
    return counts.select("query_id", F.concat(asked, found, rest).alias("text"))


def issues(results: DataFrame, supplied: dict[str, DataFrame]) -> DataFrame:
    """query_id, doc_id, issue: what keeps results from being explained.

    A result must have an id, once in its search; what is ``supplied`` by name (query_id, doc_id
    and anything else) must be about a result.
    """
    keys = ["query_id", "doc_id"]
    found = [
        results.where("doc_id IS NULL").select(*keys).distinct().withColumn("issue", F.lit("resultId")),
        results.where("doc_id IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("duplicate resultId").alias("issue")),
    ]
    known = results.select(*keys).distinct()
    for name, rows in supplied.items():
        found.append(rows.select(*keys).distinct().join(known, keys, "left_anti").withColumn("issue", F.lit(f"{name} contains unknown resultId")))
    return reduce(DataFrame.unionByName, found)


def projected(results: DataFrame, supplied: dict[str, DataFrame], version: str) -> DataFrame:
    """explanation_id, query_id, state, results, evidence, missing, limitations: an explanation of every search.

    ``results`` has query_id, execution_id, doc_id, rank, complete and, by name, the columns that
    ``supplied`` may have better ones of (query_id, doc_id, and a column of that name): what is
    supplied for a result counts, even a null. A search with an issue is not explained: its state
    is INVALID and it has no results.
    """
    keys = ["query_id", "doc_id"]
    bad = issues(results, supplied).select("query_id").distinct().withColumn("bad", F.lit(True))
    rows = results
    for name, better in supplied.items():
        one = better.select(*keys, F.col(name).alias("__new"), F.lit(True).alias("__given"))
        rows = rows.join(one, keys, "left").withColumn(name, F.when(F.col("__given"), F.col("__new")).otherwise(F.col(name))).drop("__new", "__given")
    names = list(supplied)
    seen = lambda c: F.count_if(c)
    some: Column = reduce(lambda a, b: a + b, (F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    per = rows.groupBy("query_id").agg(
        F.first("execution_id").alias("execution_id"), F.count(F.lit(1)).alias("results"), F.sum(some).cast("long").alias("evidence"),
        (F.count(F.lit(1)) * len(names) - F.sum(some)).cast("long").alias("missing"), seen(~F.coalesce("complete", F.lit(False))).alias("open"),
    )
    per = per.join(bad, "query_id", "left")
    state = F.when(F.col("bad"), "INVALID").when(F.col("open") == 0, "AVAILABLE").otherwise("PARTIAL")
    held = lambda c: F.when(F.col("bad"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    return per.select(
        F.concat("execution_id", F.lit(f":explanation:{version}")).alias("explanation_id"), "query_id", state.alias("state"), held("results"), held("evidence"), held("missing"),
        F.lit(",".join(LIMITATIONS)).alias("limitations"),
    )
