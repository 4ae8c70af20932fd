"""Explanations, reports and metrics of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Field, category and column of each piece of evidence.
EVIDENCE = (
    ("bm25", "LEXICAL", "bm25"), ("semantic", "SEMANTIC", "semantic"), ("coverage", "COVERAGE", "coverage"),
    ("canonicalCoverage", "CANONICAL_COVERAGE", "canonical"), ("scoreMargin", "SCORE_MARGIN", "margin"),
)


def evidence(results: DataFrame) -> DataFrame:
    """query_id, doc_id, evidence_id, category, field, available, raw: a row for each signal of a result."""
    made = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("category"), F.col(x).cast("double").alias("raw")) for f, c, x in EVIDENCE])
    rows = results.select("query_id", "doc_id", F.explode(made).alias("e"))
    return rows.select(
        "query_id", "doc_id", F.concat_ws(":", "query_id", "doc_id", "e.field").alias("evidence_id"), "e.category", "e.field",
        F.col("e.raw").isNotNull().alias("available"), F.round("e.raw", 6).alias("raw"),
    )


def missing(results: DataFrame) -> DataFrame:
    """query_id, doc_id, reason, state: what could not be observed of a result."""
    item = lambda cond, reason: F.when(cond, F.struct(F.lit(reason).alias("reason"), F.lit("UNAVAILABLE").alias("state")))
    made = F.array(
        item(F.lit(True), "AGREEMENT_NOT_PUBLISHED_TO_RESULTS_VIEW"),
        item(F.col("confidence").isNull(), "CONFIDENCE_NOT_AVAILABLE"),
        item(F.col("semantic").isNull(), "SEMANTIC_NOT_AVAILABLE"),
        item(F.col("canonical").isNull(), "CANONICAL_NOT_AVAILABLE"),
    )
    rows = results.select("query_id", "doc_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("m"))
    return rows.select("query_id", "doc_id", "m.reason", "m.state")


def availability(evidence_rows: DataFrame) -> DataFrame:
    """query_id, doc_id, state: whether all, some or none of a result's signals are available."""
    some, all_ = F.bool_or("available"), F.bool_and("available")
    return evidence_rows.groupBy("query_id", "doc_id").agg(F.when(all_, "AVAILABLE").when(some, "PARTIAL").otherwise("UNAVAILABLE").alias("state"))


def header(results: DataFrame) -> DataFrame:
    """One row: how many results there are, and of each kind (kind is null or empty for documents without one)."""
    kind = F.upper(F.trim(F.coalesce("kind", F.lit(""))))
    n = lambda k: F.count_if(kind == k)
    return results.agg(
        F.count(F.lit(1)).alias("results"), n("IMAGE").alias("images"), n("EMAIL").alias("emails"), n("PDF").alias("pdfs"),
        F.count_if(~kind.isin("IMAGE", "EMAIL", "PDF")).alias("documents"),
    )


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median and 95th percentile (interpolated) of each group."""
    p = lambda q: F.round(F.percentile(value, q), 6)
    return rows.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"))


def sentences(results: DataFrame) -> DataFrame:
    passages = F.concat(F.col("hits").cast("string"), F.when(F.col("hits") == 1, " passage").otherwise(" passages"))
    line = F.concat(F.lit("Rank "), F.col("rank").cast("string"), F.lit(": "), passages, F.lit(", best BM25 "), F.format_string("%.6f", "bm25"))
    return results.select("query_id", "doc_id", line.alias("line"))


def report(results: DataFrame) -> DataFrame:
    """query_id, metric, value: the report's lines, six decimals each."""
    per = results.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("double").alias("documents"), F.max("score").alias("best_score"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.sum("hits").cast("double").alias("passages"),
    )
    long = per.unpivot("query_id", ["documents", "best_score", "mean_score", "passages"], "metric", "v")
    return long.select("query_id", "metric", F.format_string("%.6f", "v").alias("value"))


def execution_ids(results: DataFrame) -> DataFrame:
    """query_id, execution_id: a digest of the result ids in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id"))))
    rows = results.groupBy("query_id").agg(ordered.alias("r"))  # as many as a top-k report has
    return rows.select("query_id", F.md5(F.array_join("r.id", ",")).alias("execution_id"))


def retrieval_metrics(first: DataFrame, group: str) -> DataFrame:
    """Recall at 1, 5 and 10 and mean reciprocal rank; ``first`` has the rank of a query's first relevant result."""
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    return first.groupBy(group).agg(F.count(F.lit(1)).alias("queries"), hit(1), hit(5), hit(10), mrr)


def distribution(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: count, least, largest, range, mean, deviation and Pearson correlation."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(x), 4).alias("lo"), F.round(F.max(x), 4).alias("hi"), F.round(F.max(x) - F.min(x), 4).alias("range"),
        F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("std"), F.round(F.corr(x, y), 6).alias("pearson"),
    )
