"""Fusion of pivots and modalities, evidence, confidence, adaptive cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S

ORIGINAL, ALIAS, TRANSLATION = 1, 2, 4


def pivots(rows: DataFrame) -> DataFrame:
    """query_id, pivot, ord, mask: pivots equal but for case and outer blanks are one; the first text stays."""
    key = F.lower(F.trim("pivot"))
    return rows.groupBy("query_id", key.alias("key")).agg(
        F.min_by("pivot", "ord").alias("pivot"), F.min("ord").alias("ord"), F.bit_or("mask").alias("mask")
    ).drop("key")


def pivot_fusion(results: DataFrame, pivot_rows: DataFrame) -> DataFrame:
    """Evidence of each document over the pivots that found it."""
    n = pivot_rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("pivots"))
    fused = results.join(pivot_rows.select("query_id", "ord", "mask"), ["query_id", "ord"]).groupBy("query_id", "doc_id").agg(
        F.max("score").alias("score"), F.max("bm25").alias("bm25"), F.max("coverage").alias("coverage"),
        F.bit_or("mask").alias("mask"), F.count_distinct("ord").alias("support"),
    )
    return fused.join(n, "query_id").withColumn("agreement", F.round(F.col("support") / F.col("pivots"), 6))


def margins(docs: DataFrame) -> DataFrame:
    """query_id, candidates, best, second, margin (0 margin for equal bests, second null for one)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = docs.withColumn("r", F.row_number().over(order))
    out = ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second")
    )
    return out.withColumn("margin", F.round(F.col("best") - F.col("second"), 6))


def image_factor(document: Column, image: Column, matched: Column, strong_prefix: Column) -> Column:
    """By what the query asks for: images' similarities are weighed against documents' scores."""
    return F.when((document & ~image) | strong_prefix, F.when(matched, 12.0).otherwise(1.0)).when(image & ~document, 80.0).otherwise(20.0)


def relative(rows: DataFrame) -> DataFrame:
    """Adds ``rel``: score by the best of its query and modality."""
    best = F.max("score").over(Window.partitionBy("query_id", "modality"))
    return rows.withColumn("rel", F.when(best > 0, F.round(F.col("score") / best, 6)).otherwise(0.0))


def accepted(rows: DataFrame, share: float = 0.65) -> DataFrame:
    """Rows near the best of their modality: within 0.35 of it."""
    return relative(rows).where(F.col("rel") >= share)


def mixed_rank(rows: DataFrame) -> DataFrame:
    """Adds ``rank``: by raw score in one modality, by relative score over several; ties by raw, kind, id."""
    rows = relative(rows) if "rel" not in rows.columns else rows
    w = Window.partitionBy("query_id")
    several = F.min("modality").over(w) != F.max("modality").over(w)
    rows = rows.withColumn("key", F.when(several, F.col("rel")).otherwise(F.col("score")))
    order = w.orderBy(F.desc("key"), "modality", F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).drop("key")


def atomic_conjunction(found: DataFrame, components: DataFrame, keep: int = 20) -> DataFrame:
    """query_id, modality, id, support, agreement, tier: results by how many parts of a query they answer.

    ``found`` has query_id, component, modality, id, score; scores count by the best of their
    component and modality.
    """
    per = found.groupBy("query_id", "component", "modality", "id").agg(F.max("score").alias("score"))
    keys = ["query_id", "component", "modality"]
    best = per.groupBy(*keys).agg(F.max("score").alias("best"))  # a row for each part of the stated queries
    strength = F.when(F.col("best") > 0, F.round(F.col("score") / F.col("best"), 6)).otherwise(0.0)
    per = per.join(F.broadcast(best), keys).withColumn("strength", strength)
    n = components.groupBy("query_id").agg(F.count_distinct("component").alias("components"))
    rows = per.groupBy("query_id", "modality", "id").agg(F.count(F.lit(1)).alias("support"), F.round(F.sum("strength"), 6).alias("strength"))
    rows = rows.join(F.broadcast(n), "query_id")
    rows = rows.withColumn("agreement", F.round(S.agreement(F.col("support"), F.col("components"), F.col("strength")), 6))
    rows = rows.withColumn("tier", F.when(F.col("support") == F.col("components"), "BEST").otherwise("PARTIAL"))
    order = Window.partitionBy("query_id").orderBy(F.desc("agreement"), "modality", "id")
    return rows.withColumn("ord", F.row_number().over(order).cast("long")).where(F.col("ord") <= keep)


def validated_images(rows: DataFrame) -> DataFrame:
    """Rows but the images that answer only a part of a query with several components."""
    partial = (F.upper("modality") == "IMAGE") & ~F.coalesce(F.col("tier") == "BEST", F.lit(False))
    return rows.where(~((F.col("components") > 1) & partial))


def strongest_tier(rows: DataFrame) -> DataFrame:
    """query_id, id, tier: the strongest tier that any pivot gave; RELATED where none did."""
    best = rows.groupBy("query_id", "id").agg(F.max(F.coalesce(tier_rank(F.col("tier")), F.lit(1))).alias("t"))
    return best.select("query_id", "id", F.when(F.col("t") == 3, "BEST").when(F.col("t") == 2, "PARTIAL").otherwise("RELATED").alias("tier"))


TIER_RANK = {"BEST": 3, "PARTIAL": 2, "RELATED": 1}


def tier_rank(tier: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in TIER_RANK.items():
        out = F.when(tier == name, rank).otherwise(out)
    return out


def adaptive_cutoff(rows: DataFrame) -> DataFrame:
    """Adds utility, shown and reason: where a query's ranked results stop being worth showing.

    ``rows`` has query_id, rank, modality, score, confidence, tier, agreement; null signals are
    unavailable. Two results or fewer are all shown; else the first fall in tier of tiered
    images cuts, else a drop in utility beyond median plus median deviation of the drops.
    """
    whole = Window.partitionBy("query_id")
    w = whole.orderBy("rank")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    tier = tier_rank(F.col("tier"))
    signals = (
        (F.when(F.col("score").isNotNull(), F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))), 2.0),
        (F.col("confidence"), 1.0),
        (F.when(tier == 3, 1.0).when(tier == 2, 0.5).when(tier == 1, 0.0), 3.0),
        (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("agreement"))).cast("double"), 2.0),
    )
    signals = tuple((F.when(F.col("agreement").isNotNull(), s) if i == 3 else s, wt) for i, (s, wt) in enumerate(signals))
    value = sum((F.coalesce(s * wt, F.lit(0.0)) for s, wt in signals), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), wt).otherwise(0.0) for s, wt in signals), F.lit(0.0))
    rows = rows.withColumns({"utility": F.round(F.when(weight > 0, value / weight).otherwise(0.0), 6), "t": tier, "n": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumns(
        {
            "drop": F.round(F.lag("utility").over(w) - F.col("utility"), 6),
            "tiered": F.min(((F.col("modality") == "IMAGE") & F.col("t").isNotNull()).cast("int")).over(whole) == 1,
            "lead": F.first("t").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    fall = F.min(F.when((F.col("rank") >= 3) & (F.col("t") < F.col("lead")), F.col("rank"))).over(whole)
    rows = rows.withColumn("fall", F.when(F.col("tiered") & (F.col("lead") > 1), fall))
    rows = rows.withColumn("median", F.median(F.when(F.col("drop") > 0, F.col("drop"))).over(whole))
    rows = rows.withColumn("spread", F.median(F.when(F.col("drop") > 0, F.abs(F.col("drop") - F.col("median")))).over(whole))
    big = F.max(F.when((F.col("rank") >= 3) & (F.col("drop") > 0), F.col("drop"))).over(whole)
    rows = rows.withColumn("big", big)
    elbow = F.min(F.when((F.col("rank") >= 3) & (F.col("drop") == F.col("big")), F.col("rank"))).over(whole)
    rows = rows.withColumn("elbow", F.when(F.col("big") > F.round(F.col("median") + F.col("spread"), 6), elbow))
    cut = F.when(F.col("n") > 2, F.coalesce("fall", "elbow"))
    reason = F.when((F.col("n") > 2) & F.col("fall").isNotNull(), "MATCH_TIER_BOUNDARY").when((F.col("n") > 2) & F.col("elbow").isNotNull(), "DISTRIBUTION_ELBOW")
    rows = rows.withColumns({"shown": F.coalesce(F.col("rank") < cut, F.lit(True)), "reason": F.coalesce(reason, F.lit("ALL_RESULTS_MEANINGFUL"))})
    return rows.drop("t", "n", "drop", "tiered", "lead", "fall", "median", "spread", "big", "elbow")


def document_confidence(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds the normalised signals and the confidence; null means unavailable.

    ``docs`` has bm25, coverage, semantic, canonical (null where not observed), lexical and
    canonical provenance flags, mask of query routes; ``stats`` are the margins.
    """
    rows = docs.join(F.broadcast(stats.select("query_id", "candidates", "second", "margin")), "query_id")
    rows = rows.withColumns(
        {
            "s_bm25": S.saturating(F.col("bm25"), 4.5),
            "s_semantic": S.saturating(F.when(F.col("semantic").isNotNull(), F.greatest("semantic", F.lit(0.0))), 0.25),
            "s_coverage": S.bounded(F.col("coverage")),
            "s_canonical": S.bounded(F.col("canonical")),
            "s_margin": S.margin_signal(F.col("candidates"), F.col("score"), F.col("second"), F.col("margin")),
        }
    )
    agreed = (F.col("bm25").isNotNull() & F.col("canonical").isNotNull()) | (F.bit_count("mask") > 1)
    value = S.confidence(F.col("s_bm25"), F.col("s_semantic"), F.col("s_coverage"), F.col("s_canonical"), F.col("s_margin"), agreed)
    return rows.withColumn("confidence", F.round(value, 6))
