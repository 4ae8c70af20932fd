"""Interpretations of queries, run under a budget: what several of them ask is asked once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..streaming.feeds import work_dir
from . import graph as G
from . import search as R
from . import stored as D
from .scored import document_scores, rounded

#: The most interpretations, components, executions and results that any budget may allow.
MOST = (8, 12, 8, 10)


@dataclass(frozen=True)
class Budget:
    """Limits of one evaluation, between none and the hard ones."""

    interpretations: int = MOST[0]
    components: int = MOST[1]
    executions: int = MOST[2]
    results: int = MOST[3]

    def __post_init__(self) -> None:
        for name, most in zip(("interpretations", "components", "executions", "results"), MOST, strict=True):
            object.__setattr__(self, name, max(0, min(getattr(self, name), most)))


class Strategy(Protocol):
    """How an interpretation is answered. Interpretations with one key are answered alike, whatever query they belong to."""

    def key(self, query: Column, parts: Column) -> Column:
        """The key of an execution, from the query's text and the components (array<string>)."""

    def execute(self, requests: DataFrame, budget: Budget) -> DataFrame:
        """(key, modality, id, score) of all ``requests`` (key, query, parts) at once."""


class WholeQuery:
    """The query as it stands: documents of the search and, given their scores, images; the components are not looked at."""

    def __init__(self, index: D.StoredIndex, images: DataFrame | None = None) -> None:
        self.index, self.images = index, images

    def key(self, query: Column, parts: Column) -> Column:
        return F.concat(F.lit("whole\0"), query)

    def execute(self, requests: DataFrame, budget: Budget) -> DataFrame:
        found = D.search(requests.select(F.col("key").alias("query_id"), "query"), self.index)
        out = found.select(F.col("query_id").alias("key"), F.lit("DOCUMENT").alias("modality"), F.col("doc_id").alias("id"), "score")
        if self.images is None:
            return out
        pictures = self.images.join(requests.select("key", "query"), "query").select("key", F.lit("IMAGE").alias("modality"), "id", "score")
        return out.unionByName(pictures)


class AtomicConjunction:
    """Each component by itself; results by how many components they answer.

    Components ask so many of the words there are that the documents are read, where each meets
    all components at once: their postings would bring most words together again.
    """

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs

    def key(self, query: Column, parts: Column) -> Column:
        return F.concat(F.lit("atomic\0"), F.array_join(F.array_sort(F.array_distinct(parts)), "\0"))

    def execute(self, requests: DataFrame, budget: Budget) -> DataFrame:
        each = _written(requests.select("key", F.explode(F.array_distinct("parts")).alias("component")), "asked")
        named = _written(each.select("component").distinct().select(F.monotonically_increasing_id().alias("query_id"), "component"), "asked")
        docs = _written(document_scores(R.understood(named.withColumnRenamed("component", "query")), self.docs), "scored")
        tops = docs.select(F.inline("found")).groupBy("query_id").agg(F.max("score").alias("top"))  # a row for each component
        wanted = each.join(named, "component").join(tops, "query_id", "left").groupBy("key").agg(F.collect_list(F.struct("query_id", "top")).alias("parts")).collect()
        kept = _conjunctions(docs, [(r["key"], [tuple(p) for p in r["parts"]]) for r in wanted], budget.results)
        agreement = F.round(S.agreement(F.col("support"), F.col("components"), F.col("strength")), 6)
        order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
        tiers = kept.withColumn("score", agreement).withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= budget.results)
        return tiers.select("key", F.lit("DOCUMENT").alias("modality"), "id", "score")


def _written(rows: DataFrame, name: str) -> DataFrame:
    """Rows as a table, which later steps read in place of making it again."""
    path = work_dir(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Documents that meet the keys at a time, and a component's share of a sum, above the strengths in millionths.
DOCUMENTS, ONE = 128, 1 << 40


def _conjunctions(docs: DataFrame, wanted: list[tuple[str, list[tuple[int, float | None]]]], keep: int) -> DataFrame:
    """key, id, support, components, strength: of each key's documents each task's first ``keep`` by agreement (ties by id).

    ``docs`` has doc_id and found (component's query_id, score), ``wanted`` the stated keys with
    their components' ids and best scores. A batch of documents is a matrix, so that keys and
    documents that meet do not become rows; a task remembers how good a key's last kept document is.
    """
    ids = np.array(sorted({q for _, parts in wanted for q, _ in parts}), np.int64)
    place = {q: i for i, q in enumerate(ids.tolist())}
    tops = np.zeros(len(ids))
    for _, parts in wanted:
        for q, top in parts:
            tops[place[q]] = top or 0.0
    flat = np.array([place[q] for _, parts in wanted for q, _ in parts], np.int64)
    size = np.array([len(parts) for _, parts in wanted], np.int64)
    starts = np.cumsum(size) - size
    names = pa.array([k for k, _ in wanted], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut, n = [], np.full(len(wanted), -np.inf), 0
        for b in batches:
            for at in range(0, b.num_rows if wanted and keep else 0, DOCUMENTS):
                held.append(near(b.slice(at, DOCUMENTS), cut))
                n += held[-1].num_rows
                if n > 4 * keep * len(wanted):
                    held = [best(pa.concat_tables(held), cut)]
                    n = held[0].num_rows
        if held:
            out = best(pa.concat_tables(held), cut)
            out = out.set_column(0, "key", names.take(out["key"])).drop_columns("agreed")
            yield from out.combine_chunks().to_batches()

    def near(b: pa.RecordBatch, cut: np.ndarray) -> pa.Table:
        """Documents that are not worse than the last that is kept of a key."""
        found = b.column("found")
        flat_found = found.flatten()
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(found).to_numpy(zero_copy_only=False))
        col = np.searchsorted(ids, flat_found.field("query_id").to_numpy(zero_copy_only=False))
        score = flat_found.field("score").to_numpy(zero_copy_only=False)
        top = tops[col]
        sums = np.zeros((len(ids), b.num_rows), np.int64)
        sums[col, row] = ONE + np.rint(rounded(np.divide(score, top, out=np.zeros(len(score)), where=top > 0)) * 1e6).astype(np.int64)  # sums of whole millionths are exact
        sums = np.add.reduceat(sums[flat], starts, axis=0)
        k, at = np.nonzero(sums)
        support, strength = np.divmod(sums[k, at], ONE)
        strength = strength / 1e6
        agreed = (support + np.clip(strength / support, 0.0, 1.0)) / (size[k] + 1)
        some = agreed >= cut[k] - 1e-6
        k, at, support, strength, agreed = k[some], at[some], support[some], strength[some], rounded(agreed[some])
        return pa.table([pa.array(k), b.column("doc_id").take(pa.array(at)), pa.array(support), pa.array(size[k]), pa.array(strength), pa.array(agreed)], names=["key", "id", "support", "components", "strength", "agreed"])

    def best(rows: pa.Table, cut: np.ndarray) -> pa.Table:
        """The first rows of each key; ``cut`` is raised to the last of them where there are enough."""
        rows = rows.take(pc.sort_indices(rows, [("key", "ascending"), ("agreed", "descending"), ("id", "ascending")]))
        key = rows["key"].to_numpy()
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        last = np.flatnonzero(rank == keep - 1)
        cut[key[last]] = rows["agreed"].to_numpy()[last]
        return rows.filter(pa.array(rank < keep))

    kind = docs.schema["doc_id"].dataType
    fields = [StructField("key", StringType()), StructField("id", kind), StructField("support", LongType()), StructField("components", LongType()), StructField("strength", DoubleType())]
    return docs.mapInArrow(run, StructType(fields))


def evaluated(interpretations: DataFrame, strategy: Strategy, budget: Budget = Budget()) -> tuple[DataFrame, DataFrame]:  # noqa: B008  a budget is a value
    """((query_id, ord, kind, key, reused, best_score, documents, images), (key, modality, id, score, rank)).

    ``interpretations`` has query_id, query, ord, kind and parts (array<string>). Of each query
    the first ones count, as many as the budget has; those with too many components are passed
    over; the first that would need one execution too many ends the query's evaluation. Every
    distinct key is executed once, for all queries together, and its observation serves all its
    interpretations; ``reused`` are those of a query after the first with their key. Of each
    modality as many results as the budget has are kept, the best first; counts and the best
    score are of all that were found.
    """
    rows = interpretations.where((F.col("ord") < budget.interpretations) & (F.size("parts") <= budget.components))
    rows = rows.withColumn("key", strategy.key(F.col("query"), F.col("parts")))
    whole = Window.partitionBy("query_id").orderBy("ord")  # a query's few interpretations
    rows = rows.withColumn("reused", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("ord")) > 1)
    rows = rows.withColumn("n", F.count_if(~F.col("reused")).over(whole)).where(F.col("n") <= budget.executions).drop("n")
    requests = rows.groupBy("key").agg(F.first("query").alias("query"), F.first("parts").alias("parts"))
    found = strategy.execute(requests, budget)
    seen = found.groupBy("key").agg(
        F.max("score").alias("best_score"), F.count_if(F.col("modality") == "DOCUMENT").alias("documents"), F.count_if(F.col("modality") == "IMAGE").alias("images")
    )
    none = F.lit(0).cast("long")
    out = rows.join(seen, "key", "left").select(
        "query_id", "ord", "kind", "key", "reused", F.coalesce("best_score", F.lit(0.0)).alias("best_score"), F.coalesce("documents", none).alias("documents"), F.coalesce("images", none).alias("images")
    )
    order = Window.partitionBy("key", "modality").orderBy(F.desc("score"), "id")
    kept = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= budget.results)
    return out, kept


def strongest(evaluations: DataFrame) -> DataFrame:
    """Of each query the evaluation with the best score, then the most results, then the first."""
    results = F.col("documents") + F.col("images")
    order = F.struct((-F.col("best_score")).alias("s"), (-results).alias("n"), F.col("ord"))
    rest = [c for c in evaluations.columns if c != "query_id"]
    return evaluations.groupBy("query_id").agg(F.min_by(F.struct(*rest), order).alias("b")).select("query_id", "b.*")


def aligned(pivots: DataFrame, limit: int = MOST[0]) -> DataFrame:
    """query_id, pivot_ord, pivot, parts: of each query's first ``limit`` approved pivots (query_id, ord, pivot) the words that must all be met.

    Blank pivots are passed over but count; a pivot without words has no alignment.
    """
    rows = pivots.where((F.col("ord") < limit) & (F.trim(F.coalesce("pivot", F.lit(""))) != ""))
    made = G.interpretations(rows.select(F.struct("query_id", "ord").alias("query_id"), F.col("pivot").alias("query")))
    atomic = made.where("kind = 'ATOMIC_CONJUNCTION'").select("query_id.query_id", F.col("query_id.ord").alias("pivot_ord"), F.split("parts", r" \+ ").alias("parts"))
    return atomic.join(rows.select("query_id", F.col("ord").alias("pivot_ord"), "pivot"), ["query_id", "pivot_ord"]).select("query_id", "pivot_ord", "pivot", "parts")
