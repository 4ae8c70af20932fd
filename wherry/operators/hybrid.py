"""Search over two classes of candidates: chunks that hold all of a query's words, and chunks that only its canonical terms find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..functions import text as T
from ..functions.barrier import settled
from ..sources.files import internal_artifact
from . import index as I
from . import search as R
from . import stored as D

#: Share of the best canonical document's score from which others of that class stay.
CANONICAL_SHARE = 0.70


def canonical_candidates(queries: DataFrame, index: D.StoredIndex) -> DataFrame:
    """query_id, doc_id, chunk_index, canonical: of the query's hypotheses the best share of terms that a chunk holds.

    ``queries`` has query_id, query and hypotheses (array<string>, such as translations; null or
    empty: the query itself). Every chunk with any term of any hypothesis is a candidate.
    """
    own = F.array("query")
    hypotheses = F.when(F.size(F.coalesce("hypotheses", own)) > 0, F.coalesce("hypotheses", own)).otherwise(own)
    each = queries.select("query_id", F.posexplode(hypotheses).alias("h", "text"))
    each = each.select("query_id", "h", T.canonical_terms(T.canonical_tokens(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    hashes = each.select(F.struct("query_id", "h").alias("query_id"), F.explode("terms").alias("term")).select("query_id", T.hash_of(F.col("term")).alias("hash"))
    found = index.lookup(hashes).select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.h").alias("h"), "doc_id", "chunk_index", "matched")
    found = found.join(each.select("query_id", "h", F.size("terms").alias("n")), ["query_id", "h"])
    share = F.least(F.lit(1.0), F.col("matched") / F.col("n"))
    return found.groupBy("query_id", "doc_id", "chunk_index").agg(F.max(share).alias("canonical"))


def candidates(queries: DataFrame, asked: DataFrame, index: D.StoredIndex, exps: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_index, provenance, canonical: chunks with any of the retrieval words (``exps``: query_id, token), with a canonical term, or both."""
    lexical = index.postings(exps).join(exps, "token").select("query_id", "doc_id", "chunk_index").distinct().withColumn("l", F.lit(True))
    both = lexical.join(canonical_candidates(queries, index), ["query_id", "doc_id", "chunk_index"], "full_outer")
    way = F.when(F.col("l").isNull(), "canonical").when(F.col("canonical").isNull(), "lexical").otherwise("both")
    return both.select("query_id", "doc_id", "chunk_index", way.alias("provenance"), "canonical")


def hybrid_search(queries: DataFrame, index: D.StoredIndex, names: DataFrame | None = None, embedded: DataFrame | None = None, expand: bool = False) -> DataFrame:
    """query_id, rank, doc_id, score, hits, chunk_index, provenance, canonical_only, semantic_available, bm25, coverage, semantic of the accepted documents.

    ``names`` (doc_id, name, path) gives the metadata boost and leaves out files that the
    indexer itself made; ``embedded`` (query_id, embedding) are the queries' vectors, compared
    with those the index has of its chunks.

    A chunk with some retrieval words needs all of the query's, near each other; a chunk with
    none is scored by its canonical coverage alone, without the bonus for words. A document is
    canonical only if no accepted chunk of it has the words; such documents are measured by the
    best of their own. Of each class ten stay: where there are ten or fewer in all this drops
    none, so it needs no condition.
    """
    asked = R.understood(queries.select("query_id", "query"))
    expanded = None
    if expand:
        each = asked.select(F.explode("tokens").alias("token"))
        expanded = I.expansions(each, index.vocabulary(each.where(F.length("token") >= 3)))
        asked = R.with_expansions(asked, expanded)
    else:
        asked = asked.withColumn("exps", F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), F.lit(1.0).alias("weight"))))
    asked = index.written(asked)
    words = asked.select("query_id", F.explode("exps.token").alias("token"))
    found = index.written(candidates(queries, asked, index, words))  # it is read twice
    only = found.where("provenance = 'canonical'")
    lexical = D.signals(asked, index.hits(asked))
    lexical = lexical.join(found.where("provenance <> 'canonical'").select("query_id", "doc_id", "chunk_index", "provenance"), ["query_id", "doc_id", "chunk_index"])
    canonical = _canonical_signals(asked, only, index)
    rows = lexical.select(*_SIGNALS).unionByName(canonical.select(*_SIGNALS))
    rows = _with_semantic(rows, index, embedded)
    if names is not None:
        named = names.where(~F.coalesce(internal_artifact(F.col("name")), F.lit(False))).select("doc_id", S.metadata_boost(F.col("name"), F.col("path")).alias("meta"))
        rows = rows.join(named, "doc_id")
    else:
        rows = rows.withColumn("meta", F.lit(0.0))
    return _ranked(_documents(R.settle_scores(rows)), asked)


_SIGNALS = ("query_id", "doc_id", "chunk_index", "tokens", "bm25", "boost", "coverage", "proximity", "provenance")


def _canonical_signals(asked: DataFrame, only: DataFrame, index: D.StoredIndex) -> DataFrame:
    """Signals of chunks without a retrieval word: words that only start with one still count for boost and proximity."""
    keys = ["query_id", "doc_id", "chunk_index"]
    each = asked.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    wide = index.postings(each, prefix=True).join(each, "token").select(*keys, "word", "places").join(only.select(keys), keys, "left_semi")
    hits = wide.groupBy(*keys).agg(F.collect_set(F.struct("word", "places")).alias("hits"))
    rows = only.join(hits, keys, "left").join(asked.select("query_id", "tokens", "exps"), "query_id")
    rows = settled(rows, hits=F.coalesce("hits", F.array().cast("array<struct<word:string,places:array<int>>>")))
    held = F.filter("exps", lambda e: (e["weight"] > 0) & F.exists("hits", lambda h: h["word"].startswith(e["token"])))
    first = F.filter(F.transform(F.array_distinct("tokens"), lambda t: F.get(D.places_in(F.col("hits"), t), 0)), lambda p: p.isNotNull())
    return settled(
        rows, bm25=F.lit(0.0), boost=S.total(F.transform(held, lambda e: e["weight"] * 0.80)), coverage=F.col("canonical").cast("double"), proximity=S.proximity_of(F.col("tokens"), first)
    )


def _with_semantic(rows: DataFrame, index: D.StoredIndex, embedded: DataFrame | None) -> DataFrame:
    """Adds the similarity of query and chunk; null where either has no vector."""
    if embedded is None:
        return rows.withColumn("semantic", F.lit(None).cast("double"))
    vectors = index.vectors().select("doc_id", "chunk_index", F.col("embedding").alias("cv"))
    rows = rows.join(vectors, ["doc_id", "chunk_index"], "left").join(embedded.select("query_id", F.col("embedding").alias("qv")), "query_id", "left")
    return settled(rows, semantic=F.when(F.col("cv").isNotNull() & F.col("qv").isNotNull(), F.round(S.cosine(F.col("qv"), F.col("cv")), 6))).drop("cv", "qv")


def _documents(scored: DataFrame) -> DataFrame:
    best = F.struct((-F.col("score")).alias("s"), F.col("chunk_index"))
    rolled = scored.groupBy("query_id", "doc_id").agg(
        F.max("score").alias("best"), F.count(F.lit(1)).alias("hits"), F.min_by(F.struct("chunk_index", "provenance", "bm25", "coverage", "semantic"), best).alias("b"),
        F.bool_and(F.col("provenance") == "canonical").alias("canonical_only"), F.bool_or(F.col("semantic").isNotNull()).alias("semantic_available"),
    )
    score = F.round(F.col("best") + 0.5 * F.least("hits", F.lit(5)), 6).alias("score")
    return rolled.select("query_id", "doc_id", score, "hits", "canonical_only", "semantic_available", "b.*")


def _ranked(docs: DataFrame, asked: DataFrame, per_class: int = R.PER_CLASS) -> DataFrame:
    whole = Window.partitionBy("query_id", "canonical_only")
    rows = docs.withColumn("r", F.row_number().over(whole.orderBy(F.desc("score"), "doc_id"))).where(F.col("r") <= per_class)
    rows = rows.withColumn("top", F.max("score").over(whole)).join(asked.select("query_id", R.relative_share().alias("share")), "query_id")
    share = F.when(F.col("canonical_only"), CANONICAL_SHARE).otherwise(F.col("share"))
    rows = rows.where((F.col("top") > 0) & (F.col("score") >= F.round(F.col("top") * share, 6)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")  # twenty rows at most
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).select(
        "query_id", "rank", "doc_id", "score", "hits", F.col("chunk_index").cast("long").alias("chunk_index"), "provenance", "canonical_only", "semantic_available",
        F.round("bm25", 6).alias("bm25"), F.round("coverage", 6).alias("coverage"), "semantic",
    )
