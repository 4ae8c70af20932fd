"""Interpretations evaluated under a budget, alignment of pivots, correlation of ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import ranks as N
from . import base as B
from .base import query, table
from .search_queries import _SCORE
from .stored_queries import stored_index
from .text_queries import _SPAN_TOKENS, _WORDS, _interpretations_sql


def _interpreted(spark, d):
    """query_id, query, ord, kind, parts of the benchmark's items; the query is what the interpretations are made of."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    words = items.select("query_id", T.normalized(F.array_join(T.structural_tokens(F.col("query")), " ")).alias("query"))
    made = G.interpretations(items).withColumn("parts", F.split("parts", r" \+ "))
    return made.join(words, "query_id")


_INTER = f"inter AS ({_interpretations_sql()})"
#: Documents of every asked text, found through the words it shares with chunks.
_FOUND = f"""
tokens_of AS (SELECT DISTINCT query_id, unnest(tokens) AS token FROM asked), n_of AS (SELECT query_id, count(*) AS n FROM tokens_of GROUP BY query_id),
held AS (SELECT DISTINCT doc_id, chunk_index, unnest(words) AS token FROM w WHERE TRUE),
full_ AS (SELECT query_id, doc_id, chunk_index FROM held JOIN tokens_of USING (token) JOIN n_of USING (query_id) GROUP BY query_id, doc_id, chunk_index HAVING count(*) = any_value(n)),
cand AS (SELECT a.query_id, a.tokens, w.doc_id, w.chunk_index, w.words FROM full_ f JOIN w USING (doc_id, chunk_index) JOIN asked a ON a.query_id = f.query_id WHERE {B.in_window("tokens", "words")}),
signals AS (SELECT *, 0.8 * len(list_distinct(tokens)) AS boost, {B.bm25("tokens", "words")} AS bm25, {B.proximity("tokens", "words")} AS prox FROM cand), {_SCORE}
"""


@query(f"""
WITH {_WORDS}, {_SPAN_TOKENS}, {_INTER},
asked AS (SELECT query_id, {B.tokens(B.norm("array_to_string(k, ' ')"))} AS tokens FROM b WHERE len({B.tokens(B.norm("array_to_string(k, ' ')"))}) > 0), {_FOUND}
SELECT i.query_id, i.ord, i.kind, i.ord > 0 AS reused, coalesce(best, 0.0) AS best_score, coalesce(n, 0) AS documents
FROM inter i LEFT JOIN (SELECT query_id, max(score) AS best, count(*) AS n FROM result GROUP BY query_id) r ON i.query_id = r.query_id
""")
def evaluate_whole_queries(spark, d):
    """Every interpretation of every item by the whole-query strategy: one search of all items serves them all."""
    out, _ = E.evaluated(_interpreted(spark, d), E.WholeQuery(stored_index(spark, d)))
    return out.select("query_id", "ord", "kind", "reused", "best_score", "documents")


_ATOMIC_PARTS = f"""
{_WORDS}, {_INTER},
each AS (SELECT DISTINCT query_id, ord, unnest(string_split(parts, ' + ')) AS component FROM inter),
asked AS (SELECT DISTINCT component AS query_id, {B.tokens(B.norm("component"))} AS tokens FROM each WHERE len({B.tokens(B.norm("component"))}) > 0), {_FOUND},
hit AS (SELECT e.query_id, ord, component, doc_id, score FROM each e JOIN rolled r ON r.query_id = component),
st AS (SELECT *, round(score / max(score) OVER (PARTITION BY query_id, ord, component), 6) AS strength FROM hit),
size_ AS (SELECT query_id, ord, count(*) AS components FROM each GROUP BY query_id, ord),
agg AS (SELECT query_id, ord, doc_id, count(*) AS support, round(sum(strength), 6) AS strength FROM st GROUP BY query_id, ord, doc_id),
agr AS (SELECT *, round((support + least(1.0, greatest(0.0, strength / support))) / (components + 1), 6) AS agreement FROM agg JOIN size_ USING (query_id, ord)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ord ORDER BY agreement DESC, doc_id) AS r FROM agr) WHERE r <= 10),
evaluated AS (
  SELECT i.query_id, i.ord, i.kind, row_number() OVER (PARTITION BY i.query_id, list_sort(list_distinct(string_split(parts, ' + '))) ORDER BY i.ord) > 1 AS reused,
    coalesce(best, 0.0) AS best_score, coalesce(n, 0) AS documents
  FROM inter i LEFT JOIN (SELECT query_id, ord, max(agreement) AS best, count(*) AS n FROM kept GROUP BY query_id, ord) k ON i.query_id = k.query_id AND i.ord = k.ord
)
"""


def _atomic(spark, d):
    return E.evaluated(_interpreted(spark, d), E.AtomicConjunction(table(spark, d, "documents").select("doc_id", "text")))


@query(f"WITH {_ATOMIC_PARTS} SELECT query_id, ord, kind, reused, best_score, documents FROM evaluated")
def evaluate_components(spark, d):
    """Every interpretation by its components, each component searched once for all interpretations."""
    return _atomic(spark, d)[0].select("query_id", "ord", "kind", "reused", "best_score", "documents")


@query(f"WITH {_ATOMIC_PARTS} SELECT query_id, ord, kind, best_score, documents FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, documents DESC, ord) AS r FROM evaluated) WHERE r = 1")
def strongest_interpretation(spark, d):
    return E.strongest(_atomic(spark, d)[0]).select("query_id", "ord", "kind", "best_score", "documents")


@query(rf"""
WITH p AS (
  SELECT item_id AS query_id, 0 AS o, text AS "pivot" FROM benchmark UNION ALL SELECT item_id, 1, '  ' FROM benchmark
  UNION ALL SELECT item_id, 2, 'Re ' || text || '!' FROM benchmark
), k AS (SELECT query_id, o, "pivot", regexp_extract_all(trim(regexp_replace(lower("pivot"), '\s+', ' ', 'g')), '{T.STRUCTURAL_TOKEN.replace("'", "''")}')[1:12] AS k FROM p WHERE trim("pivot") <> '')
SELECT query_id, o AS pivot_ord, "pivot", len(k) AS components, array_to_string(k, ' + ') AS parts FROM k WHERE len(k) > 0
""")
def multilingual_alignment(spark, d):
    """Pivots of each item, as an identity translator gives them: what each asks, in its own words; blank ones and those beyond the eighth fall out."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("t"))
    texts = {0: F.col("t"), 1: F.lit("  "), 2: F.concat(F.lit("Re "), "t", F.lit("!")), 8: F.col("t")}
    pivots = items.select("query_id", F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), p.alias("pivot")) for o, p in texts.items()])).alias("p")).select("query_id", "p.ord", "p.pivot")
    return E.aligned(pivots).select("query_id", "pivot_ord", "pivot", F.size("parts").cast("long").alias("components"), F.array_join("parts", " + ").alias("parts"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem),
r AS (SELECT x, y, row_number() OVER (ORDER BY x DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS a, row_number() OVER (ORDER BY y DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS b FROM s)
SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(a, b), 6) AS rank FROM r
""")
def rank_correlation(spark, d):
    """Two scores of every line, by value and by rank, ties in the order of the lines."""
    place = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, d, "lineitem").select(*place, F.col("l_extendedprice").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    return N.rank_correlation(lines, "x", "y", place)
