"""Concept graphs, explanations, reports and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import explain as E
from ..operators import explained as XP
from ..operators import graph as G
from ..operators import search as R
from ..operators import stored as D
from ..sources.concepts import TYPES
from . import base as B
from .base import query, query_set, table
from .built import stored_index
from .search_queries import SEARCH_SQL, _CONF, _confidence

# ------------------------------------------------------------------ graph of customers, suppliers and nations

_GRAPH = """
nodes AS (
  SELECT 'n' || n_nationkey AS id, [lower(n_name)] AS tokens FROM nation UNION ALL SELECT 'r' || r_regionkey, [lower(r_name)] FROM region
  UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lower(s_name), 'supplier' || s_suppkey % 50] END FROM supplier
), rels AS (
  SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PARENT' AS kind FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'CHILD' FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'PARENT' FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'CHILD' FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey, 'RELATED' FROM supplier WHERE s_suppkey % 25 = 0
)
"""


def _graph(spark, d):
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    tokens = F.when(F.col("s_suppkey") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("s_name"), F.concat(F.lit("supplier"), F.col("s_suppkey") % 50)))
    nodes = n.select(key("n", "n_nationkey").alias("id"), F.array(F.lower("n_name")).alias("tokens"))
    nodes = nodes.unionByName(r.select(key("r", "r_regionkey").alias("id"), F.array(F.lower("r_name")).alias("tokens"))).unionByName(s.select(key("s", "s_suppkey").alias("id"), tokens.alias("tokens")))
    edge = lambda df, a, b, k: df.select(a.alias("src"), b.alias("dst"), F.lit(k).alias("kind"))
    nn, nr, ss, sn = key("n", "n_nationkey"), key("r", "n_regionkey"), key("s", "s_suppkey"), key("n", "s_nationkey")
    rels = edge(n, nn, nr, "PARENT").unionByName(edge(n, nr, nn, "CHILD")).unionByName(edge(s.where("s_suppkey % 4 <> 0"), ss, sn, "PARENT"))
    return nodes, rels.unionByName(edge(s, sn, ss, "CHILD")).unionByName(edge(s.where("s_suppkey % 25 = 0"), ss, ss, "RELATED"))


@query(f"""
WITH RECURSIVE {_GRAPH}, e AS (SELECT DISTINCT src, dst FROM rels WHERE kind IN ('PARENT', 'CHILD')),
walk AS (SELECT 'n' || n_nationkey AS start, 'n' || n_nationkey AS node, 0 AS depth FROM nation
  UNION SELECT start, dst, depth + 1 FROM walk JOIN e ON node = src WHERE depth < 2),
least_ AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node),
o AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, node) AS ord FROM least_ WHERE depth > 0)
SELECT start, node, depth, ord FROM o WHERE ord <= 50
""")
def graph_bfs(spark, d):
    nodes, rels = _graph(spark, d)
    starts = nodes.where("id LIKE 'n%'").select(F.col("id").alias("node"))
    return G.expand(starts, rels, depth=2, limit=50, kinds=("PARENT", "CHILD"))


@query(f"""
WITH {_GRAPH}, o AS (SELECT src, count(*) AS n FROM rels GROUP BY src), p AS (SELECT id, tokens, n FROM nodes LEFT JOIN o ON id = src)
SELECT count(*) AS nodes, CAST(sum(len(tokens)) AS BIGINT) AS tokens, count(*) FILTER (n IS NULL) AS without_relations, count(*) FILTER (len(tokens) = 0) AS without_tokens, max(n) AS max_out,
  (SELECT count(*) FROM rels) AS relations, round((SELECT count(*) FROM rels) / count(*), 6) AS mean_out, round((SELECT count(*) FROM rels) / (count(*) * (count(*) - 1)), 6) AS density FROM p
""")
def graph_stats(spark, d):
    return G.statistics(*_graph(spark, d))


@query(f"""
WITH {_GRAPH}, bad AS (SELECT * FROM rels UNION ALL SELECT 'x1', 'r0', 'RELATED' UNION ALL SELECT 'r0', 'x2', 'RELATED'), twice AS (SELECT * FROM nodes UNION ALL SELECT 'r0', ['africa'])
SELECT 'DUPLICATE_CONCEPT_ID' AS issue, id AS subject FROM twice GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'DUPLICATE_TOKEN', t FROM (SELECT unnest(tokens) AS t FROM twice) GROUP BY t HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'CONCEPT_WITHOUT_TOKEN', id FROM twice WHERE len(tokens) = 0
UNION ALL SELECT DISTINCT 'MISSING_SOURCE', src FROM bad WHERE src NOT IN (SELECT id FROM twice)
UNION ALL SELECT DISTINCT 'MISSING_TARGET', dst FROM bad WHERE dst NOT IN (SELECT id FROM twice)
UNION ALL SELECT DISTINCT 'SELF_RELATION', src FROM bad WHERE src = dst
UNION ALL SELECT DISTINCT 'CONCEPT_WITHOUT_RELATION', id FROM twice WHERE id NOT IN (SELECT src FROM bad)
""")
def graph_validate(spark, d):
    nodes, rels = _graph(spark, d)
    more = spark.createDataFrame([("x1", "r0", "RELATED"), ("r0", "x2", "RELATED")], "src string, dst string, kind string")
    again = spark.createDataFrame([("r0", ["africa"])], "id string, tokens array<string>")
    return G.validate(nodes.unionByName(again), rels.unionByName(more))


# ------------------------------------------------------------------ explanation


@query(f"""
WITH {_CONF}, e AS (SELECT query_id, doc_id, unnest(['bm25', 'semantic', 'coverage', 'canonicalCoverage', 'scoreMargin']) AS field,
  unnest(['LEXICAL', 'SEMANTIC', 'COVERAGE', 'CANONICAL_COVERAGE', 'SCORE_MARGIN']) AS category, unnest([bm25, semantic, coverage, canonical, margin]) AS raw FROM conf)
SELECT query_id, doc_id, query_id || ':' || doc_id || ':' || field AS evidence_id, category, field, raw IS NOT NULL AS available, round(raw, 6) AS raw FROM e
""")
def explanation_rows(spark, d):
    return E.evidence(_confidence(spark, d))


@query(f"""
WITH {_CONF} SELECT query_id, doc_id, 'AGREEMENT_NOT_PUBLISHED_TO_RESULTS_VIEW' AS reason, 'UNAVAILABLE' AS state FROM conf
UNION ALL SELECT query_id, doc_id, 'CONFIDENCE_NOT_AVAILABLE', 'UNAVAILABLE' FROM conf WHERE confidence IS NULL
UNION ALL SELECT query_id, doc_id, upper(f) || '_NOT_AVAILABLE', 'UNAVAILABLE' FROM (SELECT query_id, doc_id, unnest(['semantic', 'canonical']) AS f, unnest([semantic, canonical]) AS v FROM conf) WHERE v IS NULL
""")
def missing_evidence(spark, d):
    return E.missing(_confidence(spark, d))


@query(f"""
WITH {SEARCH_SQL}
SELECT query_id, doc_id, 'Rank ' || rank || ': ' || hits || CASE WHEN hits = 1 THEN ' passage' ELSE ' passages' END || ', best BM25 ' || printf('%.6f', bm25) AS line FROM result
""")
def explanation_text(spark, d):
    return E.sentences(D.search(query_set(spark), stored_index(spark, d)))


@query(f"""
WITH {SEARCH_SQL}, m AS (SELECT query_id, count(*) AS documents, max(score) AS best, avg(score) AS mean, sum(hits) AS passages FROM result GROUP BY query_id)
SELECT query_id, unnest(['documents', 'best_score', 'mean_score', 'passages']) AS metric,
  unnest([printf('%.6f', documents::DOUBLE), printf('%.6f', best), printf('%.6f', round(mean, 6)), printf('%.6f', passages::DOUBLE)]) AS value FROM m
""")
def technical_report(spark, d):
    return E.report(D.search(query_set(spark), stored_index(spark, d)))


@query(f"""
WITH {SEARCH_SQL} SELECT query_id, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank)) AS execution_id FROM result GROUP BY query_id
""")
def execution_id(spark, d):
    return E.execution_ids(D.search(query_set(spark), stored_index(spark, d)))


# ------------------------------------------------------------------ metrics


_SELF = f"""
qv AS (SELECT vec_id AS query_id, label AS own, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, own, vec_id, label, {B.cosine("a", "embedding")} AS score FROM qv, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
f AS (SELECT query_id, own, min(rank) FILTER (label = own) AS rank FROM r GROUP BY query_id, own)
"""


@query(f"""
WITH {_SELF} SELECT own AS grp, count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5,
  round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM f GROUP BY own
""")
def retrieval_metrics(spark, d):
    """Queries: every fiftieth vector, searched among all; relevant: the same label."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), "embedding")
    first = R.first_relevant(q, v)
    return E.retrieval_metrics(first.withColumnRenamed("own", "grp"), "grp")


@query("""
WITH s AS (SELECT o_totalprice AS x, l.total AS y FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)
SELECT count(*) AS n, round(min(x), 4) AS lo, round(max(x), 4) AS hi, round(max(x) - min(x), 4) AS range, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(corr(x, y), 6) AS pearson FROM s
""")
def score_distribution(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return E.distribution(o)


@query(f"""
WITH {_GRAPH}, e AS (SELECT DISTINCT src, dst FROM rels), one AS (SELECT src AS start, dst AS node, 1 AS depth, src AS origin FROM e),
steps AS (SELECT * FROM one UNION ALL SELECT start, dst, 2, node FROM one JOIN e ON node = src)
SELECT start, node, arg_max(depth, (origin, depth)) AS depth, max(origin) AS origin FROM steps WHERE start LIKE 'r%' GROUP BY start, node
""")
def expansion_last(spark, d):
    """Nodes within two steps of each region, with the last step to them; steps come by the node they start from."""
    _, rels = _graph(spark, d)
    e = rels.select("src", "dst").distinct()
    one = e.where("src LIKE 'r%'").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth"), F.col("src").alias("origin"))
    two = one.join(e, one["node"] == e["src"]).select("start", F.col("dst").alias("node"), F.lit(2).alias("depth"), F.col("src").alias("origin"))
    return G.materialised(one.unionByName(two), ("origin", "depth"))


@query(f"""
WITH {_GRAPH}, twice AS (SELECT id, tokens, 0 AS o FROM nodes UNION ALL SELECT ' ' || id || ' ', list_append(tokens, 'again'), 1 FROM nodes UNION ALL SELECT '  ', ['blank'], 2),
c AS (SELECT trim(id) AS id, tokens, o || ':' || id AS ord FROM twice), t AS (SELECT id, ord, unnest(tokens) AS token FROM c)
SELECT 'id' AS part, id AS key, min(ord) AS value FROM c WHERE id <> '' GROUP BY id
UNION ALL SELECT 'token', token, arg_min(id, ord) FROM t WHERE token <> '' GROUP BY token
UNION ALL SELECT 'relation', src || '#' || row_number() OVER (PARTITION BY src ORDER BY dst, kind), dst || ':' || kind FROM rels
""")
def graph_build(spark, d):
    """The graph's tables read in order, every concept a second time and one without an id: the first of each id and token, all relations in their order."""
    nodes, rels = _graph(spark, d)
    placed = lambda df, o: df.withColumn("ord", F.concat(F.lit(f"{o}:"), "id"))
    again = nodes.select(F.concat(F.lit(" "), "id", F.lit(" ")).alias("id"), F.array_append("tokens", F.lit("again")).alias("tokens"))
    blank = spark.createDataFrame([("  ", ["blank"])], "id string, tokens array<string>")
    concepts = placed(nodes, 0).unionByName(placed(again, 1)).unionByName(placed(blank, 2))
    by_id, by_token, by_source = G.built(concepts, rels.withColumn("ord", F.struct("dst", "kind")))
    out = by_id.select(F.lit("id").alias("part"), F.col("id").alias("key"), F.col("ord").alias("value")).unionByName(by_token.select(F.lit("token").alias("part"), F.col("token").alias("key"), F.col("id").alias("value")))
    return out.unionByName(by_source.select(F.lit("relation").alias("part"), F.concat("src", F.lit("#"), F.col("place").cast("string")).alias("key"), F.concat("dst", F.lit(":"), "kind").alias("value")))


@query(f"""
WITH qv AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, label, {B.cosine("a", "embedding")} AS score FROM qv, embeddings WHERE vec_id <> query_id),
b AS (SELECT query_id, arg_min(vec_id, (-score, vec_id)) AS id, arg_min(label, (-score, vec_id)) % 5 AS t, max(score) AS score FROM s GROUP BY query_id)
SELECT query_id, score, CASE WHEN t = 0 THEN id END AS object, CASE WHEN t = 1 THEN id END AS color, CASE WHEN t = 2 THEN id END AS place, CASE WHEN t = 3 THEN id END AS action FROM b
""")
def concept_resolution(spark, d):
    """Every fiftieth vector is a query: its nearest concept, under the type that the label gives it."""
    v = table(spark, d, "embeddings")
    scored = R.near_scores(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 1, of_vector=["label"], others=True)
    order = F.struct((-F.col("score")).alias("s"), F.col("vec_id"))
    best = scored.groupBy("query_id").agg(F.min_by(F.struct("vec_id", "label", "score"), order).alias("b"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("b.label") % 5 + 1).cast("int"))
    return G.resolved(best.select("query_id", F.col("b.vec_id").alias("id"), kind.alias("type"), F.col("b.score").alias("score")))


_TIERED = """
res AS (
  SELECT CAST(l_orderkey % 400 AS INTEGER) AS query_id, l_orderkey, CASE WHEN (l_orderkey % 400) % 2 = 0 THEN 'IMAGE' ELSE 'DOCUMENT' END AS modality,
    CASE WHEN (l_orderkey % 400) % 4 = 2 THEN CASE WHEN l_quantity > 48 THEN 'BEST' ELSE 'RELATED' END WHEN l_quantity > 49 THEN 'BEST' WHEN l_quantity > 46 THEN 'PARTIAL' WHEN l_quantity > 44 THEN 'RELATED' END AS tier FROM lineitem
), n AS (
  SELECT query_id, count(*) AS results, count(*) FILTER (modality = 'IMAGE' AND tier = 'BEST') AS best, count(*) FILTER (modality = 'IMAGE' AND tier = 'PARTIAL') AS partial,
    count(*) FILTER (modality = 'IMAGE' AND tier = 'RELATED') AS related, CASE WHEN query_id % 3 = 0 THEN NULL ELSE 'query ' || query_id END AS query FROM res GROUP BY query_id
)
"""


def _compact_sql(language: str) -> str:
    s = {k: [x.replace("'", "''") for x in (v if isinstance(v, tuple) else (v,))] for k, v in XP.SENTENCES[language].items()}
    some = lambda name: f"CASE WHEN {name} = 1 THEN '{s[name][0]}' ELSE {name} || '{s[name][1]}' END"
    t = s["tiers"]
    return f"""
CASE WHEN trim(coalesce(query, '')) <> '' THEN '{s["asked"][0]}' || query || '{s["asked"][1]}' ELSE '{s["asked nothing"][0]}' END
  || '{s["found"][0]}' || results || CASE WHEN results = 1 THEN '{s["found"][1]}' ELSE '{s["found"][2]}' END
  || CASE WHEN best + partial = 0 THEN '{s["no tiers"][0]}' ELSE '{t[0]}' || {some("best")} || '{t[1]}' || {some("partial")} || '{t[2]}' || {some("related")} || '{t[3]}'
    || CASE WHEN best > 0 AND partial + related = 0 THEN '{s["all"][0]}' WHEN best > 0 THEN '{s["some"][0]}' ELSE '{s["parts"][0]}' END END"""


@query(f"WITH {_TIERED} SELECT query_id, {_compact_sql('en')} AS english, {_compact_sql('ro')} AS romanian FROM n")
def compact_explanation(spark, d):
    """What each search found, in a few English and Romanian sentences; lines of orders play the results."""
    q, n = F.pmod("l_orderkey", F.lit(400)).cast("int"), F.col("l_quantity")
    few = F.when(n > 48, "BEST").otherwise("RELATED")
    tier = F.when(q % 4 == 2, few).when(n > 49, "BEST").when(n > 46, "PARTIAL").when(n > 44, "RELATED")
    results = table(spark, d, "lineitem").select(q.alias("query_id"), F.when(q % 2 == 0, "IMAGE").otherwise("DOCUMENT").alias("modality"), tier.alias("tier"))
    counts = XP.tier_counts(results).withColumn("query", F.when(F.col("query_id") % 3 != 0, F.concat(F.lit("query "), F.col("query_id").cast("string"))))
    return XP.compact(counts, "en").withColumnRenamed("text", "english").join(XP.compact(counts, "ro").withColumnRenamed("text", "romanian"), "query_id")


@query(f"""
WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_totalprice AS p FROM orders), twice AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE doc_id % 97 = 0),
a AS (SELECT query_id, CASE WHEN doc_id % 89 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, doc_id AS k, doc_id % 2 = 0 AS here FROM r),
bad AS (SELECT DISTINCT query_id FROM r WHERE doc_id % 97 = 0 OR doc_id % 89 = 0),
row_ AS (SELECT query_id, doc_id, CASE WHEN doc_id % 89 = 0 OR doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS seen, doc_id % 10 <> 0 AS complete FROM twice)
SELECT 'search' || query_id || ':explanation:1' AS explanation_id, query_id, CASE WHEN b THEN 'INVALID' WHEN bool_and(complete) THEN 'AVAILABLE' ELSE 'PARTIAL' END AS state,
  CAST(CASE WHEN b THEN 0 ELSE count(*) END AS BIGINT) AS results, CAST(CASE WHEN b THEN 0 ELSE sum(seen) END AS BIGINT) AS evidence, CAST(CASE WHEN b THEN 0 ELSE 2 * count(*) - sum(seen) END AS BIGINT) AS missing,
  '{",".join(XP.LIMITATIONS)}' AS limitations
FROM (SELECT row_.*, bad.query_id IS NOT NULL AS b FROM row_ LEFT JOIN bad USING (query_id)) GROUP BY query_id, b
""")
def explanation_projection(spark, d):
    """Orders play the results of their customers' searches; some stand twice, some agreements are about none: those searches are not explained."""
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    # of a result itself agreement is known; what is supplied for it takes that away where it is odd
    rows = r.unionByName(r.where("doc_id % 97 = 0")).select(
        "query_id", "doc_id", F.concat(F.lit("search"), "query_id").alias("execution_id"), F.lit(1).alias("rank"), (F.col("doc_id") % 10 != 0).alias("complete"),
        F.lit(0.5).alias("agreement"), F.when(F.col("doc_id") % 5 != 0, 0.5).alias("confidence"),
    )
    odd = F.when(F.col("doc_id") % 89 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    agreement = r.select("query_id", odd.alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, 0.7).alias("agreement"))
    confidence = r.limit(0).withColumn("confidence", F.lit(None).cast("double"))
    return XP.projected(rows, {"agreement": agreement, "confidence": confidence}, "1")


@query(f"""
WITH {_CONF} SELECT query_id, doc_id, CASE WHEN semantic IS NOT NULL AND canonical IS NOT NULL AND bm25 IS NOT NULL AND coverage IS NOT NULL AND margin IS NOT NULL THEN 'AVAILABLE'
  WHEN coalesce(semantic, canonical, bm25, coverage, margin) IS NOT NULL THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS state FROM conf
""")
def availability(spark, d):
    return E.availability(E.evidence(_confidence(spark, d)))


@query("""
SELECT count(*) AS results, count(*) FILTER (o_orderkey % 4 = 0) AS images, count(*) FILTER (o_orderkey % 4 = 1) AS emails, count(*) FILTER (o_orderkey % 4 = 2) AS pdfs,
  count(*) FILTER (o_orderkey % 4 = 3) AS documents FROM orders
""")
def report_header(spark, d):
    kind = F.element_at(F.array(F.lit("IMAGE"), F.lit("email "), F.lit("PDF"), F.lit(None).cast("string")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return E.header(table(spark, d, "orders").select(kind.alias("kind")))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return E.latency(table(spark, d, "events"), "event_type", "value")
