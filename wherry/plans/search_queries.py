"""Retrieval, vectors, fusion, evidence and cutoffs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..functions import text as T
from ..operators import fuse as U
from ..operators import index as I
from ..operators import search as R
from ..operators import stored as D
from . import base as B
from .base import query, query_set, rows, table
from .built import stored_index
from .text_queries import _WORDS, expand_sql

# ------------------------------------------------------------------ lexical search

_SCORE = """
raw AS (
  SELECT query_id, tokens, doc_id, chunk_index, bm25, 1.0::DOUBLE AS coverage, prox,
    round(bm25 * 2.8 + boost + prox + 2.5 + CASE WHEN bm25 > 2.0 THEN 1.2 ELSE 0.0 END, 6) AS base FROM signals WHERE bm25 > 0
), scored AS (
  SELECT *, round(base + 5.0 + CASE WHEN prox >= 2.0 THEN 6.0 ELSE 0.0 END, 6) AS score FROM raw WHERE base >= CASE WHEN len(tokens) = 1 THEN 0.65 ELSE 1.10 END
), rolled AS (
  SELECT query_id, doc_id, any_value(tokens) AS tokens, round(max(score) + 0.5 * least(count(*), 5), 6) AS score, count(*) AS hits,
    arg_min(chunk_index, (-score, chunk_index)) AS chunk_index, max(bm25) AS bm25, max(coverage) AS coverage FROM scored GROUP BY query_id, doc_id
), topped AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM rolled),
near AS (SELECT * FROM topped WHERE score >= round(top * CASE WHEN len(tokens) = 1 AND length(tokens[1]) <= 4 THEN 0.70::DOUBLE ELSE 0.80::DOUBLE END, 6)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near),
result AS (
  SELECT query_id, rank, doc_id, score, hits, CAST(chunk_index AS BIGINT) AS chunk_index, round(bm25, 6) AS bm25, coverage FROM ranked WHERE rank <= 10
)
"""
_CAND = f"cand AS (SELECT * FROM w, asked WHERE list_has_all(words, tokens) AND {B.in_window('tokens', 'words')})"
SEARCH_SQL = f"""
{_WORDS}, {B.ASKED_SQL}, {_CAND},
signals AS (SELECT *, 0.8 * len(list_distinct(tokens)) AS boost, {B.bm25("tokens", "words")} AS bm25, {B.proximity("tokens", "words")} AS prox FROM cand), {_SCORE}
"""


@query(f"WITH {SEARCH_SQL} SELECT * FROM result")
def hybrid_search(spark, d):
    """The stated queries against the documents' stored index."""
    return D.search(query_set(spark), stored_index(spark, d))


_WEIGHT = (
    "CASE WHEN NOT starts_with(e, t) THEN 0.0::DOUBLE WHEN length(e) = length(t) THEN 1.0::DOUBLE WHEN length(e) - length(t) <= 2 THEN 0.95::DOUBLE "
    "WHEN length(e) - length(t) <= 4 THEN 0.75::DOUBLE WHEN length(e) - length(t) <= 6 THEN 0.55::DOUBLE ELSE 0.35::DOUBLE END"
)
_HELD = "list_filter(exps, lambda e: len(list_filter(words, lambda w: starts_with(w, e))) > 0)"
_BEST = f"list_max(list_transform(tokens, lambda t: {_WEIGHT}))"


@query(f"""
WITH {expand_sql(5)}, more AS (SELECT query_id, list(DISTINCT word) AS more FROM (SELECT query_id, unnest(tokens) AS token FROM asked) JOIN expanded USING (token) GROUP BY query_id),
{_CAND}, full_ AS (SELECT cand.*, list_concat(list_distinct(tokens), list_sort(list_filter(coalesce(more, []), lambda m: NOT list_contains(tokens, m)))) AS exps FROM cand LEFT JOIN more USING (query_id)),
held AS (SELECT *, {_HELD} AS held FROM full_),
ext AS (SELECT *, list_concat(tokens, list_filter(held, lambda e: NOT list_contains(tokens, e) AND {_BEST} >= 0.55)) AS wide FROM held),
signals AS (SELECT *, 0.8 * list_sum(list_transform(held, lambda e: {_BEST})) AS boost, {B.bm25("wide", "words")} AS bm25, {B.proximity("tokens", "words")} AS prox FROM ext), {_SCORE}
SELECT * FROM result
""")
def hybrid_search_expanded(spark, d):
    return D.search(query_set(spark), stored_index(spark, d), expand=True)


@query(f"""
WITH {_WORDS}, {B.ASKED_SQL},
lex AS (SELECT query_id, doc_id, chunk_index FROM w, asked WHERE list_has_all(words, tokens)),
ck AS (SELECT doc_id, chunk_index, list_distinct(regexp_extract_all(lower(chunk_text), '{T.TOKEN}')[1:4096]) AS k FROM chunks),
can AS (SELECT query_id, doc_id, chunk_index, len(list_intersect(k, regexp_extract_all(lower(query), '{T.TOKEN}'))) AS matched FROM ck, asked
  WHERE list_has_any(k, regexp_extract_all(lower(query), '{T.TOKEN}'))),
both_ AS (SELECT query_id, doc_id, chunk_index, lex.doc_id IS NOT NULL AS l, can.doc_id IS NOT NULL AS c
  FROM lex FULL JOIN can USING (query_id, doc_id, chunk_index))
SELECT query_id, doc_id, chunk_index, CASE WHEN l AND c THEN 'both' WHEN l THEN 'lexical' ELSE 'canonical' END AS provenance
FROM both_
""".replace("lex.doc_id IS NOT NULL AS l, can.doc_id IS NOT NULL AS c\n  FROM lex FULL JOIN can", "coalesce(l, FALSE) AS l, coalesce(c, FALSE) AS c\n  FROM (SELECT *, TRUE AS l FROM lex) FULL JOIN (SELECT *, TRUE AS c FROM can)"))
def hydrate_candidates(spark, d):
    """Lexical and canonical candidates, and which way each was found."""
    chunked, asked = I.chunks(table(spark, d, "documents")), R.understood(query_set(spark))
    lexical = R.complete_chunks(asked, chunked).select("query_id", "doc_id", "chunk_index", F.lit(True).alias("l"))
    terms = asked.select("query_id", F.explode(F.array_distinct(T.canonical_tokens(F.col("query")))).alias("term"))
    hashes = terms.select("query_id", T.canonical_hash(F.col("term")).alias("hash"))
    canonical = I.postings_lookup(hashes, I.canonical_postings(chunked, terms)).select("query_id", "doc_id", "chunk_index", F.lit(True).alias("c"))
    out = lexical.join(canonical, ["query_id", "doc_id", "chunk_index"], "full_outer")
    way = F.when(F.col("l") & F.col("c"), "both").when(F.col("l"), "lexical").otherwise("canonical")
    return out.select("query_id", "doc_id", "chunk_index", way.alias("provenance"))


_SNIP = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""
WITH {B.ASKED_SQL}, c AS (SELECT doc_id, {_SNIP} AS clean FROM documents),
f AS (SELECT query_id, doc_id, clean, list_filter(tokens, lambda t: contains(lower(clean), t))[1] AS token FROM c, asked),
p AS (SELECT *, instr(lower(clean), token) - 1 AS pos FROM f),
r AS (SELECT *, greatest(0, pos - 3) AS a, least(length(clean), pos + 140) AS z FROM p)
SELECT query_id, doc_id, CASE WHEN token IS NULL THEN CASE WHEN length(clean) > 180 THEN substring(clean, 1, 180) || '...' ELSE clean END
  ELSE regexp_replace(CASE WHEN a > 0 THEN '...' ELSE '' END || substring(clean, a + 1, z - a) || CASE WHEN z < length(clean) THEN ' ...' ELSE '' END,
    '(?i)' || token, '【' || upper(token) || '】', 'g') END AS snippet
FROM r
""")
def snippet(spark, d):
    return R.snippets(table(spark, d, "documents"), R.understood(query_set(spark)))


_RERANK = [(1, "with this"), (2, "thre tion"), (3, "that from the")]


def _rerank_sql() -> str:
    held = "len(list_filter(k, lambda t: length(t) >= 2 AND contains(low, t)))"
    pairs = "flatten(list_transform(range(len(k)), lambda i: list_transform(range(i + 1, len(k)), lambda j: [instr(low, k[i + 1]), instr(low, k[j + 1])])))"
    one = "CASE WHEN x[1] = 0 OR x[2] = 0 THEN 0 WHEN abs(x[1] - x[2]) < 30 THEN 4 WHEN abs(x[1] - x[2]) < 80 THEN 2 WHEN abs(x[1] - x[2]) < 150 THEN 1 ELSE 0 END"
    return f"""
WITH {B.CHUNK_SQL}, q(query_id, query) AS (VALUES {B.values(_RERANK)}),
p AS (SELECT query_id, query, string_split(query, ' ') AS k, doc_id, chunk_index, lower(chunk_text) AS low FROM chunks, q WHERE contains(lower(chunk_text), string_split(query, ' ')[1])),
r AS (SELECT *, {held} AS held, coalesce(list_sum(list_transform({pairs}, lambda x: {one})), 0) AS near FROM p)
SELECT query_id, doc_id, chunk_index, round(0.25 * 0.45::DOUBLE + 2.0 * 0.55 + held / len(k) * 1.2 + CASE WHEN contains(low, query) THEN 2.5 ELSE 0.0 END
  + CASE WHEN len(k) >= 2 AND held = len(k) THEN 4.0 ELSE 0.0 END + near * 0.85, 6) AS score FROM r
"""


@query(_rerank_sql())
def cross_encoder_rerank(spark, d):
    q = rows(spark, _RERANK, "query_id int, query string")
    pairs = I.chunks(table(spark, d, "documents")).join(F.broadcast(q), F.lower("chunk_text").contains(F.substring_index("query", " ", 1)))
    score = S.rerank(F.col("query"), F.col("chunk_text"), F.lit(0.25), F.lit(2.0))
    return pairs.select("query_id", "doc_id", "chunk_index", F.round(score, 6).alias("score"))


# ------------------------------------------------------------------ vectors

_VECTORS = f"""
qv AS (SELECT CAST(vec_id AS INTEGER) AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
scores AS (SELECT query_id, vec_id, {B.cosine("a", "embedding")} AS score FROM qv, embeddings)
"""
_TOP = "SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {}"


def _near(spark, d, k=0, more=(), others=False):
    """Every fiftieth vector is a query, scored against every vector, without the rows that are too far off to be among the first ``k``, or to reach the images' threshold."""
    v = table(spark, d, "embeddings")
    return R.near_scores(v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("int").alias("query_id"), "embedding"), v, k, of_vector=more, others=others)


@query(f"WITH {_VECTORS} SELECT * FROM ({_TOP.format('scores')}) WHERE rank <= 10")
def cosine_topk(spark, d):
    return R.top(_near(spark, d, 10), 10)


@query(f"WITH {_VECTORS}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM scores) SELECT query_id, vec_id, score FROM t WHERE score >= greatest(0.22, round(top * 0.85, 6))")
def image_adaptive_threshold(spark, d):
    return R.image_threshold(_near(spark, d)).select("query_id", "vec_id", "score")


@query(f"""
WITH {_VECTORS}, r AS (SELECT * FROM ({_TOP.format("scores")}) WHERE rank <= 10),
g AS (SELECT *, greatest(round(lag(score) OVER (PARTITION BY query_id ORDER BY rank) - score, 6), 0.0) AS gap FROM r),
m AS (SELECT query_id, max(gap) AS most, sum(gap) AS whole, count(*) AS n FROM g GROUP BY query_id),
b AS (SELECT query_id, min(rank) AS cut FROM g JOIN m USING (query_id) WHERE gap = most AND n >= 3 AND most > round(whole - most, 6) GROUP BY query_id)
SELECT query_id, vec_id, score, rank FROM r LEFT JOIN b USING (query_id) WHERE cut IS NULL OR rank < cut
""")
def image_adaptive_cutoff(spark, d):
    return R.image_cutoff(R.top(_near(spark, d, 10), 10))


@query(f"WITH {_VECTORS} SELECT query_id, count(*) AS n, round(max(score), 6) AS best, count(*) FILTER (score >= 0.22) AS kept FROM scores GROUP BY query_id")
def multi_vector_shared_scan(spark, d):
    v = table(spark, d, "embeddings")
    return R.score_counts(v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("int").alias("query_id"), "embedding"), v, 0.22)


@query(f"""
WITH {_VECTORS}, s AS (SELECT s.query_id, e.label, s.score, s.vec_id FROM scores s JOIN embeddings e USING (vec_id) WHERE s.vec_id <> s.query_id)
SELECT query_id, arg_min(vec_id, (-score, vec_id)) AS vec_id, arg_min(label, (-score, vec_id)) AS label, max(score) AS score FROM s GROUP BY query_id
""")
def concept_nearest(spark, d):
    s = _near(spark, d, 1, ["label"], others=True)
    order = F.struct((-F.col("score")).alias("s"), F.col("vec_id"))
    return s.groupBy("query_id").agg(F.min_by("vec_id", order).alias("vec_id"), F.min_by("label", order).alias("label"), F.max("score").alias("score"))


@query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length,
  round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first, len(embedding) = 64 AND NOT isnan(embedding[1]) AS valid FROM embeddings
""")
def unit_vectors(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(S.norm(v), 6).alias("length"), F.round(F.get(S.unit(v), F.lit(0)), 6).alias("first"), ((F.size(v) == 64) & ~F.isnan(F.get(v, F.lit(0)))).alias("valid")
    )


# ------------------------------------------------------------------ fusion over pivots

#: Pivots of the stated queries: text, order, route.
_PIVOTS = (
    (1, "with this", 0, 1), (1, "With This ", 1, 2), (1, "that with", 2, 4), (2, "thre tion", 0, 1), (2, "tion", 1, 2), (3, "that from", 0, 1), (3, "from", 1, 4),
)


def _pivots(spark):
    return U.pivots(rows(spark, _PIVOTS, "query_id int, pivot string, ord int, mask int"))


def _pivot_results(spark, d):
    """(query_id, ord, doc_id, ...) of the search for every pivot, all in one plan."""
    p = _pivots(spark)
    key = (F.col("query_id") * 100 + F.col("ord")).alias("query_id")
    found = D.search(p.select(key, F.col("pivot").alias("query")), stored_index(spark, d))
    return found.withColumns({"ord": F.pmod("query_id", F.lit(100)), "query_id": F.floor(F.col("query_id") / 100).cast("int")})


_PIVOT_ROWS = f"""
raw_pivots(query_id, "pivot", ord, mask) AS (VALUES {B.values(_PIVOTS)}),
pivots AS (SELECT query_id, arg_min("pivot", ord) AS "pivot", min(ord) AS ord, CAST(bit_or(mask) AS INTEGER) AS mask FROM raw_pivots GROUP BY query_id, lower(trim("pivot")))
"""
_PIVOT_SEARCH = SEARCH_SQL.replace(B.QUERY_SQL, f'{_PIVOT_ROWS}, q AS (SELECT query_id * 100 + ord AS query_id, "pivot" AS query FROM pivots)')
_FUSED = f"""
{_PIVOT_SEARCH}, found AS (SELECT query_id // 100 AS query_id, query_id % 100 AS ord, doc_id, score, bm25, coverage FROM result),
n AS (SELECT query_id, count(*) AS pivots FROM pivots GROUP BY query_id),
fused AS (
  SELECT f.query_id, f.doc_id, max(score) AS score, max(bm25) AS bm25, max(coverage) AS coverage, CAST(bit_or(mask) AS INTEGER) AS mask,
    count(DISTINCT f.ord) AS support, any_value(n.pivots) AS pivots
  FROM found f JOIN pivots p ON f.query_id = p.query_id AND f.ord = p.ord JOIN n ON f.query_id = n.query_id GROUP BY f.query_id, f.doc_id
)
"""


def _fused(spark, d):
    return U.pivot_fusion(_pivot_results(spark, d), _pivots(spark))


@query("""
WITH raw AS (
  SELECT conv_id AS query_id, text AS p, CAST(turn AS INTEGER) AS ord, 1 AS mask FROM conversations WHERE text IS NOT NULL
  UNION ALL SELECT conv_id, '  ' || text || ' ', CAST(turn + 1000 AS INTEGER), CASE WHEN turn % 2 = 0 THEN 2 ELSE 4 END FROM conversations WHERE text IS NOT NULL
), g AS (SELECT query_id, min(ord) AS ord, CAST(bit_or(mask) AS INTEGER) AS mask, lower(trim(p)) AS k FROM raw GROUP BY query_id, lower(trim(p)))
SELECT g.query_id, min(p) AS "pivot", g.ord, g.mask FROM g JOIN raw ON raw.query_id = g.query_id AND raw.ord = g.ord AND lower(trim(p)) = k GROUP BY g.query_id, k, g.ord, g.mask
""")
def pivot_set(spark, d):
    """The turns of every conversation as its pivots, each a second time in a blank frame as an alias or a translation."""
    turns = table(spark, d, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("query_id"), "text", F.col("turn").cast("int").alias("ord"))
    again = turns.select("query_id", F.concat(F.lit("  "), "text", F.lit(" ")).alias("pivot"), (F.col("ord") + 1000).alias("ord"), F.when(F.col("ord") % 2 == 0, U.ALIAS).otherwise(U.TRANSLATION).alias("mask"))
    first = turns.select("query_id", F.col("text").alias("pivot"), "ord", F.lit(U.ORIGINAL).alias("mask"))
    return U.pivots(first.unionByName(again)).select("query_id", "pivot", "ord", "mask")


@query(f"WITH {_FUSED} SELECT query_id, doc_id, score, bm25, coverage, mask, support, round(support / pivots, 6) AS agreement FROM fused")
def pivot_fusion(spark, d):
    return _fused(spark, d).select("query_id", "doc_id", "score", "bm25", "coverage", "mask", "support", "agreement")


_MARGIN = """
mr AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM fused),
margins AS (SELECT query_id, count(*) AS candidates, max(score) FILTER (r = 1) AS best, max(score) FILTER (r = 2) AS second FROM mr GROUP BY query_id)
"""


@query(f"WITH {_FUSED}, {_MARGIN} SELECT *, round(best - second, 6) AS margin FROM margins")
def score_margin(spark, d):
    return U.margins(_fused(spark, d))


# images: vectors that play the pictures of the stated queries
_IMAGES = f"img AS (SELECT CAST(query_id // 50 AS INTEGER) AS query_id, vec_id, score FROM ({_TOP.format('scores')}) WHERE rank <= 10 AND query_id IN (50, 100, 150))"
_BOTH = f"""
{_FUSED}, {_VECTORS}, {_IMAGES}, mixed AS (
  SELECT query_id, 'DOCUMENT' AS modality, doc_id AS id, score FROM fused
  UNION ALL SELECT query_id, 'IMAGE', vec_id, round(score * CASE query_id WHEN 1 THEN 20.0 WHEN 2 THEN 80.0 ELSE CASE WHEN vec_id % 3 = 0 THEN 12.0 ELSE 1.0 END END, 6) FROM img
), rels AS (SELECT *, CASE WHEN max(score) OVER w > 0 THEN round(score / max(score) OVER w, 6) ELSE 0.0 END AS rel FROM mixed WINDOW w AS (PARTITION BY query_id, modality))
"""


def _mixed(spark, d):
    docs = _fused(spark, d).select("query_id", F.lit("DOCUMENT").alias("modality"), F.col("doc_id").alias("id"), "score")
    img = R.top(_near(spark, d, 10), 10).where("query_id IN (50, 100, 150)").withColumn("query_id", F.floor(F.col("query_id") / 50).cast("int"))
    # query 1 asks for both, 2 for images, 3 for documents; every third name holds a query word
    q = F.col("query_id")
    factor = U.image_factor(q != 2, q != 3, F.col("vec_id") % 3 == 0, F.lit(False))
    img = img.select("query_id", F.lit("IMAGE").alias("modality"), F.col("vec_id").alias("id"), F.round(F.col("score") * factor, 6).alias("score"))
    return docs.unionByName(img)


@query(f"WITH {_BOTH} SELECT query_id, modality, id, score, rel FROM rels WHERE rel >= 0.65")
def modality_fusion(spark, d):
    return U.accepted(_mixed(spark, d))


_MIXED_RANK = f"""
{_BOTH}, k AS (SELECT *, CASE WHEN min(modality) OVER w <> max(modality) OVER w THEN rel ELSE score END AS key FROM rels WHERE rel >= 0.65 WINDOW w AS (PARTITION BY query_id)),
mranked AS (SELECT query_id, modality, id, score, rel, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, modality, score DESC, id) AS rank FROM k)
"""


@query(f"WITH {_MIXED_RANK} SELECT * FROM mranked")
def mixed_rank(spark, d):
    return U.mixed_rank(U.accepted(_mixed(spark, d)))


@query(f"WITH {_MIXED_RANK} SELECT query_id, modality, id, rank, rank <= 5 AS displayed FROM mranked")
def display_split(spark, d):
    return U.mixed_rank(U.accepted(_mixed(spark, d))).select("query_id", "modality", "id", "rank", (F.col("rank") <= 5).alias("displayed"))


_CONF = f"""
{_FUSED}, {_MARGIN}, obs AS (
  SELECT f.*, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 10) / 10.0::DOUBLE END AS semantic, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 11) / 10.0::DOUBLE END AS canonical,
    candidates, second, round(best - second, 6) AS margin FROM fused f JOIN margins USING (query_id)
), sig AS (
  SELECT *, bm25 / (bm25 + 4.5) AS s_bm25, semantic / (semantic + 0.25) AS s_semantic, CASE WHEN coverage BETWEEN 0 AND 1 THEN coverage END AS s_coverage,
    CASE WHEN canonical BETWEEN 0 AND 1 THEN canonical END AS s_canonical,
    CASE WHEN candidates >= 2 AND score > 0 AND second >= 0 AND margin >= 0 THEN CASE WHEN score < second + margin - greatest(1e-6, (second + margin) * 1e-6) THEN 0.0
      ELSE (margin / (second + margin)) / (margin / (second + margin) + 0.15) END END AS s_margin FROM obs
), lay AS (SELECT *, list_reverse_sort(list_filter([sqrt(s_bm25 * s_coverage), s_semantic * 0.85, s_canonical * 0.80], lambda x: x IS NOT NULL)) AS l FROM sig),
c1 AS (SELECT *, l[1] + CASE WHEN l[2] IS NOT NULL THEN (1 - l[1]) * 0.20 * l[2] ELSE 0.0 END AS c FROM lay),
c2 AS (SELECT *, c + CASE WHEN canonical IS NOT NULL OR bit_count(mask) > 1 THEN (1 - c) * 0.05 ELSE 0.0 END AS cc FROM c1),
conf AS (SELECT *, round(cc * CASE WHEN s_margin IS NOT NULL THEN 0.85 + 0.15 * s_margin ELSE 1.0 END, 6) AS confidence FROM c2)
"""


def _confidence(spark, d):
    fused = _fused(spark, d)
    docs = fused.withColumns(
        {
            # stand-ins that follow the id, since no text encoder is at hand: null is not observed
            "semantic": F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 10) / 10.0),
            "canonical": F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 11) / 10.0),
        }
    )
    return U.document_confidence(docs, U.margins(fused))


@query(f"WITH {_CONF} SELECT query_id, doc_id, round(s_bm25, 6) AS s_bm25, round(s_semantic, 6) AS s_semantic, s_coverage, s_canonical, round(s_margin, 6) AS s_margin, confidence FROM conf")
def document_confidence(spark, d):
    c = _confidence(spark, d)
    six = lambda n: F.round(n, 6).alias(n)
    return c.select("query_id", "doc_id", six("s_bm25"), six("s_semantic"), "s_coverage", "s_canonical", six("s_margin"), "confidence")


# components of the stated queries: their words
_ATOMIC = f"""
{_WORDS}, {B.ASKED_SQL}, comp AS (SELECT DISTINCT query_id, unnest(tokens) AS component FROM asked),
hits AS (SELECT query_id, component, 'DOCUMENT' AS modality, doc_id AS id, round(max({B.bm25("[component]", "words")}), 6) AS score FROM w JOIN comp ON list_contains(words, component) GROUP BY ALL),
st AS (SELECT *, round(score / max(score) OVER (PARTITION BY query_id, component, modality), 6) AS strength FROM hits),
n AS (SELECT query_id, count(DISTINCT component) AS components FROM comp GROUP BY query_id),
agg AS (SELECT query_id, modality, id, count(*) AS support, round(sum(strength), 6) AS strength FROM st GROUP BY ALL),
agr AS (SELECT query_id, modality, id, support, components, round((support + least(1.0, greatest(0.0, strength / support))) / (components + 1), 6) AS agreement FROM agg JOIN n USING (query_id)),
atomic AS (SELECT query_id, modality, id, support, agreement, CASE WHEN support = components THEN 'BEST' ELSE 'PARTIAL' END AS tier,
  row_number() OVER (PARTITION BY query_id ORDER BY agreement DESC, modality, id) AS ord FROM agr)
"""


def _atomic(spark, d, keep):
    asked = R.understood(query_set(spark))
    comp = asked.select("query_id", F.explode("tokens").alias("component")).distinct()
    words = I.chunks(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), T.words(F.col("norm")).alias("words"))
    hits = words.join(F.broadcast(comp), F.array_contains("words", F.col("component")))
    score = F.round(F.max(S.bm25(F.array("component"), F.col("words"))), 6)
    found = hits.groupBy("query_id", "component", F.lit("DOCUMENT").alias("modality"), "id").agg(score.alias("score"))
    return U.atomic_conjunction(found, comp, keep).select("query_id", "modality", "id", "support", "agreement", "tier", "ord")


@query(f"WITH {_ATOMIC} SELECT * FROM atomic WHERE ord <= 20")
def atomic_conjunction(spark, d):
    return _atomic(spark, d, 20)


@query(f"WITH {_ATOMIC} SELECT query_id, tier, count(*) AS n FROM atomic GROUP BY ALL")
def match_tiers(spark, d):
    return _atomic(spark, d, 1 << 40).groupBy("query_id", "tier").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ adaptive cutoff

_CUT_ROWS = """
cut0 AS (
  SELECT CAST(l_orderkey % 400 AS INTEGER) AS query_id, l_orderkey, l_linenumber, round(l_extendedprice, 2) AS score,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE (l_partkey % 10) / 10.0::DOUBLE END AS confidence,
    CASE WHEN (l_orderkey % 400) % 4 = 3 THEN NULL WHEN l_quantity > 40 THEN 'BEST' WHEN l_quantity > 15 THEN 'PARTIAL' ELSE 'RELATED' END AS tier,
    CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE (l_suppkey % 7) / 6.0::DOUBLE END AS agreement,
    CASE WHEN (l_orderkey % 400) % 2 = 0 THEN 'IMAGE' ELSE 'DOCUMENT' END AS modality FROM lineitem
), cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE tier WHEN 'BEST' THEN 3 WHEN 'PARTIAL' THEN 2 WHEN 'RELATED' THEN 1 ELSE 0 END DESC, score DESC, l_orderkey, l_linenumber) AS rank FROM cut0)
"""


@query(f"""
WITH {_CUT_ROWS}, t AS (SELECT *, CASE tier WHEN 'BEST' THEN 3 WHEN 'PARTIAL' THEN 2 WHEN 'RELATED' THEN 1 END AS t,
  min(score) OVER q AS lo, max(score) OVER q AS hi, count(*) OVER q AS n FROM cut WINDOW q AS (PARTITION BY query_id)),
u AS (SELECT *, round((2.0 * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END + coalesce(confidence, 0.0) + coalesce((t - 1) / 2.0 * 3.0::DOUBLE, 0.0) + coalesce(agreement * 2.0, 0.0))
  / (2.0 + CASE WHEN confidence IS NULL THEN 0 ELSE 1 END + CASE WHEN t IS NULL THEN 0 ELSE 3 END + CASE WHEN agreement IS NULL THEN 0 ELSE 2 END), 6) AS utility FROM t),
g AS (SELECT *, round(lag(utility) OVER w - utility, 6) AS gap, first_value(t) OVER w AS lead FROM u WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
med AS (SELECT query_id, median(gap) FILTER (gap > 0) AS m, max(gap) FILTER (rank >= 3 AND gap > 0) AS big,
  bool_and(modality = 'IMAGE' AND t IS NOT NULL) AND max(lead) > 1 AS tiered, min(rank) FILTER (rank >= 3 AND t < lead) AS fall FROM g GROUP BY query_id),
dev AS (SELECT query_id, median(abs(gap - m)) AS s FROM g JOIN med USING (query_id) WHERE gap > 0 GROUP BY query_id),
cutat AS (SELECT query_id, any_value(CASE WHEN tiered THEN fall END) AS fall, min(CASE WHEN big > round(m + s, 6) AND rank >= 3 AND gap = big THEN rank END) AS elbow
  FROM g JOIN med USING (query_id) LEFT JOIN dev USING (query_id) GROUP BY query_id)
SELECT query_id, rank, utility, n <= 2 OR coalesce(rank < coalesce(fall, elbow), TRUE) AS shown,
  CASE WHEN n > 2 AND fall IS NOT NULL THEN 'MATCH_TIER_BOUNDARY' WHEN n > 2 AND elbow IS NOT NULL THEN 'DISTRIBUTION_ELBOW' ELSE 'ALL_RESULTS_MEANINGFUL' END AS reason
FROM g JOIN cutat USING (query_id)
""")
def adaptive_result_cutoff(spark, d):
    li = table(spark, d, "lineitem")
    q = F.pmod("l_orderkey", F.lit(400)).cast("int")
    tier = F.when(q % 4 == 3, None).when(F.col("l_quantity") > 40, "BEST").when(F.col("l_quantity") > 15, "PARTIAL").otherwise("RELATED")
    base = li.select(
        q.alias("query_id"), "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("score"), tier.alias("tier"),
        F.when(F.col("l_partkey") % 5 != 0, (F.col("l_partkey") % 10) / 10.0).alias("confidence"),
        F.when(F.col("l_suppkey") % 3 != 0, (F.col("l_suppkey") % 7) / 6.0).alias("agreement"),
        F.when(q % 2 == 0, "IMAGE").otherwise("DOCUMENT").alias("modality"),
    )
    order = Window.partitionBy("query_id").orderBy(F.coalesce(U.tier_rank(F.col("tier")), F.lit(0)).desc(), F.desc("score"), "l_orderkey", "l_linenumber")
    base = base.withColumn("rank", F.row_number().over(order).cast("long"))
    return U.adaptive_cutoff(base).select("query_id", "rank", "utility", "shown", "reason")


@query(f"""
WITH {_CUT_ROWS} SELECT query_id, l_orderkey, l_linenumber, modality, tier FROM cut WHERE NOT (l_linenumber % 2 = 0 AND modality = 'IMAGE' AND coalesce(tier <> 'BEST', TRUE))
""")
def image_validation(spark, d):
    """Of queries with two components (even line numbers) only whole matches stay among images."""
    li = table(spark, d, "lineitem")
    q = F.pmod("l_orderkey", F.lit(400)).cast("int")
    tier = F.when(q % 4 == 3, None).when(F.col("l_quantity") > 40, "BEST").when(F.col("l_quantity") > 15, "PARTIAL").otherwise("RELATED")
    rows_ = li.select(
        q.alias("query_id"), "l_orderkey", "l_linenumber", F.when(q % 2 == 0, "IMAGE").otherwise("DOCUMENT").alias("modality"), tier.alias("tier"),
        F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(1).alias("components"),
    )
    return U.validated_images(rows_).drop("components")


@query("""
SELECT l_suppkey % 20 AS query_id, l_orderkey AS id, CASE max(CASE WHEN l_quantity > 40 THEN 3 WHEN l_quantity > 15 THEN 2 ELSE 1 END) WHEN 3 THEN 'BEST' WHEN 2 THEN 'PARTIAL' ELSE 'RELATED' END AS tier
FROM lineitem GROUP BY 1, 2
""")
def strongest_tier(spark, d):
    """Tiers that several pivots gave one result; where none did it is related."""
    tier = F.when(F.col("l_quantity") > 40, "BEST").when(F.col("l_quantity") > 15, "PARTIAL")
    return U.strongest_tier(table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("query_id"), F.col("l_orderkey").alias("id"), tier.alias("tier")))


@query(f"""
WITH {expand_sql(5)}, long_ AS (SELECT DISTINCT query_id, unnest(tokens) AS token FROM asked),
hit AS (SELECT token FROM (SELECT DISTINCT token FROM long_ WHERE length(token) >= 4) JOIN vocab ON starts_with(word, token) AND length(word) >= length(token) + 2 GROUP BY token HAVING count(*) >= 2)
SELECT query_id, query_id IN (SELECT query_id FROM long_ JOIN hit USING (token)) AS strong FROM asked
""")
def strong_prefix(spark, d):
    return I.strong_prefix(R.understood(query_set(spark)), I.vocabulary(I.chunks(table(spark, d, "documents"))))
