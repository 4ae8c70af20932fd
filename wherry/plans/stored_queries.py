"""Queries against a stored index, which is built once for the tables of a folder, and tables that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hybrid as H
from ..operators import search as R
from ..operators import similar as V
from ..operators import stored as D
from ..operators.providers import LetterEncoder, provided
from ..operators.tableset import TableSet
from ..streaming.feeds import work_dir
from . import base as B
from .base import query, query_set, rows, table
from .built import stored_index
from .search_queries import SEARCH_SQL
from .text_queries import _LOOKUP, _WORDS

@query(f"WITH {SEARCH_SQL} SELECT * FROM result")
def search_unindexed(spark, d):
    """The same search over documents that no index has: they are cut and normalised on the way."""
    return R.search(query_set(spark), table(spark, d, "documents"))


@query(B.SQL["hybrid_search_expanded"])
def search_unindexed_expanded(spark, d):
    return R.search(query_set(spark), table(spark, d, "documents"), expand=True)


_COUNTED = _LOOKUP.replace("ct AS (SELECT DISTINCT doc_id, chunk_index, unnest(", "ct AS (SELECT doc_id, chunk_index, unnest(").replace(
    "count(*) AS matched", "count(DISTINCT term) AS matched, count(*) AS tf"
)


def _hashes(queries: DataFrame) -> DataFrame:
    terms = queries.select("query_id", F.explode(T.canonical_terms(T.canonical_tokens(F.col("query")))).alias("term"))
    return terms.select("query_id", T.hash_of(F.col("term")).alias("hash"))


@query(f"WITH {_COUNTED} SELECT query_id, doc_id, chunk_index, matched, CAST(tf AS BIGINT) AS tf FROM found")
def postings_stored(spark, d):
    """Every chunk with a term of each query, from the buckets of the asked hashes."""
    return stored_index(spark, d, "terms").lookup(_hashes(query_set(spark)))


@query(f"""
WITH {_COUNTED}, n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id)
SELECT query_id, doc_id, chunk_index, matched, CAST(tf AS BIGINT) AS tf FROM found JOIN n USING (query_id) WHERE matched = n
""")
def postings_stored_every(spark, d):
    return stored_index(spark, d, "terms").lookup(_hashes(query_set(spark)), every=True)


_PREFIXES = ((1, "thon"), (2, "ea"), (3, "the"), (4, "q"))


@query(f"""
WITH {_WORDS}, p(query_id, token) AS (VALUES {B.values(_PREFIXES)})
SELECT query_id, doc_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, chunk_index) AS ord
FROM w JOIN p ON len(list_filter(words, lambda x: length(x) >= 2 AND starts_with(x, token))) > 0
""")
def prefix_stored(spark, d):
    """Chunks with a token that starts with each prefix, from the prefix's bucket."""
    return stored_index(spark, d).with_prefix(rows(spark, _PREFIXES, "query_id int, token string"))


_MERGED = _COUNTED.replace("FROM documents", "FROM merged")
_MERGED_DOCS = """
merged AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'with this that from ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0
)
"""


@query(f"WITH {_MERGED_DOCS}, {_MERGED} SELECT query_id, doc_id, chunk_index, matched, CAST(tf AS BIGINT) AS tf FROM found")
def index_merge(spark, d):
    """A batch of changed and deleted documents is merged into an index of all, and comes a second time."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = D.StoredIndex(spark, work_dir(spark, "merged"), postings=("terms",), texts=False)  # all that is asked
    index.add(docs, batch=0)
    changed = docs.where("doc_id % 7 = 0 AND doc_id % 11 <> 0").withColumn("text", F.concat(F.lit("with this that from "), F.coalesce("text", F.lit(""))))
    gone = docs.where("doc_id % 11 = 0").select("doc_id")
    for _ in range(2):
        index.add(changed, batch=1, gone=gone)
    return index.lookup(_hashes(query_set(spark)))


# ------------------------------------------------------------------ both classes of candidates

#: The stated queries, with hypotheses of their canonical search, as a translator would give them.
_HYBRID = (
    (1, "with this", ("dans les", "with this")), (2, "thre tion", ("der die und",)), (3, "that from", ()), (4, "The", ("los que", "The")), (5, "er thon on", ("une est",)), (6, "in the that", ("el en",)),
)

_NAME_SQL = "source || CASE lang WHEN 'en' THEN '.pdf' WHEN 'de' THEN '.docx' WHEN 'fr' THEN '.jpg' ELSE '.txt' END"
_LETTERS = "list_transform(range(97, 123), lambda c: CAST(length({0}) - length(replace({0}, chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"


@query(f"""
WITH {_WORDS}, q(query_id, query, hyps) AS (VALUES {B.values([(i, t, list(h) or [t]) for i, t, h in _HYBRID])}),
asked AS (SELECT query_id, query, {B.norm("query")} AS norm, {B.tokens(B.norm("query"))} AS tokens FROM q),
h0 AS (SELECT query_id, unnest(hyps) AS text, unnest(range(len(hyps))) AS h FROM q),
h1 AS (SELECT query_id, h, regexp_extract_all(lower(text), '{T.TOKEN}') AS k FROM h0),
h2 AS (SELECT query_id, h, list_distinct(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS terms FROM h1),
ht AS (SELECT query_id, h, len(terms) AS n, unnest(terms) AS term FROM h2),
ck AS (SELECT doc_id, chunk_index, regexp_extract_all(lower(chunk_text), '{T.TOKEN}')[1:4096] AS k FROM chunks),
ct AS (SELECT DISTINCT doc_id, chunk_index, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM ck),
hm AS (SELECT query_id, h, doc_id, chunk_index, count(*) / any_value(n)::DOUBLE AS share FROM ht JOIN ct USING (term) GROUP BY query_id, h, doc_id, chunk_index),
can AS (SELECT query_id, doc_id, chunk_index, least(1.0::DOUBLE, max(share)) AS canonical FROM hm GROUP BY query_id, doc_id, chunk_index),
pairs AS (
  SELECT a.query_id, a.norm AS qnorm, tokens, w.doc_id, w.chunk_index, words, c.norm AS cnorm, canonical, list_has_any(words, tokens) AS lex
  FROM w JOIN chunks c USING (doc_id, chunk_index), asked a LEFT JOIN can ON can.query_id = a.query_id AND can.doc_id = w.doc_id AND can.chunk_index = w.chunk_index
), picked AS (
  SELECT *, CASE WHEN NOT lex THEN 'canonical' WHEN canonical IS NULL THEN 'lexical' ELSE 'both' END AS provenance FROM pairs
  WHERE CASE WHEN lex THEN list_has_all(words, tokens) AND {B.in_window("tokens", "words")} ELSE canonical IS NOT NULL END
), sig AS (
  SELECT query_id, tokens, doc_id, chunk_index, provenance, {B.proximity("tokens", "words")} AS prox,
    CASE WHEN lex THEN {B.bm25("tokens", "words")} ELSE 0.0::DOUBLE END AS bm25, CASE WHEN lex THEN 1.0::DOUBLE ELSE canonical END AS coverage,
    0.8 * len(list_filter(list_distinct(tokens), lambda t: len(list_filter(words, lambda w: starts_with(w, t))) > 0)) AS boost,
    {_LETTERS.format("qnorm")} AS qv, {_LETTERS.format("cnorm")} AS cv FROM picked
), sem AS (
  SELECT s.*, CASE WHEN chunk_index % 3 = 0 THEN CASE WHEN list_sum(cv) = 0 OR list_sum(qv) = 0 THEN 0.0::DOUBLE ELSE {B.cosine("qv", "cv")} END END AS semantic,
    CASE WHEN lang IN ('en', 'de') AND source IS NOT NULL THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN lang = 'fr' AND source IS NOT NULL THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN lang = 'es' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS meta
  FROM sig s JOIN documents USING (doc_id) WHERE provenance = 'canonical' OR bm25 > 0
), based AS (
  SELECT *, round(bm25 * 2.8::DOUBLE + coalesce(semantic, 0.0) * 0.55::DOUBLE + boost + meta + prox + coverage * 2.5::DOUBLE + CASE WHEN bm25 > 2.0 THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END, 6) AS base FROM sem
), scored AS (
  SELECT *, round(base + CASE WHEN provenance = 'canonical' THEN 0.0 ELSE 5.0 + CASE WHEN prox >= 2.0 THEN 6.0 ELSE 0.0 END END, 6) AS score
  FROM based WHERE base >= CASE WHEN len(tokens) = 1 THEN 0.65 ELSE 1.10 END
), ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_index) AS r FROM scored),
rolled AS (
  SELECT query_id, doc_id, any_value(tokens) AS tokens, round(max(score) + 0.5 * least(count(*), 5), 6) AS score, count(*) AS hits, bool_and(provenance = 'canonical') AS canonical_only,
    bool_or(semantic IS NOT NULL) AS semantic_available, max(chunk_index) FILTER (r = 1) AS chunk_index, max(provenance) FILTER (r = 1) AS provenance,
    max(bm25) FILTER (r = 1) AS bm25, max(coverage) FILTER (r = 1) AS coverage, max(semantic) FILTER (r = 1) AS semantic FROM ordered GROUP BY query_id, doc_id
), topped AS (SELECT *, max(score) OVER (PARTITION BY query_id, canonical_only) AS top FROM rolled),
near AS (
  SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, canonical_only ORDER BY score DESC, doc_id) AS r FROM topped
  WHERE score >= round(top * CASE WHEN canonical_only THEN 0.70::DOUBLE WHEN len(tokens) = 1 AND length(tokens[1]) <= 4 THEN 0.70::DOUBLE ELSE 0.80::DOUBLE END, 6)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score, hits, CAST(chunk_index AS BIGINT) AS chunk_index, provenance, canonical_only,
  semantic_available, round(bm25, 6) AS bm25, round(coverage, 6) AS coverage, semantic FROM near WHERE n <= 10 OR r <= 10
""")
def hybrid_search_full(spark, d):
    """Both classes of candidates in one score; names and paths are made from language and source, vectors by the stand-in encoder."""
    queries = rows(spark, _HYBRID, "query_id int, query string, hypotheses array<string>")
    ext = F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "de", ".docx").when(F.col("lang") == "fr", ".jpg").otherwise(".txt")
    path = F.when(F.col("lang") == "es", "/documents").otherwise("/archive")
    names = table(spark, d, "documents").select("doc_id", F.concat("source", ext).alias("name"), path.alias("path"))
    normal = queries.select("query_id", T.normalized(F.col("query")).alias("norm"))
    embedded = provided(normal, LetterEncoder, "array<double>", "norm", "embedding")
    return H.hybrid_search(queries, stored_index(spark, d, embedded=True), names, embedded)


# ------------------------------------------------------------------ tables that change together


@query("""
WITH m AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'Re: ' || coalesce(text, '') ELSE coalesce(text, '') END AS body FROM documents WHERE doc_id % 13 <> 0),
c AS (SELECT doc_id, unnest(range(greatest(CAST(ceil(length(body) / 800.0) AS BIGINT), 1))) AS i, body FROM m)
SELECT 'mails' AS name, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM m
UNION ALL SELECT 'files', count(*), CAST(sum(length(coalesce(source, ''))) AS BIGINT) FROM m
UNION ALL SELECT 'chunks', count(*), CAST(sum(length(substring(body, i * 800 + 1, 800))) AS BIGINT) FROM c
UNION ALL SELECT 'tokens', count(*), CAST(sum(length(t)) AS BIGINT) FROM (SELECT DISTINCT doc_id, unnest(string_split(body, ' ')) AS t FROM m)
""")
def mail_cascade(spark, d):
    """Mails with their files, chunks and tokens: all are put in, some replaced and some deleted in four tables by one version, which comes twice."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("body"))

    def four(m: DataFrame) -> dict[str, DataFrame]:
        n = F.greatest(F.ceil(F.length("body") / 800).cast("int"), F.lit(1))
        chunks = m.select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "body").select("doc_id", "i", F.substr("body", F.col("i") * 800 + 1, F.lit(800)).alias("text"))
        return {"mails": m.select("doc_id", "body"), "files": m.select("doc_id", "source"), "chunks": chunks, "tokens": m.select("doc_id", F.explode(F.split("body", " ")).alias("token")).distinct()}

    tables = TableSet(spark, work_dir(spark, "mails"))
    tables.cascade(four(docs), docs, "doc_id", batch=0)
    changed = docs.where("doc_id % 5 = 0 AND doc_id % 13 <> 0").withColumn("body", F.concat(F.lit("Re: "), "body"))
    keys = docs.where("doc_id % 5 = 0 OR doc_id % 13 = 0").select("doc_id")
    for _ in range(2):
        tables.cascade(four(changed), keys, "doc_id", batch=1)
    m = tables.manifest()
    length = {"mails": "body", "files": "source", "chunks": "text", "tokens": "token"}
    one = lambda n: tables.read(n, manifest=m).select(F.lit(n).alias("name"), F.length(F.coalesce(length[n], F.lit(""))).cast("long").alias("k"))
    out = one("mails").unionByName(one("files")).unionByName(one("chunks")).unionByName(one("tokens"))
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("chars"))


# ------------------------------------------------------------------ words that mean the same

_GRAMS = """
{0}g AS (SELECT {1}, unnest(list_transform(range(1, length({1}) + 1), lambda i: substring('^' || {1} || '$', i, 3))) AS dim FROM {0}),
{0}c AS (SELECT {1}, dim, CAST(count(*) AS DOUBLE) AS weight FROM {0}g GROUP BY {1}, dim),
{0}n AS (SELECT {1}, sqrt(sum(weight * weight)) AS n FROM {0}c GROUP BY {1})
"""
_SIMILAR = f"""
{_WORDS}, vocab AS (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM w) WHERE length(word) >= 3),
asked AS (SELECT DISTINCT token FROM (SELECT unnest({B.tokens(B.norm("text"))}) AS token FROM benchmark) WHERE length(token) >= 3),
{_GRAMS.format("asked", "token")}, {_GRAMS.format("vocab", "word")},
similar_ AS (
  SELECT token, word, round(any_value(dot) / (any_value(a.n) * any_value(b.n)), 6) AS similarity
  FROM (SELECT token, word, sum(x.weight * y.weight) AS dot FROM askedc x JOIN vocabc y USING (dim) GROUP BY token, word) JOIN askedn a USING (token) JOIN vocabn b USING (word) GROUP BY token, word
), pairs AS (SELECT * FROM similar_ WHERE similarity >= 0.82)
"""


def _similar(spark, d):
    """Words of the benchmark's items against the index's words."""
    asked = table(spark, d, "benchmark").select(F.explode(T.query_tokens(T.normalized(F.col("text")))).alias("token")).where(F.length("token") >= V.MIN_CHARS).distinct()
    vocab = stored_index(spark, d).words().where(F.length("word") >= V.MIN_CHARS)
    return V.similarity_join(asked.withColumn("vector", V.character_grams(F.col("token"))), vocab.withColumn("vector", V.character_grams(F.col("word"))))


@query(f"WITH {_SIMILAR} SELECT token, word, similarity FROM pairs")
def semantic_tokens(spark, d):
    """Every word that is near a word of the benchmark, by a cosine join."""
    return _similar(spark, d)


@query(f"""
WITH {_SIMILAR}, hit AS (SELECT DISTINCT doc_id, chunk_index, word FROM (SELECT doc_id, chunk_index, unnest(words) AS word FROM w)),
ranked AS (SELECT token, doc_id, chunk_index, word, similarity, row_number() OVER (PARTITION BY token, doc_id, chunk_index ORDER BY similarity DESC, word) AS r FROM hit JOIN pairs USING (word))
SELECT token, count(*) AS chunks, count(*) FILTER (word <> token) AS by_meaning, CAST(sum(CAST(round(similarity * 1.4::DOUBLE * 1000000) AS BIGINT)) AS BIGINT) AS millionths FROM ranked WHERE r = 1 GROUP BY token
""")
def semantic_token_match(spark, d):
    """Of each benchmark word: the chunks with a word near it, those where that is another word, and what the matches count in all (whole millionths, whose sum has no order)."""
    index = stored_index(spark, d)
    found = V.best_listed(index.written(_similar(spark, d)), index.lists())
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("word") != F.col("token")).alias("by_meaning"), F.sum(F.round(F.col("score") * 1000000).cast("long")).alias("millionths"))
