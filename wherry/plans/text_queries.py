"""Text, tokens, chunks and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..functions import text as T
from ..functions.barrier import settled
from ..operators import codec as Z
from ..operators import graph as G
from ..operators import index as I
from ..operators import providers as P
from ..operators import search as R
from . import base as B
from .base import query, query_set, rows, table
from .built import stored_index

#: A stated few words that stand for a stop-word list, in the languages of the tables.
STOP_WORDS = ("the", "of", "and", "in", "le", "la", "de", "der", "die", "und", "el", "los", "que")


@query(f"SELECT doc_id, {B.norm('text')} AS norm FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalized(F.col("text")).alias("norm"))


@query(f"WITH {B.CHUNK_SQL} SELECT doc_id, chunk_index, chunk_text, norm FROM chunks")
def chunk_text(spark, d):
    return I.chunks(table(spark, d, "documents"))


@query(f"WITH {B.CHUNK_SQL} SELECT doc_id, chunk_index, length(chunk_text) AS n_chars FROM chunks WHERE chunk_index % 3 = 0")
def chunk_sampling(spark, d):
    rows_ = I.chunks(table(spark, d, "documents")).where(I.embeds(F.col("chunk_index")))
    return rows_.select("doc_id", "chunk_index", F.length("chunk_text").cast("long").alias("n_chars"))


@query(f"""
WITH b AS (SELECT item_id, {B.tokens(B.norm("text"))} AS tokens FROM benchmark),
p AS (SELECT item_id, tokens, unnest(range(len(tokens))) AS i FROM b)
SELECT item_id, CAST(i AS BIGINT) AS pos, tokens[i + 1] AS token, {B.weight("tokens", "i")} AS weight,
  CASE WHEN regexp_matches(tokens[i + 1], '[0-9]') THEN 'IDENTIFIER' WHEN len(tokens) >= 2 AND i = len(tokens) - 1 THEN 'DISCRIMINATOR'
    WHEN length(tokens[i + 1]) <= 2 THEN 'SHORT' WHEN length(tokens[i + 1]) >= 4 THEN 'SPECIFIC' ELSE 'NORMAL' END AS role
FROM p
""")
def tokenize_query(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", T.query_tokens(T.normalized(F.col("text"))).alias("tokens"))
    out = asked.select("item_id", F.posexplode(S.token_weights(F.col("tokens"))).alias("pos", "w"))
    return out.select("item_id", F.col("pos").cast("long").alias("pos"), "w.token", "w.weight", "w.role")


@query(rf"""
WITH {B.CHUNK_SQL}, k AS (SELECT doc_id, chunk_index, regexp_extract_all(lower(chunk_text), '{T.TOKEN}')[1:4096] AS k FROM chunks),
p AS (SELECT doc_id, chunk_index, list_distinct(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS terms FROM k)
SELECT doc_id, chunk_index, len(terms) AS n_terms, array_to_string(list_sort(terms), '|') AS terms FROM p
""")
def canonical_tokens(spark, d):
    chunked = I.chunks(table(spark, d, "documents")).select("doc_id", "chunk_index", "chunk_text")
    out = settled(chunked, t=T.canonical_terms(T.canonical_tokens(F.col("chunk_text"))))
    return out.select("doc_id", "chunk_index", F.size("t").cast("long").alias("n_terms"), F.array_join(F.sort_array("t"), "|").alias("terms"))


_TOKEN_SQL = T.STRUCTURAL_TOKEN.replace("'", "''")
_SPAN_TOKENS = rf"""
b AS (SELECT item_id AS query_id, regexp_extract_all(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '{_TOKEN_SQL}')[1:12] AS k FROM benchmark)
"""
_SPANS = f"""
{_SPAN_TOKENS}, w AS (
  SELECT query_id, k, -99 AS width, 0 AS start, len(k) AS stop FROM b WHERE len(k) > 0
  UNION ALL SELECT query_id, k, -3, s, s + 3 FROM (SELECT query_id, k, unnest(range(len(k) - 2)) AS s FROM b WHERE len(k) > 3)
  UNION ALL SELECT query_id, k, -2, s, s + 2 FROM (SELECT query_id, k, unnest(range(len(k) - 1)) AS s FROM b WHERE len(k) > 2)
  UNION ALL SELECT query_id, k, 0, s, s + 1 FROM (SELECT query_id, k, unnest(range(len(k))) AS s FROM b)
), spans AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY width, start) - 1 AS ord, array_to_string(k[start + 1 : stop], ' ') AS text,
    CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CASE WHEN stop - start = 1 THEN 'ATOMIC' ELSE 'PHRASE' END AS kind,
    width = -99 OR len(k) = 1 AS main
  FROM w
)
"""


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_SPANS} SELECT * FROM spans")
def structural_spans(spark, d):
    return G.spans(_items(spark, d))


@query(f"""
WITH {_SPANS}
SELECT a.query_id, a.ord AS a, b.ord AS b, 'CONTAINS' AS kind FROM spans a JOIN spans b USING (query_id)
WHERE b.ord > 0 AND (a.ord = 0 OR a.kind = 'PHRASE' AND b.kind = 'ATOMIC' AND b.start >= a.start AND b.stop <= a.stop)
UNION ALL SELECT a.query_id, a.ord, b.ord, 'ADJACENT' FROM spans a JOIN spans b USING (query_id)
WHERE a.ord > 0 AND b.ord > 0 AND a.kind = 'ATOMIC' AND b.kind = 'ATOMIC' AND a.stop = b.start
""")
def span_edges(spark, d):
    return G.span_edges(G.spans(_items(spark, d)))


def _interpretations_sql(keep: int = 6) -> str:
    """Greedy groups as a recursive walk: from each place a full phrase of the grid, else a word."""
    return f"""
WITH RECURSIVE {_SPAN_TOKENS},
grid AS (SELECT * FROM (VALUES (0, 3, 0), (1, 3, 1), (2, 3, 2), (3, 2, 0), (4, 2, 1)) g(g, width, phase)),
walk AS (
  SELECT query_id, k, g, width, phase, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS parts, FALSE AS phrase FROM b, grid WHERE len(k) > width
  UNION ALL
  SELECT query_id, k, g, width, phase, place + n, list_append(parts, array_to_string(k[place + 1 : place + n], ' ')), phrase OR n > 1
  FROM (SELECT *, CASE WHEN place >= phase AND (place - phase) % width = 0 AND place + width <= len(k) THEN width ELSE 1 END AS n FROM walk WHERE place < len(k))
),
groups AS (
  SELECT query_id, min(g) AS g, p AS parts FROM (SELECT query_id, g, array_to_string(parts, ' + ') AS p FROM walk WHERE place = len(k) AND phrase) GROUP BY query_id, p
),
made AS (
  SELECT query_id, -1 AS g, 'WHOLE_QUERY' AS kind, array_to_string(k, ' ') AS parts FROM b WHERE len(k) > 0
  UNION ALL SELECT query_id, g, 'PHRASE_GROUP', parts FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g) AS r FROM groups) WHERE r <= {keep}
  UNION ALL SELECT query_id, 99, 'ATOMIC_CONJUNCTION', array_to_string(k, ' + ') FROM b WHERE len(k) > 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY g) - 1 AS ord, kind, parts FROM made
"""


@query(_interpretations_sql())
def interpretations(spark, d):
    return G.interpretations(_items(spark, d))


_WORDS = f"{B.CHUNK_SQL}, w AS (SELECT doc_id, chunk_index, string_split(norm, ' ') AS words FROM chunks)"


@query(f"""
WITH {_WORDS}, p AS (SELECT doc_id, chunk_index, unnest(words) AS token, unnest(range(len(words))) AS pos FROM w)
SELECT token, doc_id, chunk_index, count(*) AS tf, CAST(min(pos) AS BIGINT) AS first_pos FROM p WHERE length(token) >= 2 GROUP BY ALL
""")
def token_postings(spark, d):
    return I.document_postings(table(spark, d, "documents"))


_VOCAB = f"{_WORDS}, vocab AS (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM w) WHERE length(word) >= 3)"



def expand_sql(most: int) -> str:
    return f"""
{_VOCAB}, {B.ASKED_SQL}, tok AS (SELECT DISTINCT token FROM (SELECT unnest(tokens) AS token FROM asked) WHERE length(token) >= 3),
expanded AS (
  SELECT * FROM (SELECT token, word, row_number() OVER (PARTITION BY token ORDER BY length(word), word) AS ord FROM vocab JOIN tok ON starts_with(word, token))
  WHERE ord <= {most}
)
"""


@query(f"WITH {expand_sql(10)} SELECT token, word, CAST(ord AS BIGINT) AS ord FROM expanded")
def vocab_prefix_topk(spark, d):
    asked = R.understood(query_set(spark))
    found = I.expansions(asked.select(F.explode("tokens").alias("token")), I.vocabulary(I.chunks(table(spark, d, "documents"))), used=10)
    return found.select("token", "word", F.col("ord").cast("long").alias("ord"))


def _hash_sql(x: str) -> str:
    text = rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
    # lengths below 256 bytes fit the last of the four length bytes
    part = lambda v: f"unhex(lpad(hex(octet_length(encode({v}))), 8, '0')) || encode({v})"
    return f"substring(sha256({part(B.lit(T.DOMAIN))} || {part(B.lit(T.VERSION))} || {part(text)}), 1, 32)"


_ITEM_TERMS = rf"""
k AS (SELECT item_id, regexp_extract_all(lower(text), '{T.TOKEN}')[1:4096] AS k FROM benchmark),
terms AS (SELECT item_id, unnest(list_distinct(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])))) AS term FROM k)
"""


@query(f"WITH {_ITEM_TERMS} SELECT item_id, term, {_hash_sql('term')} AS hash FROM terms")
def canonical_hash(spark, d):
    out = table(spark, d, "benchmark").select("item_id", F.explode(T.canonical_terms(T.canonical_tokens(F.col("text")))).alias("term"))
    return out.withColumn("hash", T.canonical_hash(F.col("term")))


_LOOKUP = rf"""
{B.CHUNK_SQL}, {B.QUERY_SQL},
qk AS (SELECT query_id, regexp_extract_all(lower(query), '{T.TOKEN}') AS k FROM q),
qt AS (SELECT DISTINCT query_id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM qk),
ck AS (SELECT doc_id, chunk_index, regexp_extract_all(lower(chunk_text), '{T.TOKEN}')[1:4096] AS k FROM chunks),
ct AS (SELECT DISTINCT doc_id, chunk_index, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM ck),
found AS (SELECT query_id, doc_id, chunk_index, count(*) AS matched FROM qt JOIN ct USING (term) GROUP BY ALL)
"""


def _lookup(spark, d, every, limit):
    asked = query_set(spark).select("query_id", F.explode(T.canonical_terms(T.canonical_tokens(F.col("query")))).alias("term"))
    asked = asked.select("query_id", T.canonical_hash(F.col("term")).alias("hash"))
    found = I.ordered_lookup(stored_index(spark, d, "terms").lookup(asked, every), limit)
    return found.select("query_id", "doc_id", "chunk_index", "matched", F.col("ord").cast("long").alias("ord"))


@query(f"""
WITH {_LOOKUP} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id, chunk_index) AS ord FROM found) WHERE ord <= 1000
""")
def postings_or_lookup(spark, d):
    return _lookup(spark, d, False, 1000)


@query(f"""
WITH {_LOOKUP}, n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id)
SELECT query_id, doc_id, chunk_index, matched, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id, chunk_index) AS ord
FROM found JOIN n USING (query_id) WHERE matched = n
""")
def postings_and_lookup(spark, d):
    return _lookup(spark, d, True, None)


@query(f"""
WITH {_WORDS}, {B.ASKED_SQL}, tok AS (SELECT DISTINCT query_id, unnest(tokens) AS token FROM asked)
SELECT query_id, token, count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM tok JOIN w ON list_contains(words, token) GROUP BY ALL
""")
def token_containment(spark, d):
    tok = R.understood(query_set(spark)).select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    found = R.held_tokens(tok, I.chunks(table(spark, d, "documents")))
    return found.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("docs"))


def _asked_words(spark, d):
    asked = R.understood(query_set(spark)).select("query_id", "tokens", "weights")
    chunked = I.chunks(table(spark, d, "documents")).select("doc_id", "chunk_index", T.words(F.col("norm")).alias("words"))
    # any token in common: the queries are a stated set
    return chunked.join(F.broadcast(asked), F.arrays_overlap("words", "tokens"))


_PAIRS = f"WITH {_WORDS}, {B.ASKED_SQL}, pairs AS (SELECT * FROM w, asked WHERE list_has_any(words, tokens)) SELECT query_id, doc_id, chunk_index, "


@query(f"{_PAIRS} round({B.bm25('tokens', 'words')}, 6) AS bm25 FROM pairs")
def bm25_score(spark, d):
    return _asked_words(spark, d).select("query_id", "doc_id", "chunk_index", F.round(S.bm25(F.col("tokens"), F.col("words")), 6).alias("bm25"))


@query(f"{_PAIRS} round({B.coverage('tokens', 'words')}, 6) AS coverage FROM pairs")
def weighted_coverage(spark, d):
    return _asked_words(spark, d).select("query_id", "doc_id", "chunk_index", F.round(S.coverage(F.col("weights"), F.col("words")), 6).alias("coverage"))


@query(f"{_PAIRS} {B.proximity('tokens', 'words')} AS proximity FROM pairs")
def proximity(spark, d):
    return _asked_words(spark, d).select("query_id", "doc_id", "chunk_index", S.proximity(F.col("tokens"), F.col("words")).alias("proximity"))


@query(f"{_PAIRS} {B.in_window('tokens', 'words')} AS together FROM pairs")
def window_containment(spark, d):
    return _asked_words(spark, d).select("query_id", "doc_id", "chunk_index", S.in_window(F.col("tokens"), F.col("words")).alias("together"))


#: What is asked of each turn of the conversations, by the conversation: words of every kind of intent, and one with a lemma.
_ASKED = ("", "invoice ", "photo of ", "pisica and masini ", "pdf photo ")
_ASKED_SQL = "CASE conv_id % 5 " + " ".join(f"WHEN {i} THEN {B.lit(x)}" for i, x in enumerate(_ASKED)) + " END"


def _turns(spark, d):
    c = table(spark, d, "conversations")
    words_ = F.element_at(F.array(*map(F.lit, _ASKED)), (F.pmod("conv_id", F.lit(len(_ASKED))) + 1).cast("int"))
    return c.select(F.struct("conv_id", "turn").alias("query_id"), F.concat(words_, F.coalesce("text", F.lit(""))).alias("query"))


def _has(words) -> str:
    return f"list_has_any(tokens, {B.lit(words)})"


_LEMMA = " ".join(f"WHEN w = {B.lit(a)} THEN {B.lit(b)}" for a, b in T.LEMMAS.items())


@query(f"""
WITH q AS (SELECT conv_id, turn, {_ASKED_SQL} || coalesce(text, '') AS query FROM conversations),
n AS (SELECT conv_id, turn, array_to_string(list_transform(string_split({B.norm("query")}, ' '), lambda w: CASE {_LEMMA} ELSE w END), ' ') AS norm FROM q),
a AS (SELECT conv_id, turn, norm, {B.tokens("norm")} AS tokens FROM n)
SELECT conv_id, turn, norm, {_has(T.DOCUMENT_WORDS)} OR NOT ({_has(T.IMAGE_WORDS)} OR {_has(T.SUBJECT_WORDS)}) AS document_intent,
  {_has(T.IMAGE_WORDS)} OR {_has(T.SUBJECT_WORDS)} OR NOT {_has(T.DOCUMENT_WORDS)} AS image_intent FROM a WHERE len(tokens) > 0
""")
def query_intent(spark, d):
    """What every turn of the conversations asks for."""
    return R.understood(_turns(spark, d)).select("query_id.conv_id", "query_id.turn", "norm", "document_intent", "image_intent")


@query(rf"""
WITH q AS (SELECT conv_id, turn, {_ASKED_SQL} || coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN '  FACTURA' ELSE '' END AS query FROM conversations),
k AS (SELECT conv_id, turn, string_split(trim(regexp_replace(lower(query), '\s+', ' ', 'g')), ' ') AS k FROM q),
p AS (SELECT conv_id, turn, k, unnest(range(len(k))) AS i FROM k), o(f, t) AS (VALUES ('invoice', 'factura'), ('factura', 'invoice'))
SELECT conv_id, turn, array_to_string(list_concat(list_append(k[1:i], t), k[i + 2:]), ' ') AS expansion FROM p JOIN o ON k[i + 1] = f GROUP BY ALL
""")
def alias_expansion(spark, d):
    """Every turn with each place of an alias replaced by its other side."""
    query_ = F.concat("query", F.when(F.col("query_id.turn") % 2 == 0, "  FACTURA").otherwise(""))
    return _turns(spark, d).select("query_id.conv_id", "query_id.turn", F.explode(T.alias_expansions(query_)).alias("expansion"))


@query(f"""
WITH w AS (SELECT doc_id, string_split({B.norm("text")}, ' ') AS words FROM documents)
SELECT doc_id, len(list_filter(words, lambda x: NOT list_contains({B.lit(STOP_WORDS)}, x))) AS kept, len(words) AS n FROM w
""")
def stop_word_filter(spark, d):
    out = table(spark, d, "documents").select("doc_id", T.words(T.normalized(F.col("text"))).alias("w"))
    kept = F.size(F.filter("w", lambda x: ~x.isin(*STOP_WORDS)))
    return out.select("doc_id", kept.cast("long").alias("kept"), F.size("w").cast("long").alias("n"))


@query("""
SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'thon') OR contains(lower(source), 'thon')
""")
def substring_search(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(F.lower("text").contains("thon") | F.lower("source").contains("thon")).select("doc_id", "lang", "source")


@query(f"WITH {_WORDS} SELECT doc_id, chunk_index FROM w WHERE len(list_filter(words, lambda x: starts_with(x, 'thon'))) > 0")
def prefix_scan(spark, d):
    chunked = I.chunks(table(spark, d, "documents"))
    return chunked.where(F.exists(T.words(F.col("norm")), lambda x: x.startswith("thon"))).select("doc_id", "chunk_index")


@query(r"""
SELECT doc_id, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9ăâîșțĂÂÎȘȚ\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
  lambda w: length(w) >= 2), lambda w: lower(w)), ' ') AS text FROM documents
""")
def ocr_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ocr_normalized(F.col("text")).alias("text"))


@query(f"""
WITH {_ITEM_TERMS}, concepts AS (SELECT p_partkey AS id, lower(regexp_extract(p_name, '[A-Za-z]+')) AS token FROM part),
known AS (SELECT token, min(id) AS first_id, max(id) AS last_id FROM concepts GROUP BY token)
SELECT token, first_id, last_id FROM known WHERE token <> ''
""")
def token_concept_lookup(spark, d):
    """Of the concepts that share a token the first (graph) and the last (repository)."""
    concepts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.regexp_extract("p_name", "[A-Za-z]+", 0)).alias("token"))
    return concepts.where("token <> ''").groupBy("token").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("""
SELECT * FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 50
""")
def recency_page(spark, d):
    """The newest rows first, a page of 50 (a top-k report: TakeOrderedAndProject, then ranks of 50 rows)."""
    page = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long"))


@query(f"""
WITH {_LOOKUP.replace("ct AS (SELECT DISTINCT doc_id, chunk_index, unnest(", "ct AS (SELECT doc_id, chunk_index, unnest(").replace("count(*) AS matched", "count(DISTINCT term) AS matched, count(*) AS tf")}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, tf DESC, doc_id, chunk_index) AS ord FROM found WHERE doc_id % 4 <> 0) WHERE ord <= 1000
""")
def published_lookup(spark, d):
    """The ranked lookup through published files: here all but every fourth document."""
    docs = table(spark, d, "documents")
    files = docs.select("doc_id", F.when(F.col("doc_id") % 4 != 0, "PUBLISHED").otherwise("PENDING").alias("state"))
    asked = query_set(spark).select("query_id", F.explode(T.canonical_terms(T.canonical_tokens(F.col("query")))).alias("term"))
    found = I.published_lookup(asked.select("query_id", T.canonical_hash(F.col("term")).alias("hash")), I.counted_postings(I.chunks(docs), asked), files)
    return found.select("query_id", "doc_id", "chunk_index", "matched", "tf", F.col("ord").cast("long").alias("ord"))


def _item_postings(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"))
    return I.counted_postings(items)


@query(f"WITH {_ITEM_TERMS} SELECT {_hash_sql('term')} AS hash, count(*) AS n FROM terms WHERE item_id % 3 <> 0 GROUP BY 1")
def canonical_delete(spark, d):
    """Postings that stay when every third item is deleted; terms of deleted items alone are gone."""
    gone = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")).where("doc_id % 3 = 0")
    return I.without_documents(_item_postings(spark, d), gone).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_ITEM_TERMS}, every AS (SELECT item_id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM k)
SELECT {_hash_sql('term')} AS hash, 'item/' || item_id AS path, 0 AS chunk_index, CAST(count(*) AS INTEGER) AS tf, CAST(item_id % 8 AS INTEGER) AS flags FROM every GROUP BY item_id, term
""")
def posting_codec(spark, d):
    """Postings packed into blocks and read back."""
    p = _item_postings(spark, d).select(
        "hash", F.concat(F.lit("item/"), "doc_id").alias("path"), "chunk_index", F.col("tf").cast("int").alias("tf"), (F.col("doc_id") % 8).cast("int").alias("flags")
    )
    return Z.postings_of(Z.posting_blocks(p, rows=16))


@query("SELECT vec_id, 4 * len(embedding) AS n_bytes, TRUE AS same FROM embeddings")
def vector_codec(spark, d):
    """Vectors as blobs of 32-bit floats, and back."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", Z.vector_bytes(F.col("embedding")).alias("data"))
    return v.select("vec_id", F.octet_length("data").cast("long").alias("n_bytes"), (Z.vector_of(F.col("data")) == F.col("embedding").cast("array<float>")).alias("same"))


@query("""
SELECT item_id, length(text) AS chars, length(text) - length(replace(text, ' ', '')) AS blanks, length(text) - length(replace(text, 'a', '')) AS a,
  length(text) - length(replace(text, 'e', '')) AS e, length(text) - length(replace(text, 't', '')) AS t, CAST(NULL AS VARCHAR) AS error FROM benchmark
""")
def provider_vectors(spark, d):
    """Vectors of a provider (here the deterministic stand-in) for every item."""
    out = P.provided(table(spark, d, "benchmark").select("item_id", "text"), P.ShapeEncoder, "array<double>")
    return out.select("item_id", *[F.get("value", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("chars", "blanks", "a", "e", "t"))], "error")


@query(f"""
WITH {B.CHUNK_SQL}, l AS (SELECT doc_id, chunk_index, {B.trimmed("translate(chunk_text, chr(10) || chr(13), '  ')")} AS t FROM chunks)
SELECT doc_id, chunk_index, CASE WHEN length(t) > 220 THEN substring(t, 1, 220) || '...' ELSE t END AS snippet FROM l
""")
def fallback_snippet(spark, d):
    return I.chunks(table(spark, d, "documents")).select("doc_id", "chunk_index", T.fallback_snippet(F.col("chunk_text")).alias("snippet"))
