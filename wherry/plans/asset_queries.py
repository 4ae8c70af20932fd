"""Vocabularies and binary assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks as N
from ..operators import wordpiece as W
from ..operators.codec import vector_bytes
from ..sources import concepts as C
from . import base as B
from .base import query, table

_CLEAN = "trim(regexp_replace(lower(strip_accents(coalesce({}, ''))), '[^a-z0-9]+', ' ', 'g'))"
_LETTERS = "abcdefghijklmnoprstuvwxyz"


@query(f"""
WITH RECURSIVE bw AS (SELECT DISTINCT unnest(string_split({_CLEAN.format("text")}, ' ')) AS w FROM benchmark),
pieces AS (
  SELECT w AS piece FROM bw WHERE w <> '' UNION SELECT '##' || w FROM bw WHERE length(w) BETWEEN 2 AND 4
  UNION SELECT unnest({B.lit(list(_LETTERS))}) UNION SELECT '##' || unnest({B.lit(list(_LETTERS))})
), vocab AS (SELECT piece, 999 + row_number() OVER (ORDER BY piece) AS id FROM pieces),
d AS (SELECT doc_id, string_split({_CLEAN.format("text")}, ' ')[1:126] AS words FROM documents),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pl FROM d),
dw AS (SELECT DISTINCT word FROM e WHERE word <> ''),
s AS (SELECT word, unnest(range(length(word))) AS start FROM dw WHERE length(word) <= 100),
p AS (SELECT word, start, unnest(range(1, length(word) - start + 1)) AS n FROM s),
hit AS (SELECT word, start, max(n) AS n, arg_max(id, n) AS id FROM p JOIN vocab ON piece = CASE WHEN start > 0 THEN '##' ELSE '' END || substring(word, start + 1, n) GROUP BY word, start),
walk AS (
  SELECT word, CAST(0 AS BIGINT) AS pl, CAST([] AS BIGINT[]) AS ids FROM dw
  UNION ALL SELECT w.word, w.pl + h.n, list_append(w.ids, h.id) FROM walk w JOIN hit h ON h.word = w.word AND h.start = w.pl
), seg AS (SELECT dw.word, coalesce(any_value(ids), [100]) AS ids FROM dw LEFT JOIN walk ON walk.word = dw.word AND walk.pl = length(dw.word) GROUP BY dw.word),
t AS (SELECT doc_id, flatten(list(ids ORDER BY pl))[1:126] AS ids FROM e JOIN seg USING (word) GROUP BY doc_id),
f AS (SELECT d.doc_id, list_concat(list_concat([101], coalesce(t.ids, [])), [102]) AS ids FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(list_concat(ids, list_transform(range(128 - len(ids)), lambda x: 0)), ' ') AS input_ids FROM f
""")
def wordpiece_ids(spark, d):
    """Ids of every document by a vocabulary that the benchmark's words and single letters (but q) make up."""
    words_ = table(spark, d, "benchmark").select(F.explode(F.split(W.cleaned(F.col("text")), " ")).alias("w")).where("w <> ''").distinct()
    letters = spark.createDataFrame([(c,) for c in _LETTERS], "w string")
    on = lambda df: df.select(F.concat(F.lit(W.GOES_ON), "w").alias("piece"))
    pieces = words_.select(F.col("w").alias("piece")).unionByName(on(words_.where(F.length("w").between(2, 4)))).unionByName(letters.select(F.col("w").alias("piece"))).unionByName(on(letters))
    vocab = N.ranked(pieces.distinct(), ["piece"], "id").select("piece", (F.col("id") + 999).cast("int").alias("id"))
    out = W.encoded(table(spark, d, "documents"), vocab)
    return out.select("doc_id", "n_ids", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


@query(f"""
WITH e AS (SELECT vec_id, label, embedding, vec_id % 16 AS f, row_number() OVER (PARTITION BY vec_id % 16 ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY vec_id % 16) AS n FROM embeddings)
SELECT 'part' || f AS path, 1 AS version, CAST(place AS INTEGER) AS place, CASE WHEN ok THEN 'c' || vec_id END AS concept_id, CASE WHEN ok THEN 'vector ' || vec_id END AS english,
  CASE WHEN ok THEN {B.lit(list(C.TYPES))}[label % 5 + 1] END AS type, CASE WHEN ok THEN round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) END AS total,
  CASE WHEN NOT ok THEN 'record ' || place || ' is cut off' END AS error
FROM (SELECT *, NOT (f = 3 AND place = n - 1) AS ok FROM e)
""")
def concept_assets(spark, d):
    """Vectors as sixteen assets in the binary form, of which one has lost its last bytes, read back."""
    v = table(spark, d, "embeddings")
    little = lambda c, n: F.unhex(F.reverse(F.regexp_replace(F.lpad(F.hex(c), 2 * n, "0"), "(.)(.)", "$2$1")))
    named = lambda c: F.concat(little(F.octet_length(c), 2), F.encode(c, "utf-8"))
    record = F.concat(
        named(F.concat(F.lit("c"), F.col("vec_id").cast("string"))), named(F.concat(F.lit("vector "), F.col("vec_id").cast("string"))),
        little(F.col("label") % 5, 1), little(F.size("embedding"), 4), vector_bytes(F.col("embedding")),
    )
    rows = v.select((F.col("vec_id") % 16).alias("f"), "vec_id", record.alias("r"))
    files = rows.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("vec_id", "r"))).alias("rs"))
    joined = F.aggregate("rs", F.concat(little(F.lit(1), 4), little(F.size("rs"), 4)), lambda a, x: F.concat(a, x["r"]))
    content = F.when(F.col("f") == 3, F.substring(joined, F.lit(1), F.octet_length(joined) - 10)).otherwise(joined)
    read = C.concepts(files.select(F.concat(F.lit("part"), F.col("f").cast("string")).alias("path"), content.alias("content")))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5)
    return read.select("path", "version", "place", "concept_id", "english", "type", total.alias("total"), "error")
