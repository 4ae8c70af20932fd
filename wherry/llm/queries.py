"""The training-data operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

import math
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, clustering, decontaminate, exact_dedup, license_scan, line_dedup, ngram_join, pii, row_pattern, sentencepiece_codec, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents")).drop("text_hash", "class_key")


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.wherry.pii.key``; without one, a fresh key links values within this run only."""
    key = spark.conf.get("spark.wherry.pii.key", None)
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), key.encode() if key else secrets.token_bytes(32))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("n_chunks")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_row_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = row_pattern.row_matches(_table(spark, sf_dir, "clicks"))
    return found.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", F.sha2("labels", 256).alias("labels_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.centroid_clusters(_table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_codec.encode(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_ngram_join, op2_warc_segments, op3_toxicity, op4_pii_pseudonyms, op5_license_scan,
        op6_exact_dedup, op7_url_filter, op8_sentencepiece, op9_line_dedup, op10_decontaminate,
        op11_row_pattern, op12_centroids, op13_bpe,
    )
    return {f.__name__: f for f in made}


# ------------------------------------------------------------------ SQL

WARC_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p),
r AS (SELECT *, n >= {warc.MIN_REVISIT_BYTES} AND top IS NOT NULL AND top IS DISTINCT FROM page_id AS again FROM g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN top END AS refers_to, TRUE AS complete
FROM r
"""

EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

_EDGE = r"chr(32) || chr(9) || chr(13) || chr(11) || chr(12)"
LINE_DEDUP_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line FROM documents
), b AS (
  SELECT trim(line, {_EDGE}) AS line FROM l WHERE trim(line, {_EDGE}) <> ''
  GROUP BY 1 HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}
), s AS (SELECT list(line) AS boilerplate FROM b),
d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(boilerplate, []), trim(x, {_EDGE}))) AS kept
  FROM documents CROSS JOIN s
), e AS (
  SELECT *, coalesce(array_to_string(kept, chr(10)), '') AS cleaned FROM d
), f AS (
  SELECT *, len(kept) = len(lines) OR len(list_filter(kept, lambda x: trim(x, {_EDGE}) <> '')) = 0 AS whole FROM e
)
SELECT doc_id, CASE WHEN whole THEN text ELSE cleaned END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_boilerplate,
  CAST(CASE WHEN whole THEN 0 ELSE coalesce(len(lines) - len(kept), 0) END AS BIGINT) AS n_removed
FROM f
"""


def license_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = []
    for label, words in license_scan.template_words(license_scan.TEMPLATES):
        listed = ", ".join(f"'{w}'" for w in words)
        rows.append(f"('{label}', [{listed}])")
    hits = []
    for phrase, label in license_scan.PHRASES:
        words = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
        hits.append(f"SELECT doc_id, i, '{label}' AS label FROM p WHERE {same}")
    return f"""
WITH d AS (SELECT doc_id, {lower} AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{license_scan.WORDS}') AS w FROM d),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w),
b AS ({" UNION ALL ".join(hits)}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY doc_id),
templates(label, words) AS (VALUES {", ".join(rows)}),
lines AS (
  SELECT DISTINCT doc_id, list_distinct(regexp_extract_all(line, '{license_scan.WORDS}')) AS have
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
),
found AS (
  SELECT doc_id, label, len(list_intersect(have, words)) / len(words) AS c FROM lines, templates
  WHERE len(list_intersect(have, words)) >= ceil({license_scan.THRESHOLD} * len(words) - 1e-9)
),
own AS (SELECT doc_id, list(DISTINCT label) AS own, max(c) AS c FROM found GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
  CAST(greatest(CASE WHEN base IS NULL THEN 0.0 ELSE 1.0 END, coalesce(c, 0.0)) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""


def url_sql() -> str:
    """The rules, and the walks as recursion, as many rounds as damping to the tolerance may take."""
    rounds = math.ceil(math.log(url_filter.TOLERANCE) / math.log(url_filter.DAMPING))
    case_rule, case_says = [], []
    for says, name in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        at = name.index("/")
        fits = f"(host = '{name[:at]}' OR suffix(host, '.{name[:at]}')) AND starts_with(path, '{name[at:]}')"
        case_rule.append(f"WHEN {fits} THEN '{name}'")
        case_says.append(f"WHEN {fits} THEN '{says}'")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = url_filter.LINK.replace("'", "''")
    walks = []
    for seed, src, dst in (("t", "src", "dst"), ("d", "dst", "src")):
        walks.append(f"{seed}_e AS (SELECT {src} AS src, {dst} AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY {src}) AS share FROM edges)")
        walks.append(
            f"{seed}_w AS (SELECT 0 AS k, host, CAST({seed} AS DOUBLE) AS mass FROM hosts WHERE {seed} > 0 UNION ALL "
            f"SELECT k + 1, dst, sum(mass * share) * {url_filter.DAMPING}::DOUBLE FROM {seed}_w JOIN {seed}_e ON src = {seed}_w.host "
            f"WHERE k <= {rounds} GROUP BY k, dst)"
        )
        # rounds in which less than the tolerance moved before are not walked
        walks.append(f"{seed}_k AS (SELECT k, sum(mass) AS moving FROM {seed}_w GROUP BY k)")
        walks.append(
            f"{seed}_m AS (SELECT host, round(sum(mass), 9) AS mass FROM {seed}_w WHERE k = 0 OR "
            f"(SELECT moving FROM {seed}_k WHERE {seed}_k.k = {seed}_w.k - 1) > {url_filter.TOLERANCE} * (SELECT moving FROM {seed}_k WHERE k = 0) GROUP BY host)"
        )
    return f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, {lower.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (
  SELECT *, CASE {" ".join(case_rule)} END AS rule, CASE {" ".join(case_says)} END AS ruled FROM u
), hosts AS (
  SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS d
  FROM r WHERE host <> '' GROUP BY host
), edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT host AS src, {lower.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM r WHERE host <> ''
  ) WHERE src <> dst
), {", ".join(walks)}
SELECT page_id, r.host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(d_m.mass, 0) >= {url_filter.MIN_DISTRUST} AND coalesce(d_m.mass, 0) > coalesce(t_m.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(t_m.mass, 0) AS DOUBLE) AS trust, CAST(coalesce(d_m.mass, 0) AS DOUBLE) AS distrust
FROM r LEFT JOIN t_m ON r.host = t_m.host LEFT JOIN d_m ON r.host = d_m.host
"""


_MINUTES_30 = row_pattern.GAP_US
#: All D and U rows in one run after the start belong to (D+ U+)+ as far as its last U, if its first is D.
ROW_PATTERN_SQL = f"""
WITH c AS (
  SELECT client_id, ts, click_id, kind, CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents
  FROM (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)
), n AS (
  SELECT *, row_number() OVER w AS rn, lag(cents) OVER w AS was, epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {_MINUTES_30} AS near
  FROM c WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id)
), l AS (
  SELECT *, CASE WHEN near AND kind <> 'error' AND cents < was THEN 'D' WHEN near AND kind <> 'error' AND cents > was THEN 'U' END AS letter,
    coalesce(near AND was IS NOT NULL AND kind = 'click', FALSE) AS goal FROM n
), r AS (
  SELECT *, sum(CASE WHEN letter IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY rn) AS run FROM l
), runs AS (
  SELECT client_id, run, max(rn) FILTER (letter = 'U') AS last_up, string_agg(coalesce(letter, ''), '' ORDER BY rn) AS letters,
    min(rn) FILTER (letter IS NOT NULL) AS first_on FROM r GROUP BY client_id, run
), s AS (
  SELECT a.client_id, a.rn, a.click_id AS first_id, a.cents, g.last_up, substring(g.letters, CAST(b.rn - g.first_on + 1 AS BIGINT), CAST(g.last_up - b.rn + 1 AS BIGINT)) AS body
  FROM r a JOIN r b ON a.client_id = b.client_id AND b.rn = a.rn + 1 JOIN runs g ON b.client_id = g.client_id AND b.run = g.run
  WHERE a.cents IS NOT NULL AND b.letter = 'D' AND g.last_up > b.rn
), e AS (
  SELECT s.*, coalesce(p.goal AND p.cents >= s.cents, FALSE) AS ends, CASE WHEN ends THEN s.last_up + 1 ELSE s.last_up END AS last_rn
  FROM s LEFT JOIN r p ON s.client_id = p.client_id AND p.rn = s.last_up + 1
), t AS (SELECT client_id, rn, click_id, sum(coalesce(cents, 0)) OVER (PARTITION BY client_id ORDER BY rn) AS total FROM r)
SELECT e.client_id, row_number() OVER (PARTITION BY e.client_id ORDER BY e.rn) AS match_no, e.first_id, z.click_id AS last_id,
  CAST(e.last_rn - e.rn + 1 AS BIGINT) AS n_rows, CAST(z.total - a.total + e.cents AS BIGINT) AS sum_cents,
  sha256('A' || e.body || CASE WHEN e.ends THEN 'P' ELSE '' END) AS labels_sha256
FROM e JOIN t a ON e.client_id = a.client_id AND e.rn = a.rn JOIN t z ON e.client_id = z.client_id AND e.last_rn = z.rn
"""


def centroids_sql() -> str:
    """Every vector against every centroid, round by round."""
    c = clustering
    out = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({c.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
    row_number() OVER (ORDER BY sha256('{c.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec_id) - 1 AS place
  FROM embeddings WHERE len(embedding) = {c.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {c.DIMENSIONS}
), c0 AS (SELECT CAST(place AS INTEGER) AS cluster, v AS c FROM k WHERE place < {c.CENTROIDS})"""
    far = f"list_sum(list_transform(range(1, {c.DIMENSIONS + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    for r in range(c.ROUNDS + 1):
        out += f""",
a{r} AS MATERIALIZED (
  SELECT place, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, CAST(min(d) AS BIGINT) AS distance
  FROM (SELECT place, vec_id, v, cluster, {far} AS d FROM k, c{r}) GROUP BY place
)"""
        if r < c.ROUNDS:
            out += f""",
m{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({c.DIMENSIONS})) AS i FROM a{r}) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(any_value(new), any_value(old)) AS c FROM (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS new, NULL AS old FROM m{r} GROUP BY cluster
    UNION ALL SELECT cluster, NULL, c FROM c{r}
  ) GROUP BY cluster
)"""
    end = c.ROUNDS
    return out + f"""
SELECT vec_id, a{end}.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a{end}.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{end} JOIN c{end} ON a{end}.cluster = c{end}.cluster
"""


def oracle_sql() -> dict[str, str]:
    """Operators that SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "op2_warc_segments": WARC_SQL,
        "op5_license_scan": license_sql(),
        "op6_exact_dedup": EXACT_DEDUP_SQL,
        "op7_url_filter": url_sql(),
        "op9_line_dedup": LINE_DEDUP_SQL,
        "op11_row_pattern": ROW_PATTERN_SQL,
        "op12_centroids": centroids_sql(),
    }
