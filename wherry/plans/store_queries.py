"""Tables kept up to date, categories, languages, extraction, mail."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as I
from ..operators import store as K
from . import base as B
from .base import query, rows, table


@query("SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return K.latest(e, "user_id", ["ts", "event_id"])


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return K.upsert(c, c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


@query("""
SELECT doc_id, chunk_id, part FROM (SELECT doc_id, i * 1000000 + doc_id AS chunk_id, 'p' || i AS part FROM documents, range(2) r(i)) WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 7000000 + doc_id, 'new' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0
""")
def replace_by_document(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    old = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("doc_id", (F.col("i") * 1_000_000 + F.col("doc_id")).alias("chunk_id"), F.concat(F.lit("p"), "i").alias("part"))
    new = docs.where("doc_id % 3 = 0 AND doc_id % 2 = 0").select("doc_id", (F.lit(7_000_000) + F.col("doc_id")).alias("chunk_id"), F.lit("new").alias("part"))
    return K.replaced(old, new, docs.where("doc_id % 3 = 0"), "doc_id")


_DUP = "c AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INTEGER) AS chunk_index, l_orderkey * 10 + l_linenumber AS chunk_id, l_quantity FROM lineitem)"


def _doubled(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).cast("int").alias("chunk_index"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), "l_quantity",
    )


@query(f"WITH {_DUP} SELECT doc_id, chunk_index, min(chunk_id) AS chunk_id FROM c GROUP BY ALL")
def dedup_min_id(spark, d):
    return K.deduplicated(_doubled(spark, d), ["doc_id", "chunk_index"], "chunk_id").drop("l_quantity")


@query(f"""
WITH {_DUP}, k AS (SELECT doc_id, chunk_index, min(chunk_id) AS kept FROM c WHERE doc_id % 7 <> 0 GROUP BY ALL)
SELECT DISTINCT doc_id, chunk_index, coalesce(kept, chunk_id) AS chunk_id, CAST(l_quantity % 5 AS BIGINT) AS token FROM c LEFT JOIN k USING (doc_id, chunk_index)
""")
def legacy_repair(spark, d):
    c = _doubled(spark, d)
    tokens = c.select("doc_id", "chunk_index", "chunk_id", (F.col("l_quantity") % 5).cast("long").alias("token"))
    return K.repointed(tokens, c.where("doc_id % 7 <> 0")).select("doc_id", "chunk_index", "chunk_id", "token")


_FILES = "files AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS generation, CASE WHEN o_orderstatus = 'F' THEN 'PUBLISHED' ELSE 'PENDING' END AS state FROM orders)"


def _files(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3).alias("generation"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("PENDING").alias("state")
    )


@query(f"""
WITH {_FILES}, p AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS chunk_index, l_partkey % 3 AS generation FROM lineitem)
SELECT p.doc_id, p.chunk_index, p.generation FROM p WHERE EXISTS (SELECT 1 FROM files f WHERE f.doc_id = p.doc_id AND f.generation = p.generation AND f.state = 'PUBLISHED')
""")
def generation_visibility(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_partkey") % 3).alias("generation"))
    return K.visible(p, _files(spark, d)).select("doc_id", "chunk_index", "generation")


@query(f"WITH {_FILES} SELECT doc_id, generation, CASE WHEN doc_id % 5 = generation THEN 'PUBLISHED' ELSE state END AS state FROM files")
def generation_publish(spark, d):
    f = _files(spark, d)
    return K.published(f, f.select("doc_id", (F.col("doc_id") % 5).alias("generation")))


@query("SELECT DISTINCT user_id AS id, CASE WHEN bool_or(event_type NOT IN ('click', 'view')) OVER (PARTITION BY user_id) THEN 'delete' ELSE 'upsert' END AS action FROM events")
def change_sets(spark, d):
    kind = F.when(F.col("event_type") == "click", "added").when(F.col("event_type") == "view", "modified").otherwise("deleted")
    return K.change_sets(table(spark, d, "events").select(F.col("user_id").alias("id"), kind.alias("kind")))


@query("""
WITH a AS (SELECT c_custkey % 700 AS id, bool_or(c_mktsegment = 'BUILDING') AS gone FROM customer WHERE c_custkey % 4 = 0 GROUP BY 1)
SELECT c_custkey, c_name FROM customer LEFT JOIN a ON c_custkey = id WHERE id IS NULL
UNION ALL SELECT c_custkey, 'fresh' FROM customer JOIN a ON c_custkey = id WHERE NOT gone
""")
def cdc_apply(spark, d):
    c = table(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "deleted").otherwise("modified")
    changes = c.where("c_custkey % 4 = 0").select((F.col("c_custkey") % 700).alias("id"), kind.alias("kind"))
    old = c.select("c_custkey", "c_name")
    return K.apply_changes(old, changes, old.withColumn("c_name", F.lit("fresh")), "c_custkey")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_size AS modified, CAST(p_partkey * 10 AS BIGINT) AS size FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 6 = 0")
def unchanged_skip(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("path"), F.col("p_size").alias("modified"), (F.col("p_partkey") * 10).cast("long").alias("size"))
    known = p.where("p_partkey % 4 <> 0").withColumn("size", F.when(F.col("p_partkey") % 6 == 0, 1).otherwise(F.col("size")))
    return K.to_index(p.drop("p_partkey"), known)


#: Kinds and names of files, dealt to the rows of a table.
_NAMES = ((0, "IMAGE", "a.jpg"), (1, "EMAIL", "mail"), (2, "PDF", "b.pdf"), (3, "DOCUMENT", "c.docx"), (4, "DOCUMENT", "d.xlsx"), (5, "DOCUMENT", "e.pptx"), (6, "DOCUMENT", "f.txt"), (7, "DOCUMENT", "g.md"), (8, None, "h.HEIC"))
_CATEGORY_SQL = r"""
CASE WHEN upper(trim(coalesce(kind, ''))) = 'EMAIL' THEN 'EMAIL' WHEN upper(trim(coalesce(kind, ''))) = 'IMAGE' OR ext IN ('jpg', 'jpeg', 'png', 'webp', 'gif', 'bmp', 'heic', 'heif') THEN 'IMAGES'
  WHEN upper(trim(coalesce(kind, ''))) = 'PDF' OR ext = 'pdf' THEN 'PDF' WHEN ext IN ('doc', 'docx') THEN 'WORD' WHEN ext IN ('xls', 'xlsx') THEN 'EXCEL' WHEN ext IN ('ppt', 'pptx') THEN 'POWERPOINT'
  WHEN ext = 'txt' THEN 'TEXT' ELSE 'OTHER_DOCUMENTS' END
"""


@query(rf"""
WITH n(i, kind, name) AS (VALUES {B.values(_NAMES)}), f AS (SELECT o_orderstatus, kind, lower(regexp_extract(name, '\.([^./\\]+)$', 1)) AS ext FROM orders JOIN n ON o_orderkey % 9 = i)
SELECT {_CATEGORY_SQL} AS category, count(*) AS n FROM f WHERE o_orderstatus = 'F' GROUP BY 1
""")
def category_counts(spark, d):
    n = rows(spark, _NAMES, "i int, kind string, name string")
    f = table(spark, d, "orders").where("o_orderstatus = 'F'").join(F.broadcast(n), F.col("o_orderkey") % 9 == F.col("i"))
    return f.groupBy(T.category(F.col("kind"), F.col("name")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS pending,
  count(*) FILTER (o_orderpriority LIKE '1%') AS pdfs, count(*) FILTER (o_orderpriority LIKE '2%') AS images, count(*) FILTER (o_custkey % 2 = 0) AS embedded FROM orders
""")
def status_counts(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("PENDING")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "PDF").when(F.col("o_orderpriority").startswith("2"), "IMAGE")
    f = table(spark, d, "orders").select(status.alias("status"), kind.alias("type"), F.when(F.col("o_custkey") % 2 == 0, 1).alias("embedding"))
    return K.status_counts(f)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE o_orderstatus END AS status, CAST(NULL AS BIGINT) AS package_version FROM orders")
def reset_interrupted(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "INDEXING").otherwise(F.col("o_orderstatus")).alias("status"))
    return K.migrated(K.reset_interrupted(o), {"package_version": "long"})


_META = f"""
{B.CHUNK_SQL}, meta AS (
  SELECT d.doc_id, d.lang, any_value(d.source) AS source, count(*) AS chunk_count, CAST(sum(length(chunk_text)) AS BIGINT) AS char_count FROM documents d JOIN chunks USING (doc_id) GROUP BY d.doc_id, d.lang
)
"""
_ROUTE = "CASE WHEN lower(trim(lang)) = 'en' THEN 'identity' " + " ".join(f"WHEN lower(trim(lang)) IN ({', '.join(map(B.lit, tags))}) THEN {B.lit(f)}" for f, tags in I.FAMILIES.items()) + " ELSE 'unsupported' END"


def _meta(spark, d):
    docs = table(spark, d, "documents")
    return I.language_meta(I.chunks(docs), docs)


@query(f"WITH {_META} SELECT lang, {_ROUTE} AS family, count(DISTINCT doc_id) AS docs, CAST(sum(chunk_count) AS BIGINT) AS chunks, CAST(sum(char_count) AS BIGINT) AS chars FROM meta GROUP BY ALL")
def language_summary(spark, d):
    return I.language_summary(_meta(spark, d))


@query(f"""
WITH {_META}, per AS (SELECT source, lang, sum(char_count) AS chars FROM meta GROUP BY ALL)
SELECT source, arg_min(lang, (-chars, lang)) AS dominant, count(*) > 1 AS mixed, array_to_string(list_sort(list(lang)), ',') AS langs FROM per GROUP BY source
""")
def language_profile(spark, d):
    docs = table(spark, d, "documents")
    return I.language_profile(_meta(spark, d).join(docs.select("doc_id", "source"), "doc_id"), "source")


@query("SELECT c_custkey, c_name, c_custkey IN (SELECT o_custkey FROM orders) AS kept FROM customer")
def favourite_flags(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    yes, no = c.join(o, "c_custkey", "left_semi"), c.join(o, "c_custkey", "left_anti")
    return yes.withColumn("kept", F.lit(True)).unionByName(no.withColumn("kept", F.lit(False)))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'cached' ELSE 'computed' END AS way, sha256(coalesce(text, '')) AS hash FROM documents")
def cache_lookup(spark, d):
    """Hashes from a table of earlier ones, computed only where that has none."""
    docs = table(spark, d, "documents")
    cache = docs.where("doc_id % 2 = 0").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("was"))
    out = docs.select("doc_id", "text").join(cache, "doc_id", "left")
    hash_ = F.coalesce("was", F.sha2(F.coalesce("text", F.lit("")), 256))
    return out.select("doc_id", F.when(F.col("was").isNotNull(), "cached").otherwise("computed").alias("way"), hash_.alias("hash"))


# ------------------------------------------------------------------ extraction

_ENT = "replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''')"


@query(f"SELECT page_id, {B.trimmed(f'''regexp_replace({_ENT.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')''')} AS text FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.xml_to_text(F.col("html")).alias("text"))


def _mail_html_sql() -> str:
    x = "html"
    for tag in ("script", "style"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)<br\s*/?>|</p\s*>|</div\s*>|</li\s*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]+>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        x = f"replace({x}, '{a}', '{b}')"
    x = rf"regexp_replace({x}, '[ \t\x0B\f\r]+', ' ', 'g')"
    return B.trimmed(f"regexp_replace({x}, ' *\\n+ *', chr(10), 'g')")


@query(f"SELECT page_id, {_mail_html_sql()} AS text FROM pages")
def mail_html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.mail_html_to_text(F.col("html")).alias("text"))


def _policy_sql() -> str:
    n = T.SAMPLE_CHARS
    return f"""
WITH s AS (SELECT page_id, url, length(html) AS n, lower(substring(html, 1, {n}) || CASE WHEN length(html) > {2 * n} THEN substring(html, CAST(floor(length(html) / 2) AS BIGINT) + 1, {n}) ELSE '' END
  || CASE WHEN length(html) > {n} THEN substring(html, length(html) - {n} + 1, {n}) ELSE '' END) AS x FROM pages),
k AS (SELECT *, list_filter(regexp_split_to_array(x, '\\s+'), lambda t: length(t) >= 3) AS t,
  length(x) - length(replace(replace(x, '<', ''), '>', '')) AS angles, (length(x) - length(replace(x, '</', ''))) / 2 AS closing FROM s),
f AS (SELECT page_id, n >= {T.LARGE_CHARS} AS large_file, list_has_any(string_split(lower(url), '/'), {B.lit(T.GENERATED_FOLDERS)}) AS generated_path,
  contains(x, 'automatically generated') OR contains(x, 'auto-generated') OR contains(x, 'machine generated') OR contains(x, 'generated file') OR (contains(x, 'generated by') AND contains(x, 'do not edit')) AS declaration,
  length(x) >= 1000 AND closing >= 20 AND floor(angles * 100 / length(x)) >= 3 AS markup_heavy,
  length(x) >= 2000 AND len(t) >= 100 AND floor(len(list_filter(t, lambda y: regexp_matches(y, '[/\\\\_=<>]'))) * 100 / len(t)) >= 45 AS low_prose FROM k)
SELECT *, (declaration AND large_file::INT + generated_path::INT + declaration::INT + markup_heavy::INT + low_prose::INT >= 2)
  OR (large_file::INT + generated_path::INT + declaration::INT + markup_heavy::INT + low_prose::INT >= 3 AND large_file AND (markup_heavy OR low_prose)) AS skipped FROM f
"""


@query(_policy_sql())
def index_policy(spark, d):
    s = T.policy_signals(F.col("url"), F.col("html"))
    flat = table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in s.items()])
    return flat.withColumn("skipped", T.policy_skips({n: F.col(n) for n in s}))


_PATHS = (
    (0, "IMAGE", "/storage/emulated/0/DCIM/Camera/dog.jpg"), (1, "IMAGE", "/storage/emulated/0/Pictures/Screenshots/shot.png"),
    (2, "IMAGE", "/storage/emulated/0/WhatsApp/Media/x.jpg"), (3, "PDF", "/storage/emulated/0/Download/a.pdf"), (4, "EMAIL", "x"),
    (5, "PDF", "/a/email_attachment/b.pdf"), (6, "DOCUMENT", "/storage/0/My_Notes/12/c.txt"), (7, None, "plain.txt"), (8, "IMAGE", "C:\\pics\\TikTok-clips\\v.jpg"),
)


def _label_sql() -> str:
    clean = lambda x: f"upper(translate(trim({x}), '_-', '  '))"
    seen = "CASE WHEN contains(x, 'SCREENSHOT') THEN 'SCREENSHOTS' WHEN contains(x, 'WHATSAPP') THEN 'WHATSAPP' WHEN contains(x, 'TIKTOK') THEN 'TIKTOK' END"
    known = "CASE WHEN x = 'DCIM' THEN 'DCIM' WHEN x IN ('DOWNLOAD', 'DOWNLOADS') THEN 'DOWNLOADS' WHEN x IN ('DOCUMENT', 'DOCUMENTS') THEN 'DOCUMENTS' END"
    first = lambda xs, e: f"list_filter(list_transform({xs}, lambda x: {e}), lambda y: y IS NOT NULL)[1]"
    plain = "list_filter(dirs, lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$') AND lower(x) NOT IN ('storage', 'emulated', 'primary', 'media', 'data', 'files'))[1]"
    return f"""
WITH f(id, kind, path) AS (VALUES {B.values(_PATHS)} {"".join("")}), u AS (SELECT * FROM f UNION ALL SELECT CAST(100 + page_id AS INTEGER), 'HTML', url FROM pages),
p AS (SELECT id, kind, lower(replace(path, '\\', '/')) AS low, list_transform(string_split(replace(path, '\\', '/'), '/'), lambda x: {clean("x")}) AS parts FROM u),
r AS (SELECT *, list_reverse(parts[1 : len(parts) - 1]) AS dirs FROM p)
SELECT id, CASE WHEN upper(kind) = 'EMAIL' THEN 'EMAIL' WHEN contains(low, 'email_attachment') OR contains(low, 'email-attachment') THEN 'EMAIL ATTACHMENT'
  ELSE coalesce({first("dirs", seen)}, {first("parts", known)}, {plain}, CASE WHEN trim(coalesce(kind, '')) = '' THEN 'DOCUMENT' ELSE {clean("kind")} END) END AS label FROM r
"""


@query(_label_sql())
def source_label(spark, d):
    pages = table(spark, d, "pages").select((F.col("page_id") + 100).cast("int").alias("id"), F.lit("HTML").alias("kind"), F.col("url").alias("path"))
    f = rows(spark, _PATHS, "id int, kind string, path string").unionByName(pages)
    return f.select("id", T.source_label(F.col("path"), F.col("kind")).alias("label"))


@query(rf"""
SELECT doc_id, array_to_string(list_distinct_ordered, ', ') AS numbers, kind FROM (
  SELECT doc_id, list_filter(m, lambda x, i: list_position(m, x) = i) AS list_distinct_ordered,
    CASE WHEN contains(lower(text), 'invoice') OR contains(lower(text), 'factura') THEN 'invoice' WHEN contains(lower(text), 'identity') OR contains(lower(text), 'identitate') THEN 'identity'
      WHEN contains(lower(text), 'contract') THEN 'contract' ELSE '' END AS kind
  FROM (SELECT doc_id, text, regexp_extract_all(text, '{T.LONG_NUMBER}') AS m FROM documents))
""")
def entity_extract(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.distinct_matches(F.col("text"), T.LONG_NUMBER).alias("numbers"), T.document_type(F.col("text")).alias("kind"))


@query()
def person_names(spark, d):
    """Names in every turn; no SQL, since DuckDB's word boundaries know only ASCII: tests hold it against brute force."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.distinct_matches(F.col("text"), T.PERSON).alias("names"))


_B64 = "rtrim(translate(to_base64(encode({})), '+/', '-_'), '=')"


@query(f"SELECT conv_id, turn, 'email://' || {_B64.format('lower(role)')} || '/' || {_B64.format('CAST(conv_id AS VARCHAR)')} || '/' || {_B64.format('text')} AS mail_id FROM conversations")
def stable_email_id(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", T.stable_mail_id(F.col("role"), F.col("conv_id").cast("string"), F.col("text")).alias("mail_id"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter(list_transform([role, '  ', role || '@x', '', text], lambda x: {B.trimmed('x')}), lambda x: x <> ''), chr(10)) AS text FROM conversations")
def email_index_text(spark, d):
    c = table(spark, d, "conversations")
    out = T.mail_index_text(F.col("role"), F.lit("  "), F.array(F.concat("role", F.lit("@x"))), F.array(F.lit("")), F.col("text"))
    return c.select("conv_id", "turn", out.alias("text"))


@query("SELECT event_id, hex_id, CAST(event_id AS VARCHAR) AS thread FROM (SELECT event_id, lower(hex(event_id)) AS hex_id FROM events)")
def thread_links(spark, d):
    e = table(spark, d, "events").select("event_id", F.lower(F.hex("event_id")).alias("hex_id"))
    return e.withColumn("thread", T.decimal_thread_id(F.col("hex_id")))


@query("SELECT event_id, json_keys(props)[1] AS first_key, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def json_extract(spark, d):
    e = table(spark, d, "events").select("event_id", "props", F.get(F.json_object_keys("props"), F.lit(0)).alias("first_key"))
    return e.select("event_id", "first_key", F.element_at(F.from_json("props", "map<string,string>"), F.col("first_key")).alias("first_value"))


@query("""
WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'EMAIL' ELSE 'PDF' END AS kind FROM orders)
SELECT r.id, r.kind, f.o_custkey, CASE WHEN r.kind = 'EMAIL' THEN m.n END AS n FROM r JOIN orders f ON r.id = f.o_orderkey AND f.o_orderkey % 4 <> 0
LEFT JOIN (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1) m ON r.id = m.id
""")
def result_lookup(spark, d):
    """Results with their file, and mails with their message."""
    o = table(spark, d, "orders")
    results = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "EMAIL").otherwise("PDF").alias("kind"))
    files = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), "o_custkey")
    mails = table(spark, d, "lineitem").where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return K.looked_up(results, files, mails)


@query("SELECT max(event_id) AS mark FROM events WHERE event_id > 100")
def high_water_mark(spark, d):
    """The mark after a poll that had seen a hundred events."""
    return K.since(table(spark, d, "events").select("event_id"), 100, "event_id")[1]


@query("""
SELECT CAST((r - 1) // 50 + 1 AS INTEGER) AS page, client_id, updated_at FROM (
  SELECT *, row_number() OVER (ORDER BY updated_at DESC, client_id) AS r FROM (SELECT DISTINCT client_id, updated_at FROM clients WHERE updated_at IS NOT NULL)
) WHERE r <= 150
""")
def recency_pages(spark, d):
    """Three pages of the clients that were updated last, each from where the page before it ended."""
    rows_ = table(spark, d, "clients").select("client_id", "updated_at").distinct()
    out, after = None, None
    for n in (1, 2, 3):
        page = K.keyset_page(rows_, "updated_at", "client_id", after)
        after = K.last_place(page, "updated_at", "client_id")
        page = page.select(F.lit(n).alias("page"), "client_id", "updated_at")
        out = page if out is None else out.unionByName(page)
        if after is None:
            break
    return out
