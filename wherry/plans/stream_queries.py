"""Streaming queries: each drains a source now and returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tableset import TableSet
from ..sources.pages import MailPageStream
from ..streaming import budget as Y
from ..streaming import feeds as X
from .base import query, rows, table


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_file_arrival(spark, d):
    """Files that arrive are appended exactly once, then counted."""
    static = table(spark, d, "events").select("event_id", "event_type", "value")
    source, sink, mark = (X.work_dir(spark, n) for n in ("arrivals", "appended", "mark"))
    static.write.parquet(source)
    X.appended(X.arrivals(spark, source, static.schema), sink, mark).awaitTermination()
    out = spark.read.schema(static.schema).parquet(sink)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_generation_upsert(spark, d):
    """Batches of changes to a table in buckets, of which each batch rewrites those of its keys: the newest event of each user."""
    static = table(spark, d, "events").select("user_id", "event_id", "event_type")
    source, sink, mark = (X.work_dir(spark, n) for n in ("changes", "table", "mark"))
    static.repartition(3).write.parquet(source)
    target = TableSet(spark, sink)
    stream = X.arrivals(spark, source, static.schema, files_per_batch=1)
    work = stream.writeStream.foreachBatch(X.merging(target, "latest", "user_id", ["event_id"])).option("checkpointLocation", mark)
    work.trigger(availableNow=True).start().awaitTermination()
    return target.read("latest").select("user_id", "event_id", "event_type")


@query("""
SELECT 'doc' || doc_id AS message_id, 'thread' || doc_id % 10 AS thread_id, lang AS subject, source AS sender, length(coalesce(text, '')) AS chars, CAST(doc_id AS BIGINT) AS ts FROM documents
""")
def stream_mail_pages(spark, d):
    """Documents as pages of messages, each naming the next: a stream follows them, some pages a batch, and loses and repeats none."""
    docs = table(spark, d, "documents")
    root, state, sink, mark = (X.work_dir(spark, n) for n in ("mailbox", "pages-state", "mails", "mark"))
    pages = max(1, -(-docs.count() // 50))  # about fifty messages a page, by a hash
    b64 = lambda c: F.translate(F.base64(F.encode(c, "utf-8")), "+/\r\n", "-_")
    header = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("value"))
    message = F.struct(
        F.concat(F.lit("doc"), "doc_id").alias("id"), F.concat(F.lit("thread"), F.col("doc_id") % 10).alias("threadId"), F.col("doc_id").cast("string").alias("internalDate"),
        F.struct(
            F.lit("text/plain").alias("mimeType"), F.array(header("Subject", "lang"), header("From", "source")).alias("headers"),
            F.struct(b64(F.coalesce("text", F.lit(""))).alias("data")).alias("body"),
        ).alias("payload"),
    )
    token = (F.pmod(F.xxhash64("doc_id"), F.lit(pages)) + 1).alias("page")
    grouped = docs.select(token, message.alias("m")).groupBy("page").agg(F.collect_list("m").alias("messages"))
    every = spark.range(1, pages + 1).select(F.col("id").alias("page")).join(grouped, "page", "left")
    following = F.when(F.col("page") < pages, (F.col("page") + 1).cast("string"))
    value = F.to_json(F.struct(following.alias("nextPageToken"), F.coalesce("messages", F.array().cast(grouped.schema["messages"].dataType)).alias("messages")))
    # many small folders: tasks put them in their place, not the driver one after the other
    every.select("page", value.alias("value")).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("page").text(f"{root}/someone")
    spark.dataSource.register(MailPageStream)
    options = {"path": root, "account": "someone", "state": state, "page_size": "500", "pages_per_batch": "16", "backlog_pages": "4096"}
    stream = spark.readStream.format("mail_page_stream").options(**options).load()
    work = stream.writeStream.format("parquet").option("checkpointLocation", mark).start(sink)
    try:
        work.processAllAvailable()
    finally:
        work.stop()
    out = spark.read.schema(stream.schema).parquet(sink)
    return out.select("message_id", "thread_id", "subject", "sender", F.length("body").cast("long").alias("chars"), "ts")


class Modelled:
    """Work whose time is a model: a second for each hundred characters, and half or a third of it the next times."""

    def __call__(self, text: str, attempt: int) -> tuple[int, float]:
        return len(text), len(text) / 100 / (attempt + 1)


@query("""
WITH n AS (SELECT doc_id, length(text) AS n FROM documents), a AS (SELECT doc_id, n, CASE WHEN n IS NULL OR n <= 3000 THEN 0 WHEN n <= 6000 THEN 1 ELSE 2 END AS attempt, coalesce(n <= 9000, TRUE) AS ok FROM n)
SELECT doc_id AS id, CAST(attempt AS INTEGER) AS attempt, CASE WHEN ok THEN 'done' ELSE 'failed' END AS status, CASE WHEN ok THEN n END AS value, CASE WHEN NOT ok THEN 'over 30 s' END AS error FROM a
""")
def stream_time_budget(spark, d):
    """Every document under a budget of 30 s of modelled time: what takes longer is postponed, and fails at the third attempt."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("attempt"))
    queue, out, mark = (X.work_dir(spark, n) for n in ("queue", "ends", "mark"))
    docs.write.parquet(f"{queue}/first")
    return Y.drained(spark, queue, out, mark, "id long, text string, attempt int", lambda rows: Y.attempted(rows, Modelled, "long")).select("id", "attempt", "status", "value", "error")


#: What the languages' indexing needs; a stated few.
_NEEDS = (("lang-en", "core"), ("lang-fr", "romance"), ("lang-es", "romance"), ("lang-de", "germanic"), ("romance", "core"), ("germanic", "core"), ("core", "storage"))


#: Batches of 64 that a micro-batch of the stream takes side by side.
_SWEEPS = 2048


@query("""
SELECT doc_id, CASE WHEN lang = 'en' THEN 1 WHEN lang IN ('fr', 'es') THEN 2 END AS sweep, CASE WHEN lang IN ('en', 'fr', 'es') THEN 'INDEXED' ELSE 'PACKAGE_MISSING' END AS state FROM documents
""")
def stream_reconciliation(spark, d):
    """Documents wait for their language's capability: what is released is drained, in batches of 64, when a package comes; the others stay."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("lang-"), "lang").alias("capability"), F.lit("PACKAGE_MISSING").alias("state"))
    needs = rows(spark, _NEEDS, "capability string, needed string")
    packages = ["storage", "core", "lang-en", "lang-fr", "lang-es", "lang-de"]
    done = None
    for sweep, package in ((1, None), (2, "romance")):
        packages += [package] if package else []
        states = Y.capabilities(needs, rows(spark, [(p,) for p in packages], "capability string"))
        waiting = files if done is None else files.join(done, "id", "left_anti")
        free = Y.released(waiting, states).select("id", F.col("capability").alias("text"), F.lit(0).alias("attempt"))
        queue, out, mark = (X.work_dir(spark, n) for n in ("queue", "ends", "mark"))
        # rows are short, and one task would write all the files one after the other
        free.repartition(spark.sparkContext.defaultParallelism, "id").write.option("maxRecordsPerFile", Y.SWEEP).parquet(f"{queue}/first")
        ended = Y.drained(spark, queue, out, mark, "id long, text string, attempt int", lambda b: b.withColumns({"status": F.lit(Y.DONE), "value": F.lit(0), "error": F.lit(None).cast("string")}), _SWEEPS)
        ended = ended.select("id", F.lit(sweep).alias("sweep"))
        done = ended if done is None else done.unionByName(ended)
    state = F.when(F.col("sweep").isNotNull(), "INDEXED").otherwise(F.col("state"))
    return files.join(done, "id", "left").select(F.col("id").alias("doc_id"), "sweep", state.alias("state"))


@query("""
SELECT client_id, change_id, seq, op, segment, city, balance FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) AS r FROM (SELECT DISTINCT client_id, change_id, seq, op, segment, city, balance FROM client_changes)
) WHERE r = 1 AND op <> 'D'
""")
def stream_client_changes(spark, d):
    """Changes of clients as they come, repeated and out of order, into a table in buckets: of each client the last one, and none of those deleted last."""
    static = table(spark, d, "client_changes").select("client_id", "change_id", "seq", "op", "segment", "city", "balance")
    source, sink, mark = (X.work_dir(spark, n) for n in ("changes", "clients", "mark"))
    static.repartition(3).write.parquet(source)
    target = TableSet(spark, sink)
    stream = X.arrivals(spark, source, static.schema, files_per_batch=1)
    work = stream.writeStream.foreachBatch(X.merging(target, "clients", "client_id", ["seq", "change_id"])).option("checkpointLocation", mark)
    work.trigger(availableNow=True).start().awaitTermination()
    # a deletion stays in the table as a mark, so that an older change that comes later does not bring the client back
    return target.read("clients").where("op <> 'D'").select(static.columns)
