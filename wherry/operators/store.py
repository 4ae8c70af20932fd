"""Incremental maintenance of tables: upserts, deletes, generations, repairs, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by ``order``: a partial aggregate, not a window sort."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return changes.groupBy(*keys).agg(last).select(*keys, "__last.*").select(changes.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def replaced(table: DataFrame, rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows of ``keys`` go, ``rows`` come: replace by document, or delete if there are none."""
    return table.join(keys.select(key).distinct(), key, "left_anti").unionByName(rows)


def deduplicated(table: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The row with the smallest id of each combination of keys."""
    return latest(table.withColumn("__neg", -F.col(id_col)), keys, ["__neg"]).drop("__neg")


def repointed(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Token rows that point at the chunk kept for their document and place; strays stay as they are."""
    kept = chunks.groupBy("doc_id", "chunk_index").agg(F.min("chunk_id").alias("kept"))
    rows = tokens.join(kept, ["doc_id", "chunk_index"], "left")
    return rows.withColumn("chunk_id", F.coalesce("kept", "chunk_id")).drop("kept").distinct()


def visible(postings: DataFrame, files: DataFrame) -> DataFrame:
    """Postings of files that are published, of the file's present generation."""
    current = files.where(F.col("state") == "PUBLISHED").select("doc_id", "generation")
    return postings.join(current, ["doc_id", "generation"], "left_semi")


def published(files: DataFrame, commits: DataFrame) -> DataFrame:
    """Files after commits: a commit of the present generation publishes, a stale one is discarded."""
    done = commits.select("doc_id", "generation").distinct().withColumn("__ok", F.lit(True))
    rows = files.join(done, ["doc_id", "generation"], "left")
    return rows.withColumn("state", F.when(F.col("__ok"), "PUBLISHED").otherwise(F.col("state"))).drop("__ok").select(files.columns)


def change_sets(changes: DataFrame) -> DataFrame:
    """id, action of a page of changes: (added + modified) - deleted are upserts, deleted are deletes."""
    flags = changes.groupBy("id").agg(
        F.max((F.col("kind") == "deleted").cast("int")).alias("gone"), F.max(F.col("kind").isin("added", "modified").cast("int")).alias("came")
    )
    return flags.where("gone = 1 OR came = 1").select("id", F.when(F.col("gone") == 1, "delete").otherwise("upsert").alias("action"))


def apply_changes(table: DataFrame, changes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Deletes first, then upserts of ``rows`` whose action says so."""
    sets = change_sets(changes).withColumnRenamed("id", key)
    stay = table.join(sets, key, "left_anti")
    return stay.unionByName(rows.join(sets.where("action = 'upsert'").select(key), key, "left_semi"))


def to_index(listing: DataFrame, table: DataFrame) -> DataFrame:
    """Listed files that the table lacks or has with another time or size."""
    same = [listing["path"] == table["path"], listing["modified"] == table["modified"], listing["size"] == table["size"]]
    return listing.join(table, same, "left_anti")


def reset_interrupted(files: DataFrame) -> DataFrame:
    return files.withColumn("status", F.when(F.col("status") == "INDEXING", "PENDING").otherwise(F.col("status")))


def status_counts(files: DataFrame) -> DataFrame:
    """One row of counts by status and type: one pass, no shuffle but of the partial counts."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return files.agg(
        F.count(F.lit(1)).alias("total"), is_("status", "DONE").alias("done"), is_("status", "FAILED").alias("failed"),
        is_("status", "PENDING").alias("pending"), is_("type", "PDF").alias("pdfs"), is_("type", "IMAGE").alias("images"),
        F.count("embedding").alias("embedded"),
    )


def looked_up(results: DataFrame, files: DataFrame, mails: DataFrame) -> DataFrame:
    """Results whose file is known, with its columns, and of mails those of the message (null for other kinds)."""
    found = results.join(files, "id")
    mail = mails.withColumnRenamed("id", "__mail")
    return found.join(mail, (found["id"] == mail["__mail"]) & (F.upper("kind") == "EMAIL"), "left").drop("__mail")


def since(listing: DataFrame, mark, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows beyond a high-water mark (all of them for none), and a row with the new mark."""
    new = listing.where(F.col(order) > F.lit(mark)) if mark is not None else listing
    return new, new.agg(F.coalesce(F.max(order), F.lit(mark)).alias("mark"))


def migrated(old: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``old`` with the columns that a newer schema adds, null."""
    return old.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in old.columns})


def keyset_page(rows: DataFrame, time: str, key: str, after: tuple | None = None, size: int = 50) -> DataFrame:
    """The newest ``size`` rows after a place (time and key of the last row seen; none for the first page), newest first, ties by key; rows without a time are on no page."""
    left = rows.where(F.col(time).isNotNull())
    if after is not None:
        left = left.where((F.col(time) < F.lit(after[0])) | ((F.col(time) == F.lit(after[0])) & (F.col(key) > F.lit(after[1]))))
    return left.orderBy(F.desc(time), key).limit(size)


def last_place(page: DataFrame, time: str, key: str) -> tuple | None:
    """Where a page ends; none for an empty one."""
    row = page.orderBy(time, F.desc(key)).select(time, key).first()
    return (row[0], row[1]) if row else None
