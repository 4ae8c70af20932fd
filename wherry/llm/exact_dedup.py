"""Exact dedup by content-defined chunk recipes (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import left, written

#: White space that equality ignores.
BLANK = " \t\n\x0b\x0c\r"
#: A chunk ends after a code point of this class preceded by one of the other (the content
#: decides, not the offset), after 256 code points at least and 4096 at most.
CUT = r"(?s).{256,4095}?(?<=[aeiou\d][^aeiou\d][adgjmpsvy0369]).|.{1,4096}"


#: The short identifier of a chunk; its SHA-256 verifies it, and stands in where two contents share it.
SHORT = F.xxhash64


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, points (code points), text_sha256 (without ASCII white space), chunks: (h, s) of each content-defined part in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, BLANK, "")
    part = lambda c: F.struct(SHORT(c).cast("long").alias("h"), F.unhex(F.sha2(c, 256)).alias("s"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("points"),
        F.sha2(norm, 256).alias("text_sha256"),
        F.transform(chunks_of(norm), part).alias("chunks"),
    )


def chunks_of(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CUT), F.lit(0))


def verified(rows: DataFrame) -> bool:
    """True if no two distinct chunks of all rows (by their SHA-256) share a short identifier.

    Chunks are deduplicated before and after they move.
    """
    store = rows.select(F.explode("chunks").alias("c")).select("c.h", "c.s").distinct()
    return store.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are the same after deleting ASCII white space. Each text is read
    and cut by its content once; its recipe, the ordered identifiers of its chunks, is a written
    table. Identifiers are verified over all distinct chunks (contents with one 64-bit identifier
    are found, and then the SHA-256 ones serve), and texts are compared as identifier lists, so
    no text moves with its group. Of equal texts the row with the most code points stays, then
    the smallest id.

    Null text counts as empty; all empty texts form one group. A null id loses every tie and
    gives keep_id null only if its whole group is null. Repeated rows (same id and text) each
    get a row with the same result; only one id stays. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    rows, path = written(recipes(docs, id_col, text_col), "recipes")
    short = verified(rows)
    slim = rows.select("doc_id", "points", "text_sha256", F.transform("chunks", lambda c: c["h"] if short else c["s"]).alias("recipe"))
    # the most points, then the smallest id, nulls last
    best = F.min_by("doc_id", F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"))).alias("keep_id")
    groups = slim.groupBy("recipe").agg(best, F.count(F.lit(1)).alias("group_size"))
    # written: both sides of the join are then plain shuffles, which Spark can split at a hot recipe
    groups, groups_path = written(groups, "recipe-groups")
    left(path, groups_path)
    return slim.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
