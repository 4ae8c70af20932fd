"""Cross-site boilerplate lines by HyperLogLog site spread (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, left, written

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers; its relative error is 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within this share of the threshold (over four standard errors) are counted exactly.
MARGIN = 0.15

_EDGE = " \t\r\x0b\x0c"


def _pair(c: Column, a: str, b: str) -> list[Column]:
    """128 bits of ``c`` in two columns."""
    return [F.xxhash64(c).alias(a), F.xxhash64(F.lit(7), c).alias(b)]


def line_key(line: Column) -> list[Column]:
    """The columns a and b: a line without its outer white space."""
    return _pair(F.btrim(line, F.lit(_EDGE)), "a", "b")


def site_spread(lines: DataFrame, min_sites: int, lg_k: int, margin: float) -> tuple[DataFrame, list[str]]:
    """(a, b, sites) of the lines on ``min_sites`` sites or more; ``lines`` has a, b and site.

    A line that stands fewer times is on fewer sites, so only the others get a sketch. Sketches
    merge by partial aggregation, so a hot line is one row per task when it moves. Lines whose
    estimate is near the threshold are counted exactly.
    """
    often = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("a", "b")
    # written, so that their size is known: Spark broadcasts them below its threshold and shuffles beyond
    often, often_path = written(often, "frequent-lines")
    est = lines.join(often, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("s"))
    est = est.select("a", "b", F.hll_sketch_estimate("s").alias("sites")).where(F.col("sites") >= min_sites * (1 - margin))
    est, path = written(est, "line-spread")
    near = est.where(F.col("sites") <= min_sites * (1 + margin)).select("a", "b")
    exact = lines.join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct()
    exact = exact.groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return est.where(F.col("sites") > min_sites * (1 + margin)).unionByName(exact), [often_path, path]


def cleaned(
    docs: DataFrame,
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    margin: float = MARGIN,
) -> DataFrame:
    """(doc, line): each row of ``docs`` as a struct, and a struct of text (cleaned), n_lines, n_boilerplate, n_removed.

    Lines are split and hashed once, into a table of hashes and places; all counts read that.
    What is found is a list of places per distinct text, so copies and shared ids need no key of
    their own, and whole rows move once, in the last join.
    """
    spark = docs.sparkSession
    lines = docs.select(
        *_pair(F.col(text_col), "t", "u"), F.coalesce(F.col(site_col), F.lit("")).alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("place", "line")
    ).where(F.btrim("line", F.lit(_EDGE)) != "")
    lines, lines_path = written(lines.select("t", "u", "place", "site", *line_key(F.col("line"))), "lines")
    spread, paths = site_spread(lines.select("a", "b", "site"), min_sites, lg_k, margin)
    spread, spread_path = written(spread.select("a", "b"), "boilerplate")
    found = lines.join(spread, ["a", "b"], "left_semi").groupBy("t", "u").agg(F.collect_set("place").alias("places"))
    found, found_path = written(found, "boilerplate-places")
    dropped(spark, lines_path, spread_path, *paths)
    left(found_path)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_pair(F.col(text_col), "t", "u"))
    # one row per distinct text with boilerplate is hashed; texts need no sort, and a hot text can be split
    rows = rows.join(found.hint("shuffle_hash"), ["t", "u"], "left").select("doc", "places")
    text = F.col(f"doc.`{text_col}`")
    split = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "places"), lambda i: F.get(split, i))
    rows = rows.withColumn("kept", F.when(F.col("places").isNotNull(), kept))
    # a text of which only blank lines would be left is a copy, and stays whole
    own = F.coalesce(F.exists("kept", lambda x: F.btrim(x, F.lit(_EDGE)) != ""), F.lit(False))
    n = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    return rows.select(
        "doc",
        F.struct(
            F.when(own, F.array_join("kept", "\n")).otherwise(text).alias("text"),
            F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
            F.greatest(n, F.lit(0)).alias("n_boilerplate"),
            F.when(own, n).otherwise(0).cast("long").alias("n_removed"),
        ).alias("line"),
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
    margin: float = MARGIN,
) -> DataFrame:
    """One row per input row: doc_id, text (cleaned), n_lines, n_boilerplate, n_removed.

    A line is boilerplate if, without its outer white space, it stands on ``min_sites`` sites
    or more; blank lines never are. It is removed wherever it stands, but a document of which
    nothing but blank lines would be left keeps its lines: it is a copy, left for near-duplicate
    removal.

    Null text stays null with counts 0; an empty text is one blank line. A null site counts as
    the one site ''. Repeated rows, and rows that share an id, get a row each by their own text;
    null ids are kept. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).alias("site"))
    return cleaned(rows, "text", "site", min_sites, lg_k, margin).select("doc.doc_id", "line.*")
