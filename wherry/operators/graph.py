"""Concept graphs: spans of a query, interpretations, expansion, statistics, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..streaming.feeds import work_dir

MAX_PHRASE = 3
MAX_INTERPRETATIONS = 8


def spans(queries: DataFrame, text_col: str = "query") -> DataFrame:
    """query_id, ord, text, start, stop, kind, main: whole query, then 3- and 2-word phrases, then words."""
    rows = queries.select("query_id", T.structural_tokens(F.col(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    n = F.size("tokens")

    def runs(width: int):
        return F.when(n > width, F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda s: F.struct(F.lit(-width).alias("k"), s.alias("start"), (s + width).alias("stop")))).otherwise(
            F.array().cast("array<struct<k:int,start:int,stop:int>>")
        )

    whole = F.array(F.struct(F.lit(-99).alias("k"), F.lit(0).alias("start"), n.alias("stop")))
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.struct(F.lit(0).alias("k"), s.alias("start"), (s + 1).alias("stop")))
    rows = rows.select("query_id", "tokens", F.posexplode(F.concat(whole, runs(3), runs(2), words)).alias("ord", "s"))
    width = F.col("s.stop") - F.col("s.start")
    return rows.select(
        "query_id",
        F.col("ord").cast("long").alias("ord"),
        F.array_join(F.slice("tokens", F.col("s.start") + 1, width), " ").alias("text"),
        F.col("s.start").cast("long").alias("start"),
        F.col("s.stop").cast("long").alias("stop"),
        F.when(width == 1, "ATOMIC").otherwise("PHRASE").alias("kind"),
        ((F.col("ord") == 0) | ((F.size("tokens") == 1))).alias("main"),
    )


def span_edges(nodes: DataFrame) -> DataFrame:
    """query_id, a, b, kind: CONTAINS from the whole and from phrases to their words, ADJACENT between words."""
    a, b = nodes.alias("a"), nodes.alias("b")
    same = F.col("a.query_id") == F.col("b.query_id")
    phrase = (F.col("a.kind") == "PHRASE") & (F.col("b.kind") == "ATOMIC") & (F.col("a.ord") > 0) & (F.col("b.ord") > 0)
    inside = (F.col("b.start") >= F.col("a.start")) & (F.col("b.stop") <= F.col("a.stop"))
    both = lambda cond, kind: a.join(b, same & cond).select("a.query_id", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), F.lit(kind).alias("kind"))
    whole = both((F.col("a.ord") == 0) & (F.col("b.ord") > 0), "CONTAINS")
    parts = both(phrase & inside, "CONTAINS")
    atoms = (F.col("a.kind") == "ATOMIC") & (F.col("b.kind") == "ATOMIC") & (F.col("a.ord") > 0) & (F.col("b.ord") > 0)
    next_ = both(atoms & (F.col("a.stop") == F.col("b.start")), "ADJACENT")
    return whole.unionByName(parts).unionByName(next_)


def interpretations(queries: DataFrame, text_col: str = "query", limit: int = MAX_INTERPRETATIONS) -> DataFrame:
    """query_id, ord, kind, parts: the whole, groups of phrases by width and phase, all words.

    Parts are joined by `` + ``. Groups that come out alike count once; the words come last.
    """
    rows = queries.select("query_id", T.structural_tokens(F.col(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    n = F.size("tokens")

    def group(width: int, phase: int):
        """A part starts at every word but those inside a full phrase of the grid; none if there is no phrase."""
        full = lambda s: (s >= phase) & (F.pmod(s - phase, F.lit(width)) == 0) & (s + width <= n)
        start = lambda i: i - F.pmod(i - phase, F.lit(width))
        inner = lambda i: (i >= phase) & (F.pmod(i - phase, F.lit(width)) > 0) & full(start(i))
        parts = F.transform(
            F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~inner(i)),
            lambda i: F.array_join(F.slice("tokens", i + 1, F.when(full(i), width).otherwise(1)), " "),
        )
        # a phrase as wide as the query is the whole query, which is no phrase of its own
        return F.when((n > width) & (n >= phase + width), F.array_join(parts, " + "))

    groups = [group(w, p) for w in range(MAX_PHRASE, 1, -1) for p in range(w)]
    distinct = F.slice(F.array_distinct(F.filter(F.array(*groups), lambda x: x.isNotNull())), 1, limit - 2)
    made = F.concat(
        F.array(F.struct(F.lit("WHOLE_QUERY").alias("kind"), F.array_join("tokens", " ").alias("parts"))),
        F.transform(distinct, lambda p: F.struct(F.lit("PHRASE_GROUP").alias("kind"), p.alias("parts"))),
        F.array(F.struct(F.lit("ATOMIC_CONJUNCTION").alias("kind"), F.array_join("tokens", " + ").alias("parts"))),
    )
    rows = rows.select("query_id", F.posexplode(made).alias("ord", "x"))
    return rows.select("query_id", F.col("ord").cast("long").alias("ord"), "x.kind", "x.parts")


# ------------------------------------------------------------------ semantic graph


def expand(starts: DataFrame, relations: DataFrame, depth: int = 1, limit: int = 50, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """start, node, depth: nodes within ``depth`` steps, each once at its least depth, at most ``limit``.

    ``relations`` has src, dst, kind. Nodes of one depth are taken in the order of their ids.
    Every level is one join of the frontier with the relations; what was seen is left out. A
    level is written, so the next one does not compute it again and a lost executor costs one.
    """
    edges = relations.where(F.col("kind").isin(*kinds)) if kinds else relations
    edges = edges.select("src", "dst").distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        new = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = new.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d))
        if d < depth:
            path = work_dir(starts.sparkSession, "frontier")
            frontier.write.parquet(path)
            frontier = starts.sparkSession.read.schema(frontier.schema).parquet(path)
        seen = seen.unionByName(frontier)
    order = Window.partitionBy("start").orderBy("depth", "node")
    found = seen.where("depth > 0").withColumn("ord", F.row_number().over(order).cast("long"))
    return found.where(F.col("ord") <= limit)


def materialised(steps: DataFrame, arrival: tuple[str, ...] = ("depth", "origin")) -> DataFrame:
    """start, node, depth, origin: each node once; of several steps to it the one that arrived last counts.

    ``arrival`` are the columns of ``steps`` by which they came.
    """
    last = F.max_by(F.struct("depth", "origin"), F.struct(*arrival)).alias("l")
    return steps.groupBy("start", "node").agg(last).select("start", "node", "l.depth", "l.origin")


def built(concepts: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, ord), (token, id), (src, place, dst, kind)) of a graph that is read in order.

    ``concepts`` has ord, id and tokens, ``relations`` ord, src, dst and kind. Keys are trimmed
    and blank ones left out. Of concepts with one id, and of those with one token, the first
    counts; all relations of a source stay, in their order.
    """
    ids = concepts.select(F.trim(F.coalesce("id", F.lit(""))).alias("id"), "ord", "tokens")
    by_id = ids.where("id <> ''").groupBy("id").agg(F.min("ord").alias("ord"))
    each = ids.select("id", "ord", F.explode("tokens").alias("token")).withColumn("token", F.trim(F.coalesce("token", F.lit("")))).where("token <> ''")
    by_token = each.groupBy("token").agg(F.min_by("id", "ord").alias("id"))
    src = relations.withColumn("src", F.trim(F.coalesce("src", F.lit("")))).where("src <> ''")
    place = F.row_number().over(Window.partitionBy("src").orderBy("ord")).cast("long")
    return by_id, by_token, src.select("src", place.alias("place"), "dst", "kind")


#: The types of concepts that a search asks by, and what they are called there.
BUCKETS = {"OBJECT": "object", "COLOR": "color", "PLACE": "place", "ACTION": "action"}


def resolved(best: DataFrame) -> DataFrame:
    """query_id, score, object, color, place, action: the best concept of each query (id, type, score) under its type; a person is none of them."""
    typed = [F.when(F.upper("type") == t, F.col("id")).alias(n) for t, n in BUCKETS.items()]
    return best.select("query_id", "score", *typed)


def statistics(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: nodes, relations, tokens, lone nodes, tokenless nodes, largest and mean out-degree, density."""
    out = relations.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    per = nodes.select("id", "tokens").join(out, F.col("id") == F.col("src"), "left")
    a = per.agg(
        F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("tokens"), F.count_if(F.col("n").isNull()).alias("without_relations"),
        F.count_if(F.size("tokens") == 0).alias("without_tokens"), F.coalesce(F.max("n"), F.lit(0)).alias("max_out"),
    )
    b = relations.agg(F.count(F.lit(1)).alias("relations"))
    one = a.crossJoin(b)  # one row each
    return one.withColumns(
        {
            "mean_out": F.round(F.when(F.col("nodes") > 0, F.col("relations") / F.col("nodes")).otherwise(0.0), 6),
            "density": F.round(F.when(F.col("nodes") > 1, F.col("relations") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), 6),
        }
    )


def validate(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """issue, subject: what is wrong with a graph."""
    ids = nodes.select(F.trim("id").alias("id"), "tokens")
    issue = lambda df, kind, subject: df.select(F.lit(kind).alias("issue"), F.col(subject).alias("subject"))
    known = ids.select("id").distinct()
    tokens = ids.select(F.explode("tokens").alias("token")).where(F.trim("token") != "")
    found = [
        issue(ids.where("id <> ''").groupBy("id").count().where("count > 1"), "DUPLICATE_CONCEPT_ID", "id"),
        issue(tokens.groupBy("token").count().where("count > 1"), "DUPLICATE_TOKEN", "token"),
        issue(ids.where((F.size("tokens") <= 0) | ~F.exists("tokens", lambda t: F.trim(t) != "")).select("id").distinct(), "CONCEPT_WITHOUT_TOKEN", "id"),
        issue(relations.select("src").distinct().join(known, F.col("src") == F.col("id"), "left_anti"), "MISSING_SOURCE", "src"),
        issue(relations.select("dst").distinct().join(known, F.col("dst") == F.col("id"), "left_anti"), "MISSING_TARGET", "dst"),
        issue(relations.where("src = dst").select("src").distinct(), "SELF_RELATION", "src"),
        issue(known.join(relations.select("src").distinct(), F.col("id") == F.col("src"), "left_anti"), "CONCEPT_WITHOUT_RELATION", "id"),
    ]
    return reduce(DataFrame.unionByName, found)
