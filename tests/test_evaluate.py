"""Interpretations under a budget."""

import pytest
from pyspark.sql import functions as F

from wherry.operators import evaluate as E
from wherry.operators import ranks


class Counted:
    """Answers a key with as many results as it has letters, and keeps what it was asked."""

    def key(self, query, parts):
        return F.array_join(F.array_sort(F.array_distinct(parts)), "+")

    def execute(self, requests, budget):
        self.asked = sorted(r["key"] for r in requests.collect())
        each = requests.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("id"))
        return each.select("key", F.when(F.col("id") % 2 == 0, "IMAGE").otherwise("DOCUMENT").alias("modality"), "id", F.col("id").cast("double").alias("score"))


def interpreted(spark, rows):
    return spark.createDataFrame(rows, "query_id int, query string, ord long, kind string, parts array<string>")


def test_budget_is_clamped():
    assert E.Budget(99, 99, 99, 99) == E.Budget() == E.Budget(*E.MOST)
    assert E.Budget(-1, -1, -1, -1) == E.Budget(0, 0, 0, 0)


def test_keys_are_executed_once_for_all_queries(spark):
    rows = [(1, "q", 0, "WHOLE", ["aa"]), (1, "q", 1, "GROUP", ["b", "a"]), (1, "q", 2, "GROUP", ["a", "b", "a"]), (2, "r", 0, "WHOLE", ["aa"]), (2, "r", 1, "WIDE", ["x"] * 13), (2, "r", 2, "NONE", ["zzz"])]
    s = Counted()
    out, kept = E.evaluated(interpreted(spark, rows), s, E.Budget(results=1))
    got = {(r["query_id"], r["ord"]): (r["key"], r["reused"], r["best_score"], r["documents"], r["images"]) for r in out.collect()}
    assert s.asked == ["a+b", "aa", "zzz"]
    assert got == {(1, 0): ("aa", False, 2.0, 1, 1), (1, 1): ("a+b", False, 3.0, 2, 1), (1, 2): ("a+b", True, 3.0, 2, 1), (2, 0): ("aa", False, 2.0, 1, 1), (2, 2): ("zzz", False, 3.0, 2, 1)}
    # counts are of all that was found, one of each kind is kept
    assert sorted((r["key"], r["modality"], r["id"]) for r in kept.collect()) == [("a+b", "DOCUMENT", 3), ("a+b", "IMAGE", 2), ("aa", "DOCUMENT", 1), ("aa", "IMAGE", 2), ("zzz", "DOCUMENT", 3), ("zzz", "IMAGE", 2)]
    best = {r["query_id"]: r["ord"] for r in E.strongest(out).collect()}
    assert best == {1: 1, 2: 2}


def test_one_execution_too_many_ends_a_query(spark):
    rows = [(1, "q", i, "G", [p]) for i, p in enumerate(["a", "b", "a", "c", "a", "b"])]
    out, _ = E.evaluated(interpreted(spark, rows), Counted(), E.Budget(executions=2))
    assert sorted((r["ord"], r["reused"]) for r in out.collect()) == [(0, False), (1, False), (2, True)]
    out, _ = E.evaluated(interpreted(spark, rows), Counted(), E.Budget(interpretations=2))
    assert sorted(r["ord"] for r in out.collect()) == [0, 1]
    assert E.evaluated(interpreted(spark, rows), Counted(), E.Budget(executions=0))[0].count() == 0


def test_a_key_without_results(spark):
    class Nothing(Counted):
        def execute(self, requests, budget):
            return super().execute(requests, budget).where("false")

    out, _ = E.evaluated(interpreted(spark, [(1, "q", 0, "G", ["a"])]), Nothing())
    assert [(r["best_score"], r["documents"], r["images"]) for r in out.collect()] == [(0.0, 0, 0)]


def test_aligned(spark):
    pivots = spark.createDataFrame([(1, 0, "One two"), (1, 1, " "), (1, 2, None), (1, 3, "!!!"), (1, 8, "late"), (2, 0, "solo")], "query_id int, ord int, pivot string")
    assert sorted((r["query_id"], r["pivot_ord"], r["pivot"], r["parts"]) for r in E.aligned(pivots).collect()) == [(1, 0, "One two", ["one", "two"]), (2, 0, "solo", ["solo"])]


def test_ranked_and_correlated(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 30, 500).astype(float), rng.integers(0, 30, 500).astype(float)
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i long, a double, b double").repartition(7)
    place = lambda v: np.argsort(np.lexsort((np.arange(500), -v))) + 1
    got = sorted((r["i"], r["rank"]) for r in ranks.ranked(rows, [F.desc("a"), "i"]).collect())
    assert [r for _, r in got] == place(a).tolist()
    one = ranks.rank_correlation(rows, "a", "b", ["i"]).first()
    assert one["n"] == 500 and one["rank"] == pytest.approx(np.corrcoef(place(a), place(b))[0, 1], abs=1e-6)
    assert ranks.rank_correlation(rows.limit(0), "a", "b", ["i"]).first()["rank"] is None


# ------------------------------------------------------------------ explanations and graphs


def test_compact_sentences(spark):
    from wherry.operators import explained as XP

    rows = [(1, "red car", 3, 1, 2, 0), (2, None, 1, 0, 0, 1), (3, " ", 4, 2, 0, 0), (4, "x", 2, 0, 1, 1)]
    counts = spark.createDataFrame(rows, "query_id int, query string, results long, best long, partial long, related long")
    en = {r["query_id"]: r["text"] for r in XP.compact(counts).collect()}
    assert en[1] == "You searched for “red car”. Found 3 results. Among the images, 1 is a complete match, 2 are partial matches, and 0 are related matches. Complete matches cover the whole search; the others match only part of it."
    assert en[2] == "You searched your files. Found 1 result. These results are shown because they are the closest available matches."
    assert en[3].endswith("2 are complete matches, 0 are partial matches, and 0 are related matches. All displayed images cover the whole search.")
    assert en[4].endswith("No displayed image covers the whole search; partial matches cover only part of it.")
    ro = {r["query_id"]: r["text"] for r in XP.compact(counts, "ro").collect()}
    assert ro[2] == "Ai căutat în fișierele tale. Am găsit 1 rezultat. Aceste rezultate sunt afișate deoarece sunt cele mai apropiate potriviri disponibile."
    tiers = spark.createDataFrame([(1, "image", "BEST"), (1, "DOCUMENT", "BEST"), (1, "IMAGE", None)], "query_id int, modality string, tier string")
    assert tuple(XP.tier_counts(tiers).first()) == (1, 3, 1, 0, 0)


def test_projection_and_its_issues(spark):
    from wherry.operators import explained as XP

    rows = [(1, "e1", 10, 1, True, 0.5), (1, "e1", 11, 2, True, None), (2, "e2", 10, 1, False, 0.5), (3, "e3", 10, 1, True, 0.5), (3, "e3", 10, 2, True, 0.5), (4, "e4", None, 1, True, 0.5), (5, "e5", 7, 1, True, 0.5)]
    results = spark.createDataFrame(rows, "query_id int, execution_id string, doc_id long, rank int, complete boolean, confidence double")
    better = spark.createDataFrame([(1, 11, 0.9), (2, 10, None), (5, 8, 0.1)], "query_id int, doc_id long, confidence double")
    assert {tuple(r) for r in XP.issues(results, {"confidence": better}).collect()} == {(3, 10, "duplicate resultId"), (4, None, "resultId"), (5, 8, "confidence contains unknown resultId")}
    got = {r["query_id"]: (r["explanation_id"], r["state"], r["results"], r["evidence"], r["missing"]) for r in XP.projected(results, {"confidence": better}, "1").collect()}
    assert got == {
        1: ("e1:explanation:1", "AVAILABLE", 2, 2, 0), 2: ("e2:explanation:1", "PARTIAL", 1, 0, 1), 3: ("e3:explanation:1", "INVALID", 0, 0, 0),
        4: ("e4:explanation:1", "INVALID", 0, 0, 0), 5: ("e5:explanation:1", "INVALID", 0, 0, 0),
    }


def test_graph_is_built_in_order(spark):
    from wherry.operators import graph as G

    concepts = spark.createDataFrame([(0, " a ", ["x", " "]), (1, "a", ["y", "x"]), (2, None, ["z"]), (3, "b", None)], "ord int, id string, tokens array<string>")
    relations = spark.createDataFrame([(1, "a", "b", "K"), (0, " a", "c", "K"), (2, "", "c", "K")], "ord int, src string, dst string, kind string")
    ids, tokens, places = G.built(concepts, relations)
    assert {tuple(r) for r in ids.collect()} == {("a", 0), ("b", 3)}
    assert {tuple(r) for r in tokens.collect()} == {("x", "a"), ("y", "a"), ("z", "")}
    assert {tuple(r) for r in places.collect()} == {("a", 1, "c", "K"), ("a", 2, "b", "K")}
    steps = spark.createDataFrame([(0, "s", "n", 2, "p"), (1, "s", "n", 1, "q")], "at int, start string, node string, depth int, origin string")
    assert tuple(G.materialised(steps, ("at",)).first()) == ("s", "n", 1, "q")
    best = spark.createDataFrame([(1, "c1", "COLOR", 0.9), (2, "p", "PERSON", 0.8)], "query_id int, id string, type string, score double")
    assert {tuple(r) for r in G.resolved(best).collect()} == {(1, 0.9, None, "c1", None, None), (2, 0.8, None, None, None, None)}


def test_conjunctions_of_documents_equal_those_of_rows(spark):
    """The matrix of a batch gives what rows of documents and components give, ties and halves too."""
    import random

    from pyspark.sql import functions as F

    from wherry.operators import evaluate as E
    from wherry.operators import fuse as U

    rng = random.Random(8)
    found = [(f"c{c}", c, doc, rng.choice([1.0, 1.5, 3.0, 7.25, 0.000003, 2.333334])) for doc in range(700) for c in range(9) if rng.random() < 0.4]
    keys = {f"k{i}": rng.sample(range(9), rng.randrange(1, 8)) for i in range(12)} | {"none": [11]}
    each = spark.createDataFrame([(k, f"c{c}") for k, cs in keys.items() for c in cs], "query_id string, component string")
    rows = spark.createDataFrame([(n, d, s) for n, _, d, s in found], "component string, id long, score double")
    want = U.atomic_conjunction(rows.join(each, "component").withColumn("modality", F.lit("DOCUMENT")), each, 10)
    tops = {}
    for _, c, _, s in found:
        tops[c] = max(s, tops.get(c, 0.0))
    docs = spark.createDataFrame([(c, d, s) for _, c, d, s in found], "query_id long, doc_id long, score double").groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "score")).alias("found"))
    got = E._conjunctions(docs, [(k, [(c, tops.get(c)) for c in cs]) for k, cs in keys.items()], 10)
    got = {(r["key"], r["id"]): (r["support"], r["strength"]) for r in got.collect()}
    want = want.select("query_id", "id", "support", F.round("strength", 6).alias("strength")).collect()
    assert len(want) == 120 and all(got[r["query_id"], r["id"]] == (r["support"], r["strength"]) for r in want)
