"""Running totals over partitions."""

import random

import pytest

from wherry.operators import ranks


@pytest.mark.parametrize("most", [3, 700, 70_000])
def test_offsets(spark, monkeypatch, most):
    rng = random.Random(most)
    rows = list({(rng.choice([1, 2, None]), rng.randrange(most)): None for _ in range(300)})
    rows = [(k, p, rng.randrange(5)) for k, p in rows]
    got = {(r["key"], r["part"]): r["before"] for r in ranks.offsets(spark.createDataFrame(rows, "key long, part int, n long"), ["key"]).collect()}
    assert got == {(k, p): sum(n for k2, p2, n in rows if k2 == k and p2 < p) for k, p, _ in rows}


def test_offsets_without_rows_or_groups(spark):
    none = spark.createDataFrame([], "key long, part int, n long")
    assert ranks.offsets(none, ["key"]).count() == 0
    rows = spark.createDataFrame([(0, 2), (1, 3), (5, 1)], "part int, n long")
    assert sorted((r["part"], r["before"]) for r in ranks.offsets(rows, []).collect()) == [(0, 0), (1, 2), (5, 5)]


def test_near_scores_lose_no_row_that_counts(spark):
    """Against all pairs: ties, copies, repeated ids, and vectors that matrices can't hold; no plan crosses queries and plain vectors."""
    import random

    from pyspark.sql import functions as F

    from wherry.operators import search as R

    rng = random.Random(3)
    vectors = [(i % 280, [float(rng.randrange(-2, 3)) for _ in range(4)], i % 5) for i in range(300)]
    vectors += [(300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [1.0, 2.0], 2), (303, [0.0] * 4, 3), (304, [float("inf"), 0.0, 0.0, 0.0], 4), (305, [float("nan")] * 4, 0)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3)
    q = v.where("vec_id % 20 = 0 OR vec_id IN (302, 303)").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "embedding").localCheckpoint()
    rows = lambda df: sorted(map(repr, df.select("query_id", "vec_id", "label", "score").collect()))
    every = R.vector_scores(q, v, of_vector=["label"])
    near = lambda k, **o: R.near_scores(q, v, k, of_vector=["label"], **o)
    for k in (1, 10):
        assert rows(R.top(near(k), k)) == rows(R.top(every, k))
    finite = every.where(~F.isnan("score"))
    assert rows(R.image_threshold(near(0).where(~F.isnan("score")))) == rows(R.image_threshold(finite))
    best = lambda s: s.groupBy("query_id").agg(F.min_by(F.struct("vec_id", "label", "score"), F.struct((-F.col("score")).alias("s"), "vec_id")).alias("b")).select("query_id", "b.*")
    assert rows(best(near(1, others=True))) == rows(best(every.where("vec_id <> query_id")))
    assert near(1).count() < every.count() / 2


def test_counts_and_first_ranks_equal_all_pairs(spark):
    """Against all pairs: scores on the threshold, ties, copies, vectors that matrices can't hold; no plan crosses queries and plain vectors."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from wherry.operators import search as R

    rng = random.Random(5)
    vectors = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)], None if i % 11 == 0 else i % 7) for i in range(300)]
    vectors += [(300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [1.0, 2.0], 2), (303, [0.0] * 4, 3), (304, [float("inf"), 0.0, 0.0, 0.0], 4), (305, [float("nan")] * 4, 0), (320, [1.0, 0.0, 0.0, 1.0], 99)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3)
    q = v.where("vec_id % 20 = 0 OR vec_id IN (302, 303)").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), "embedding").localCheckpoint()
    rows = lambda df: sorted(map(repr, df.collect()))
    every = R.vector_scores(q, v, ["own"], ["label"])
    for least in (0.22, 0.5):  # 0.5 is the cosine of many pairs
        want = every.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"), F.count_if(F.col("score") >= least).alias("kept"))
        assert rows(R.score_counts(q.select("query_id", "embedding"), v, least)) == rows(want)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every.where("vec_id <> query_id").withColumn("rank", F.row_number().over(w))
    want = ranked.groupBy("query_id", "own").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))).cast("long").alias("rank"))
    found = R.first_relevant(q, v)
    assert rows(found) == rows(want) and found.where("rank IS NULL").count() and found.where("rank > 5").count()
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert R.first_relevant(q.limit(1), v.join(q.limit(1).select(F.col("query_id").alias("vec_id")), "vec_id")).count() == 0


def test_only_asked_terms_are_counted_and_hashed(spark):
    """What is not asked goes where the chunk is read, before it is grouped or hashed."""
    from pyspark.sql import functions as F

    from wherry.functions import text as T
    from wherry.operators import index as I
    from wherry.operators import search as R

    docs = spark.createDataFrame([(1, "With this and that, with this " * 3), (2, "that from"), (3, None)], "doc_id long, text string")
    chunked = I.chunks(docs)
    asked = spark.createDataFrame([("with",), ("with this",), ("none",)], "term string")
    hashes = [r[0] for r in asked.select(T.canonical_hash(F.col("term"))).collect()]
    for make in (I.counted_postings, I.canonical_postings):
        found = make(chunked, asked)
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in make(chunked).where(F.col("hash").isin(hashes)).collect()} != set()
    plan = I.counted_postings(chunked, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2") < plan.index("LeftSemi")  # the join is below
    held = R.held_tokens(spark.createDataFrame([(1, "with"), (2, "that"), (2, "none")], "query_id int, token string"), chunked)
    assert {tuple(r) for r in held.select("query_id", "token", "doc_id").collect()} == {(1, "with", 1), (2, "that", 1), (2, "that", 2)}
    assert "hashpartitioning" not in held._jdf.queryExecution().executedPlan().toString()
