"""Queries that meet chunks where these lie."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from wherry.operators import evaluate as E
from wherry.operators import index as I
from wherry.operators import scored as K
from wherry.operators import search as R

WORDS = "in into inner the them then there a an and other tion thre x é1 éa two2".split()
QUERIES = ["the", "in", "é1", "the in", "in the", "the the", "in the in", "an and a", "them then there", "into the inner other", "the in an and other tion thre two2 them then there into", "absent", "the absent", "! ?", "éa é1"]


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, [9, 1, 1, 9, 2, 1, 1, 5, 3, 5, 1, 1, 1, 9, 1, 1, 1], k=rng.choice([0, 1, 4, 30, 150, 700]))) for _ in range(n)]


def asked_of(spark):
    return R.understood(spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string"))


def scores(spark, docs):
    found = K.document_scores(asked_of(spark), docs).select("doc_id", F.inline("found"))
    return sorted((r["query_id"], r["doc_id"], r["score"]) for r in found.collect())


def searched(spark, docs):
    asked = asked_of(spark)
    found = R.documents(R.scored_chunks(asked, I.chunks(docs)))
    return sorted((r["query_id"], r["doc_id"], r["score"]) for r in found.collect())


def test_scores_are_those_of_the_search(spark):
    rows = [*enumerate(texts(1, 300)), (900, None), (901, "the " + "x " * 200 + "in"), (902, "in " + "x " * 20 + "the " + "x " * 13 + "into in")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = scores(spark, docs)
    assert len(got) > 1000 and {q for q, _, _ in got} == {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 14} | ({10} & {q for q, _, _ in got}) and got == searched(spark, docs)


def test_a_document_of_many_blocks(spark):
    text = " ".join(texts(2, 2400))
    assert len(text) > 800 * (K.CHUNKS + 10)
    docs = spark.createDataFrame([(1, "in the " * 9), (2, text), (3, "the in " * 9)], "doc_id long, text string").coalesce(1)
    assert scores(spark, docs) == searched(spark, docs)


def test_ids_of_several_rows_and_of_none(spark):
    rows = [(1, "the in into"), (1, "the then into"), (2, "in them"), (2, "the " * 30 + "inner"), (2, None), (None, "the in"), (3, "the other in"), (3, "the other in")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(q, d): s for q, d, s in scores(spark, docs)}
    alone = lambda q, text, n=1: round(next(s for i, _, s in searched(spark, spark.createDataFrame([(0, text)], "doc_id long, text string")) if i == q) + 0.5 * (n - 1), 6)
    assert {d for _, d in found} == {1, 2, 3}
    assert found[0, 1] == alone(0, "the in into", 2) and found[0, 3] == alone(0, "the other in", 2)  # each row counts
    assert found[2 - 1, 1] == alone(1, "the in into")  # the second row's "into" is no "in"
    assert found[3, 1] == alone(3, "the in into", 2)  # but beside a row that holds it, it is near enough
    assert (3, 2) in found and (3, 2) not in {(q, d) for q, d, _ in searched(spark, docs.where("doc_id = 2"))}


def test_nothing_moves_where_chunks_meet_queries(spark):
    docs = spark.createDataFrame([("a", "the in " * 9), ("b", "in an " * 9)], "doc_id string, text string")
    made = K.document_scores(asked_of(spark), docs)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 2
    none = spark.createDataFrame([], "query_id long, tokens array<string>")
    assert [r["found"] for r in K.document_scores(none, docs).collect()] in ([], [[], []])


def test_a_document_goes_on_in_the_next_batch():
    asked = K._Asked([(7, ["in"]), (8, ["the", "in"])])
    chunk = lambda d, *ws: pa.RecordBatch.from_pydict({"doc_id": [d], "words": [list(ws)]})
    one = [chunk(1, "in", "the"), chunk(1, "in"), chunk(2, "x"), chunk(3, "in"), chunk(3, "in", "the", "x")]
    key = lambda batches: [r for b in batches for r in b.to_pylist()]
    split, whole = key(asked.run(iter(one))), key(asked.run(iter(pa.Table.from_batches(one).combine_chunks().to_batches())))
    assert [r["doc_id"] for r in split if r["found"]] == [1, 3] and [r for r in split if r["found"]] == [r for r in whole if r["found"]]


def test_a_task_keeps_few_documents_of_a_key(spark):
    """However many batches a task reads; ties go by id though documents come in any order."""
    ids = list(range(3000))
    random.Random(4).shuffle(ids)
    docs = spark.createDataFrame([(i, [(0, 1.0 + i % 3), (1, 2.0)] if i % 7 else [(0, 3.0)]) for i in ids], "doc_id long, found array<struct<query_id: long, score: double>>").coalesce(1)
    rows = E._conjunctions(docs, [("one", [(0, 3.0)]), ("two", [(0, 3.0), (1, 2.0)]), ("none", [(5, None)])], 10).collect()
    got = {k: [r["id"] for r in rows if r["key"] == k] for k in ("one", "two", "none")}
    ones = sorted(range(3000), key=lambda i: (-(1.0 + i % 3 if i % 7 else 3.0), i))[:10]
    twos = sorted((i for i in range(3000) if i % 7), key=lambda i: (-(i % 3), i))[:10]
    assert got == {"one": ones, "two": twos, "none": []}
