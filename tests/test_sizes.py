"""What keeps work and disk from growing faster than the input."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from wherry.functions import scoring as S
from wherry.functions import text as T
from wherry.operators import index as I
from wherry.operators import wordpiece as W
from wherry.plans.built import stored_index
from wherry.sources.pages import FolderTransport, PageStreamReader
from wherry.streaming import budget as Y


def analyzed(spark, df):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().analyzed().toString().lower()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_search_keeps_no_texts(spark, data, tmp_path):
    shutil.copy(f"{data}/documents.parquet", tmp_path)  # a folder whose index with vectors no other query has asked for
    assert set(stored_index(spark, str(tmp_path), "terms").set.manifest()["tables"]) == {"documents", "terms"}
    assert "chunks" not in stored_index(spark, str(tmp_path)).set.manifest()["tables"]


def mailbox(root, pages, first=True):
    for i in range(1, pages + 1):
        (root / "ann" / f"page={i}").mkdir(parents=True)
        after, messages = {"nextPageToken": str(i + 1) if i < pages else None}, {"messages": [{"id": f"m{i}", "payload": {}}]}
        (root / "ann" / f"page={i}" / "part.txt").write_text(json.dumps(after | messages if first else messages | after))


@pytest.mark.parametrize("first", [True, False])
def test_batches_of_pages_grow_with_the_backlog(tmp_path, first):
    mailbox(tmp_path, 40, first)
    read = []

    class Watched(FolderTransport):
        def page(self, account, token, size):
            read.append(token)
            return super().page(account, token, size)

    r = PageStreamReader({"path": str(tmp_path), "account": "ann", "pages_per_batch": "2", "backlog_pages": "16"}, Watched)
    at, batches = r.initialOffset(), []
    while (end := r.latestOffset()) != at:
        batches.append([t for p in r.partitions(at, end) for t in p.tokens])
        at = end
    assert [len(b) for b in batches] == [2, 4, 8, 16, 10] and sum(batches, []) == [str(i) for i in range(1, 41)]
    assert len(read) == (0 if first else 40)  # a page is not read twice by the driver, and not at all where it names the next one first
    assert [m[2] for m in r.read(r.partitions(r.initialOffset(), {"account": "ann", "token": None, "pages": 40})[0])] == ["m1"]


def test_alias_expansion_cuts_a_text_once(spark):
    text = ("word " * 20000) + "invoice"
    got = spark.createDataFrame([(text,), ("Factura  invoice invoice",), ("",)], "t string").select(T.alias_expansions(F.col("t")).alias("e")).collect()
    assert got[0]["e"] == [text.replace("invoice", "factura")] and got[2]["e"] == []
    assert got[1]["e"] == ["factura factura invoice", "factura invoice factura", "invoice invoice invoice"]


def test_terms_cut_a_text_once(spark):
    terms = spark.createDataFrame([("Ab cd ab cd",)], "t string").select(T.canonical_terms(T.canonical_tokens(F.col("t"))).alias("t"))
    assert terms.first()["t"] == ["ab", "cd", "ab cd", "cd ab"] and analyzed(spark, terms).count("regexp_extract_all") == 1


def test_hits_of_a_window_are_found_once(spark):
    df = spark.createDataFrame([(["a", "b"], ["b1"] + ["x"] * 13 + ["a1"]), (["a", "b"], ["b1"] + ["x"] * 14 + ["a1"]), (["a"], ["x"])], "t array<string>, w array<string>")
    out = df.select(S.in_window(F.col("t"), F.col("w")).alias("i"))
    assert [r["i"] for r in out.collect()] == [True, False, True]
    assert analyzed(spark, out).count("startswith") == 1


def test_postings_of_documents(spark):
    rows = [(1, "one two one é1 two x"), (2, None), (3, "three " * 400), (4, "same id here"), (4, "same id there"), (None, "null one"), (None, "null two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(I.document_postings(docs)) == key(I.postings(I.chunks(docs)))
    once = docs.where("doc_id < 4")
    assert key(I.document_postings(once)) == key(I.postings(I.chunks(once)))
    assert shuffles(I.document_postings(once)) == 0


def test_only_the_head_of_a_long_text_is_cleaned(spark):
    vocab = spark.createDataFrame([("a", 1000), ("##a", 1001), ("b", 1002)], "piece string, id int")
    texts = ["a b " * 2000, "a" + " " * 3000 + "b aa", "b " * 126, "A" * 2040 + " b b", None, "-" * 2047 + "aa b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["input_ids"][1 : r["n_ids"] - 1] for r in W.encoded(docs, vocab).collect()}
    assert got == {0: [1000, 1002] * 63, 1: [1000, 1002, 1000, 1001], 2: [1002] * 126, 3: [W.UNKNOWN, 1002, 1002], 4: [], 5: [1000, 1001, 1002]}


def test_asked_vocabulary(spark):
    chunked = spark.createDataFrame([("the then other th",), ("them thou other",)], "norm string")
    asked = spark.createDataFrame([("the",), ("th",)], "token string")
    assert sorted(r["word"] for r in I.vocabulary(chunked, asked=asked).collect()) == ["the", "them", "then"]


def test_normalized_with_and_without_accents(spark):
    df = spark.createDataFrame([("Ab--c  D",), ("Éa -- ß́x",), (None,)], "t string")
    assert [r["n"] for r in df.select(T.normalized(F.col("t")).alias("n")).collect()] == ["ab c d", "ea ßx", ""]


def test_released_files_stay_where_they_are(spark):
    files = spark.range(5).select("id", F.lit("a").alias("capability"), F.lit("PACKAGE_MISSING").alias("state"))
    states = spark.range(1).select(F.lit("a").alias("capability"), F.lit("FULL").alias("state"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = Y.released(files, states)
        assert out.count() == 5 and shuffles(out) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
