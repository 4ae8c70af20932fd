"""Tables that change together, the stored index, both classes of candidates, the cosine join."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wherry.functions import text as T
from wherry.operators import hybrid as H
from wherry.operators import index as I
from wherry.operators import search as R
from wherry.operators import similar as V
from wherry.operators import stored as D
from wherry.operators.tableset import TableSet, bucket_of
from wherry.plans import stored_queries as Q


def rows_of(df):
    return sorted(map(repr, df.collect()))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def text(rng, n):
    return " ".join(rng.choice(["with", "this", "that", "thistle", "from", "fröm", "the", "thé", "in", "a", "x1", "other"]) for _ in range(n))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """An index with three batches, and the documents it should hold."""
    rng = random.Random(4)
    first = {i: text(rng, rng.randrange(0, 400)) for i in range(40)}
    index = D.StoredIndex(spark, str(tmp_path_factory.mktemp("index")), buckets=8)
    index.add(docs(spark, [*first.items(), (None, "with this")]), batch=0)
    second = {i: text(rng, 300) for i in (3, 5, 41)}
    index.add(docs(spark, list(second.items())), batch=1, gone=docs(spark, [(7, None), (5, None), (99, None)]))
    third = {3: "with this once more", 42: None}
    index.add(docs(spark, list(third.items())), batch=2)
    held = {k: v for k, v in (first | second | third).items() if k != 7}
    return index, docs(spark, list(held.items()))


QUERIES = [(1, "with this"), (2, "the"), (3, "that from"), (4, "nowhere"), (5, "with nowhere"), (6, "thé fröm with with")]


def same_as_fresh(spark, index, held):
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    for expand in (False, True):
        assert rows_of(D.search(asked, index, expand)) == rows_of(R.search(asked, held, expand))
    hashes = Q._hashes(asked)
    chunked = I.chunks(held)
    for every in (False, True):
        want = I.postings_lookup(hashes, I.canonical_postings(chunked), every).select("query_id", "doc_id", "chunk_index", "matched")
        assert rows_of(index.lookup(hashes, every).select("query_id", "doc_id", "chunk_index", "matched")) == rows_of(want)
    assert rows_of(index.words()) == rows_of(I.postings(chunked).select(F.col("token").alias("word")).distinct())


def test_batches_merge_to_what_a_fresh_index_gives(spark, stored):
    same_as_fresh(spark, *stored)


def test_a_batch_that_comes_again_changes_nothing(spark, stored):
    index, held = stored
    before = index.set.manifest()
    assert index.add(docs(spark, [(1, "other")]), batch=2) == before["version"] == index.add(docs(spark, [(1, "other")]), batch=0)
    assert index.set.manifest() == before


def test_compacted(spark, stored):
    index, held = stored
    early = index.set.manifest()
    index.compact()
    same_as_fresh(spark, index, held)
    assert len(index._segments(index.set.manifest())) == 1
    # readers of the version before still find its files until they are let go
    assert index.set.read("tokens", manifest=early).count() > index.set.read("tokens").count()
    index.set.vacuum(keep=1)
    same_as_fresh(spark, index, held)


def test_only_asked_buckets_are_read(spark, stored):
    index, _ = stored
    whole = {f.split("bucket=")[1].split("/")[0] for f in index.all_postings().inputFiles()}
    one = {f.split("bucket=")[1].split("/")[0] for f in index.postings(spark.createDataFrame([("from",)], "token string")).inputFiles()}
    assert len(one) == 1 and len(whole) > 1
    plan = index.postings(spark.createDataFrame([("from",)], "token string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*token", plan)


def test_prefixes(spark, stored):
    index, held = stored
    asked = spark.createDataFrame([(1, "th"), (2, "t"), (3, "zz")], "query_id int, token string")
    got = index.with_prefix(asked)
    chunked = I.chunks(held).collect()
    want = Counter()
    for q, p in ((1, "th"), (2, "t")):
        want[q] = sum(any(len(w) >= 2 and w.startswith(p) for w in c["norm"].split(" ")) for c in chunked)
    assert Counter(r["query_id"] for r in got.collect()) == want
    assert {r["ord"] for r in index.with_prefix(asked, limit=2).collect()} == {1, 2}


def test_an_empty_index(spark, tmp_path):
    index = D.StoredIndex(spark, str(tmp_path))
    index.add(docs(spark, []))
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    assert D.search(asked, index).count() == index.lookup(Q._hashes(asked)).count() == index.words().count() == 0


def test_both_classes(spark, tmp_path):
    lines = {1: "with this and more words", 2: "with that and this", 3: "dans les rues", 4: "dans la rue", 5: "with les nothing", 6: "dans les withal thistle"}
    index = D.StoredIndex(spark, str(tmp_path))
    index.add(docs(spark, list(lines.items())))
    rows = [(1, "with this", ["dans les"]), (2, "zzword thisx", ["nothing here at all", "dans les"])]
    queries = spark.createDataFrame(rows, "query_id int, query string, hypotheses array<string>")
    found = H.hybrid_search(queries, index).collect()
    got = {r["doc_id"]: r for r in found if r["query_id"] == 1}
    # 5 has one of the words, so it needs both; 3 is far below 6, whose words start with the query's: 2.5 + 2 * 0.8 + 4 + 0.5
    assert {i: r["canonical_only"] for i, r in got.items()} == {1: False, 2: False, 6: True}
    assert (got[6]["score"], got[6]["coverage"], got[6]["bm25"]) == (8.6, 1.0, 0.0)
    # of the second query's hypotheses the better one counts; 4 and 5 have one of three terms
    assert {r["doc_id"]: (r["score"], r["coverage"]) for r in found if r["query_id"] == 2} == {3: (3.0, 1.0), 6: (3.0, 1.0)}
    queries = queries.where("query_id = 1")
    names = spark.createDataFrame([(1, "a.pdf", "/download/a.pdf"), (2, "canonical_runtime_x", "/x"), (6, None, None)], "doc_id long, name string, path string")
    named = {r["doc_id"]: r["score"] for r in H.hybrid_search(queries, index, names).collect()}
    assert set(named) == {1, 6} and named[1] == pytest.approx(got[1]["score"] + 0.35)


def test_ten_of_each_class_stay(spark, tmp_path):
    index = D.StoredIndex(spark, str(tmp_path))
    index.add(docs(spark, [(i, "with this") for i in range(14)] + [(100 + i, "dans les") for i in range(13)]))
    queries = spark.createDataFrame([(1, "with this", ["dans les"])], "query_id int, query string, hypotheses array<string>")
    got = H.hybrid_search(queries, index).collect()
    assert Counter(r["canonical_only"] for r in got) == {False: 10, True: 10}
    assert sorted(r["rank"] for r in got) == list(range(1, 21))


# ------------------------------------------------------------------ table sets


def test_a_version_is_whole_or_not_there(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path), buckets=4)
    assert tables.versions() == []
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    with_bucket = rows.withColumn("bucket", bucket_of(F.col("k"), 4))
    base = tables.manifest()
    made = {n: tables.staged(n, with_bucket, 1, ["k"]) for n in ("one", "two")}
    assert tables.versions() == []  # staged files are no version
    tables.commit(base, made)
    assert tables.read("one").count() == tables.read("two").count() == 2
    with pytest.raises(RuntimeError):
        tables.commit(base, made)  # another writer came first
    with pytest.raises(KeyError):
        tables.read("three")


def test_cascade(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path), buckets=4)
    one = spark.createDataFrame([(i, f"a{i}") for i in range(20)] + [(None, "none")], "k long, v string")
    two = spark.createDataFrame([(i, j) for i in range(20) for j in range(i % 3)], "k long, n int")
    assert tables.cascade({"one": one, "two": two}, one, "k", 0) == 1
    first = tables.manifest()
    keys = spark.createDataFrame([(3,), (4,), (None,)], "k long")
    new = spark.createDataFrame([(3, "new")], "k long, v string")
    for _ in range(2):
        assert tables.cascade({"one": new, "two": two.limit(0)}, keys, "k", 1) == 2
    assert {(r["k"], r["v"]) for r in tables.read("one").collect()} == {(i, f"a{i}") for i in range(20) if i not in (3, 4)} | {(3, "new")}
    assert tables.read("two").where("k IN (3, 4)").count() == 0 and tables.read("two").count() == two.count() - 1
    # buckets without a changed key keep their files
    kept = [b for b, f in tables.manifest()["tables"]["one"]["files"].items() if f == first["tables"]["one"]["files"].get(b)]
    changed = {r[0] for r in keys.select(bucket_of(F.col("k"), 4)).collect()}
    assert set(map(int, kept)) == {int(b) for b in first["tables"]["one"]["files"]} - changed
    tables.vacuum(keep=1)
    assert tables.versions() == [2] and tables.read("one").count() == 19


# ------------------------------------------------------------------ similar words


def test_cosine_join_equals_all_pairs(spark):
    rng = random.Random(8)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(250)})
    asked, vocab = words[:60], words[30:]

    def grams(w):
        m = f"^{w}$"
        return Counter(m[i : i + 3] for i in range(max(len(m) - 2, 1)))

    def cosine(a, b):
        a, b = grams(a), grams(b)
        return round(sum(a[g] * b[g] for g in a) / math.sqrt(sum(x * x for x in a.values())) / math.sqrt(sum(x * x for x in b.values())), 6)

    named = lambda ws, n: spark.createDataFrame([(w,) for w in [*ws, None, ws[0]]], f"{n} string").withColumn("vector", V.character_grams(F.col(n)))
    for least in (0.82, 0.5):
        got = {(r["token"], r["word"]): r["similarity"] for r in V.similarity_join(named(asked, "token"), named(vocab, "word"), least).collect()}
        want = {(a, b): cosine(a, b) for a, b in itertools.product(asked, vocab) if cosine(a, b) >= least}
        assert got == pytest.approx(want, abs=1e-6) and len(want) > 30
    assert V.similarity_join(named(asked, "token").limit(0), named(vocab, "word")).count() == 0


def test_best_words(spark):
    pairs = spark.createDataFrame([("cat", "cats", 0.9), ("cat", "cat", 1.0), ("cat", "catt", 0.9)], "token string, word string, similarity double")
    postings = spark.createDataFrame([("cats", 1, 0), ("cat", 1, 0), ("catt", 2, 0), ("cats", 2, 0), ("dog", 3, 0)], "token string, doc_id long, chunk_index int")
    assert {tuple(r) for r in V.best_words(pairs, postings).collect()} == {("cat", 1, 0, "cat", 1.4), ("cat", 2, 0, "cats", 1.26)}


# ------------------------------------------------------------------ building moves nothing


def test_building_shuffles_no_posting(spark, tmp_path):
    """Chunks and postings are written where the documents are read: of all that an index builds only the list of ids is dealt out."""
    plans = []
    index = D.StoredIndex(spark, str(tmp_path), buckets=4)
    laid, staged = index.set.laid, index.set.staged
    index.set.laid = lambda name, rows, *a: plans.append((name, rows)) or laid(name, rows, *a)
    index.set.staged = lambda name, rows, *a: plans.append((name, rows)) or staged(name, rows, *a)
    index.add(docs(spark, [(1, "with this and that with this"), (2, None)]))
    for name, rows in plans:
        assert name == "documents" or "Exchange" not in rows._jdf.queryExecution().executedPlan().toString(), name
    assert {n for n, _ in plans} == {"documents", "chunks", "tokens", "terms"}
    assert {(r["token"], r["doc_id"], tuple(r["places"]), r["n_words"]) for r in index.all_postings().collect()} == {
        ("with", 1, (0, 4), 6), ("this", 1, (1, 5), 6), ("and", 1, (2,), 6), ("that", 1, (3,), 6)
    }


def test_postings_come_when_they_are_asked_for(spark, tmp_path):
    index = D.StoredIndex(spark, str(tmp_path), buckets=4, postings=("terms",))
    index.add(docs(spark, [(1, "with this"), (2, "that from")]))
    index.add(docs(spark, [(2, "with this with this")]), batch=1)
    assert "tokens" not in index.set.manifest()["tables"]
    asked = spark.createDataFrame([(1, "with this")], "query_id int, query string")
    assert {tuple(r) for r in index.lookup(Q._hashes(asked)).select("doc_id", "matched", "tf").collect()} == {(1, 3, 3), (2, 3, 6)}
    index.derive("tokens")
    assert index.derive("tokens") == index.set.manifest()["version"]
    assert {(r["word"]) for r in index.words().collect()} == {"with", "this"}
    index.add(docs(spark, [(3, "from them")]), batch=2)
    assert {(r["word"]) for r in index.words().collect()} == {"with", "this", "from", "them"}


def test_new_rows_of_a_cascade_stay_where_they_are(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path), buckets=4)
    plans, laid = [], tables.laid
    tables.laid = lambda name, rows, *a: plans.append(rows) or laid(name, rows, *a)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    tables.cascade({"one": rows}, rows, "k", 0)
    assert len(plans) == 1 and "Exchange" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in tables.read("one").collect()} == {(1, "a"), (2, "b")}


def shuffled(df):
    """The keys of a plan's hash exchanges."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    return re.findall(r"Exchange hashpartitioning\((\w+)#", plan)


def test_a_search_moves_lists_by_block_and_no_chunk_by_query(spark, stored):
    index, held = stored
    index.compact()
    hits = index.hits(index.written(R.understood(spark.createDataFrame(QUERIES, "query_id int, query string"))))
    assert set(shuffled(hits)) <= {"block"}
    assert shuffled(index.lookup(Q._hashes(spark.createDataFrame(QUERIES, "query_id int, query string")))).count("query_id") <= 1


def test_words_move_once_to_be_compared(spark):
    """The vocabulary is made distinct; neither its vectors nor its dimensions move, and words that are equal are found as well."""
    asked = spark.createDataFrame([("cats",), ("dogs",)], "token string").withColumn("vector", V.character_grams(F.col("token")))
    vocab = spark.createDataFrame([("cats",), ("catsx",), ("bird",), ("dogs",), ("dogs",)], "word string").distinct().withColumn("vector", V.character_grams(F.col("word")))
    found = V.similarity_join(asked, vocab, 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(word") == 1 and "hashpartitioning(dim" not in plan
    assert {(r["token"], r["word"]) for r in found.collect()} == {("cats", "cats"), ("cats", "catsx"), ("dogs", "dogs")}


def test_best_words_of_lists(spark, tmp_path):
    """Chunks are grouped by block and token, of an index of one segment and of two."""
    index = D.StoredIndex(spark, str(tmp_path), buckets=4, postings=("tokens",))
    pairs = spark.createDataFrame([("with", "with", 1.0), ("with", "width", 0.9), ("this", "that", 0.85), ("that", "that", 1.0)], "token string, word string, similarity double")
    for batch, some in enumerate([[(1, "with this and that with this"), (2, "width that"), (3, None)], [(2, "with width"), (4, "that that")]]):
        index.add(docs(spark, some), batch=batch)
        got = V.best_listed(pairs, index.lists())
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in V.best_words(pairs, index.all_postings()).collect()}
        assert got.where("doc_id = 2 AND token = 'with'").first()["word"] == ("width", "with")[batch]


def test_index_of_terms_alone(spark, tmp_path):
    """Without texts an index answers lookups, after changes too, and has no chunks on disk; with texts but without terms the lists are made on the way."""
    hashes = spark.createDataFrame([(1, "with"), (1, "this"), (1, "with this")], "query_id int, term string").select("query_id", T.hash_of(F.col("term")).alias("hash"))
    some = [[(1, "with this and that with this"), (2, "with that"), (3, None)], [(2, "this"), (4, "with this")]]
    got = []
    for name, options in (("all", {}), ("terms", {"postings": ("terms",), "texts": False}), ("none", {"postings": ()})):
        index = D.StoredIndex(spark, f"{tmp_path}/{name}", buckets=4, **options)
        for batch, rows in enumerate(some):
            index.add(docs(spark, rows), batch=batch, gone=docs(spark, [(3, "")]).select("doc_id") if batch else None)
        got.append([{tuple(r) for r in index.lookup(hashes, every).collect()} for every in (False, True)])
        assert ("chunks" in index.set.manifest()["tables"]) == (name != "terms") and ("terms" in index.set.manifest()["tables"]) == (name != "none")
    assert got[0] == got[1] == got[2] and got[0][1] == {(1, 1, 0, 3, 6), (1, 4, 0, 3, 3)}
    with pytest.raises(ValueError, match="texts"):
        D.StoredIndex(spark, f"{tmp_path}/terms", buckets=4).compact()
