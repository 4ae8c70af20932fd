"""Each stage of the pipeline against a brute-force version on its own input."""

import pytest

import corpus_pipeline as P
from wherry.llm import toxicity
from wherry.llm.shared import written


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tables = [docs]
    for name, stage in P.STAGES:
        tables.append(written(stage(spark, tables[-1], data), name.replace(" ", "-"))[0])
    return tables


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert all(t.columns == stages[0].columns for t in stages[:-1])
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids", "parity"]


def test_toxicity_drops_what_it_rejects(spark, data, stages):
    scored = toxicity.toxicity(stages[0], spark.read.parquet(f"{data}/labels.parquet")).collect()
    assert set(texts(stages[1])) == {r["doc_id"] for r in scored if not r["predicted"]}
    assert stages[1].count() > 0.8 * stages[0].count()


def test_lines(stages):
    from collections import defaultdict

    rows = stages[1].collect()
    sites = defaultdict(set)
    for r in rows:
        for line in r["text"].split("\n"):
            sites[line.strip(" \t\r\x0b\x0c")].add(r["source"])
    got = texts(stages[2])
    for r in rows:
        lines = r["text"].split("\n")
        kept = "\n".join(x for x in lines if not x.strip() or len(sites[x.strip(" \t\r\x0b\x0c")]) < 10)
        whole = not kept.strip()  # a copy
        assert got[r["doc_id"]] == (r["text"] if whole else kept)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_duplicates(stages):
    from .test_operators import jaccard, shingle_set

    before, after = texts(stages[2]), texts(stages[3])
    sets = {i: shingle_set(t) for i, t in before.items()}
    root = {i: i for i in before}
    ids = sorted(before)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and root[a] != root[b] and jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert set(after) == {i for i in ids if root[i] == i}
    assert all(after[i] == before[i] for i in after)


def test_benchmark(spark, data, stages):
    from .test_operators import brute

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before = texts(stages[3])
    leaks = {d for d, _ in brute(list(before.items()), items, 0.8)}
    assert set(texts(stages[4])) == set(before) - leaks


def test_tokens(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts(stages[4]))
    assert all(r["parity"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_run_equals_its_stages(spark, data, stages):
    assert P.run(spark, data).count() == stages[5].count()


def test_odd_rows_and_columns(spark, data):
    """Nulls, repeated rows, an empty table and further columns pass every stage."""
    from pyspark.sql import functions as F

    rows = [(1, "one two three four five six seven", "en", "a", 5), (1, "one two three four five six seven", "en", "a", 5), (2, None, None, None, None), (None, "x", "en", "b", 1), (3, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(1), "rep": F.lit(2), "keys": F.lit(3), "__text": F.lit(4), "__id": F.lit(5), "ID": F.lit(6), "text_hash": F.lit(7)})
    for table, left in ((docs, 4), (docs.limit(0), 0)):  # of the two rows that repeat, one stays
        for name, stage in P.STAGES:
            out = written(stage(spark, table, data), "odd")[0]
            assert name == "sentencepiece" or out.columns == table.columns
            table = out
        assert table.count() == left


def test_rows_are_judged_by_their_own_text(spark, tmp_path):
    """One id on two texts, and null ids: toxic, contaminated and duplicated rows go, and no others."""
    import random

    from .test_operators import sentence

    rng = random.Random(5)
    body = lambda: sentence(rng, 60, 3000)
    vile = lambda: " ".join([*body().split(), *["loathsome", "wretched"] * 4])
    labelled = [(1000 + i, vile() if i % 2 else body(), "en", "a", 1) for i in range(300)]
    item = sentence(rng, 40, 3000)
    a, b, c = body(), body(), body()
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, c + " more"), (5, vile()), (5, "clean " + body()), (None, vile()), (6, f"{body()} {item}"), (6, body()), (None, f"{item} {body()}")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows] + labelled, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, n % 2) for n, (i, *_) in enumerate(labelled)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mine = lambda df: sorted((r["text"] for r in df.collect() if r["doc_id"] is None or r["doc_id"] < 1000))
    texts_ = [t for _, t in rows]
    calm = mine(P.drop_toxic(spark, docs, str(tmp_path)))
    assert calm == sorted(t for t in texts_ if "loathsome" not in t)
    plain = docs.where("text NOT LIKE '%loathsome%'")
    assert mine(P.drop_benchmark(spark, plain, str(tmp_path))) == sorted(t for t in texts_ if "loathsome" not in t and item not in t)
    once = mine(P.drop_near_duplicates(spark, plain, str(tmp_path)))
    assert sorted(once) == sorted([a, b, min(c, c + " more", key=lambda t: once.index(t) if t in once else 99)] + [t for i, t in rows[7:] if "loathsome" not in t])
