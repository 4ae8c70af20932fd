"""Row patterns, centroid clusters and chunked BPE: brute force, edge cases, parity with the library."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wherry.llm import bpe_codec as B
from wherry.llm import clustering as C
from wherry.llm import queries
from wherry.llm import row_pattern as R

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLASH = ("key", "time", "id", "tie", "part", "place", "chain", "cents", "valid", "bits", "labels", "what", "n", "before", "digest")
NOON = dt.datetime(2024, 1, 1, 12)


def click(i, client, minutes, kind, value, props="{}"):
    return (i, None if minutes is None else NOON + dt.timedelta(minutes=minutes), NOON, client, kind, None if value is None else float(value), props)


def brute_matches(rows):
    """Tries every way, longest first, from every start."""
    out = []
    for client in sorted({r[3] for r in rows if r[3] is not None}):
        own = sorted({r for r in rows if r[3] == client and r[1] is not None}, key=lambda r: (r[1], r[0]))
        cents = [math.floor(100 * r[5] + 0.5) if r[5] is not None and math.isfinite(r[5]) else None for r in own]

        def fits(letter, i, s):
            if i >= len(own) or cents[i] is None or cents[i - 1] is None or own[i][1] - own[i - 1][1] > dt.timedelta(minutes=30):
                return False
            kind = own[i][4]
            if letter == "P":
                return kind == "click" and cents[i] >= cents[s]
            return kind is not None and kind != "error" and (cents[i] < cents[i - 1] if letter == "D" else cents[i] > cents[i - 1])

        def runs(letter, i, s):
            """Ends of one or more of a letter, longest first."""
            e = i
            while fits(letter, e, s):
                e += 1
            return range(e, i, -1)

        def groups(i, s, said):
            for d in runs("D", i, s):
                for u in runs("U", d, s):
                    more = said + "D" * (d - i) + "U" * (u - d)
                    yield from groups(u, s, more)
                    yield u, more

        no = 0
        for s in range(len(own)):
            if cents[s] is None:
                continue
            for e, said in groups(s + 1, s, "A"):
                if fits("P", e, s):
                    e, said = e + 1, said + "P"
                no += 1
                out.append((client, no, own[s][0], own[e - 1][0], e - s, sum(cents[s:e]), said))
                break
    return out


def matches_of(df, **how):
    return sorted(tuple(r) for r in R.row_matches(df, **how).collect())


def clicks(spark, rows):
    return spark.createDataFrame(rows, CLICKS).withColumns({c: F.lit(7) for c in CLASH})


@pytest.mark.parametrize("seed", range(3))
def test_matches_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, at = [], {}
    for i in range(700):
        client = rng.choice([1, 1, 1, 2, 3, None])
        at[client] = at.get(client, 0) + rng.choice([0, 0.5, 1, 5, 30, 30.00001, 40] if seed else [0.1])
        kind = rng.choice(["click", "view", "click", "view", "purchase"] + ["error", None] * (seed > 0))
        value = rng.choice([1, 2, 3, 4, 5.005, -1, 1.0049] * 6 + [None, float("nan"), float("inf")] * (seed > 0))
        rows.append(click(i, client, at[client] if rng.random() < 0.98 else None, kind, value))
    rows += rng.sample(rows, 60)
    assert matches_of(clicks(spark, rows)) == sorted(brute_matches(rows))


def test_segments_over_several_partitions(spark):
    """One client's rows form a segment longer than a partition; another's ends inside one."""
    rows = [click(i, 1, i, "click" if i % 7 == 0 else "view", [5.0, 4.0, 4.5, 3.0, 6.0][i % 5]) for i in range(300)]
    rows += [click(1000 + i, 2, i, "view", float(i % 3)) for i in range(50)]
    df = clicks(spark, rows)
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = matches_of(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])
    assert got == sorted(brute_matches(rows)) and len(got) > 100


def test_matches_odd_rows(spark):
    assert matches_of(clicks(spark, []).limit(0)) == []
    # a null value parts its neighbours; equal values are no step; null ids come first
    rows = [click(1, 1, 0, None, 5.0), click(2, 1, 1, "view", 4.0), click(None, 1, 2, "view", None), click(3, 1, 3, "view", 6.0), click(4, 1, 4, "view", 6.0)]
    assert matches_of(clicks(spark, rows)) == []
    rows = [click(None, 1, 0, None, 5.0), click(2, 1, 1, "view", 4.0), click(3, 1, 2, "view", 6.0), click(4, 1, 3, "click", 5.0)]
    assert matches_of(clicks(spark, rows)) == [(1, 1, None, 4, 4, 2000, "ADUP")]
    # rows that differ in a further column are different rows
    twice = [click(1, 1, 0, "view", 5.0), click(2, 1, 1, "view", 4.0), click(2, 1, 1, "view", 4.0, "other"), click(3, 1, 2, "view", 6.0)]
    assert matches_of(clicks(spark, twice)) == []
    assert matches_of(clicks(spark, twice), pattern="A U") == [(1, 1, 2, 3, 2, 1000, "AU")]


def test_other_patterns(spark):
    rows = [click(i, 1, i, "click", v) for i, v in enumerate([3.0, 2.0, 1.0, 4.0, 2.5, 3.5])]
    assert [m[-1] for m in matches_of(clicks(spark, rows), pattern="A D{2} P")] == ["ADDP"]
    assert [m[-1] for m in matches_of(clicks(spark, rows), pattern="A")] == ["A"] * 6
    for bad in ("D A", "A A", "A* D", "A|D"):
        with pytest.raises(ValueError):
            R.compiled(bad)


def test_goals_are_switched_off_by_ascending_cents():
    t = {"cents": np.array([500, 400, 450, 470, 300, 460]), "time": np.arange(6), "key": np.zeros(6, int), "chain": np.zeros(6, int), "valid": np.ones(6, bool), "bits": np.full(6, 3)}
    sym, on = R._symbols(t, 10)
    assert bytes(sym) == b"xduudu"
    # from 500 no later row reaches the start's cents; from 400 only after ups, when the goal went down
    assert R.matched(t, sym, on, R.compiled(R.PATTERN)) == [(0, 6, b"ADUUDU"), (3, 6, b"ADU")]


# ------------------------------------------------------------------ clusters


def brute_clusters(rows, k=C.CENTROIDS, rounds=C.ROUNDS):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(by[n]) for x in zip(*by[n], strict=True)] if n in by else c for n, c in enumerate(centroids)]
    return sorted(((i if i is not None else -1), near(v)[1], near(v)[0]) for i, v in kept), centroids


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(7) for c in ("v", "guess", "cluster", "distance", "key", "centroid")})


def test_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2) * (1 + i % 4))) for _ in range(64)]) for i in range(150)]
    rows += rows[:5] + [(None, rows[0][1]), (None, rows[7][1]), (200, [0.0] * 64), (201, [-0.0] * 64)]
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] + [1.0] * 63), (306, [float("-inf")] + [1.0] * 63)]
    out, final = C.clustered(vectors(spark, rows + odd), k=12)
    got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"]) for r in out.collect())
    want, centroids = brute_clusters(rows + odd, 12)
    assert got == want and final.tolist() == centroids


def test_clusters_of_few_and_no_vectors(spark):
    assert C.centroid_clusters(vectors(spark, []).limit(0)).count() == 0
    got = C.centroid_clusters(vectors(spark, [(1, [0.5] * 64), (2, [0.25] * 64)])).collect()
    assert {(r["vec_id"], r["distance"], r["cluster_inertia"], r["inertia"]) for r in got} == {(1, 0, 0, 0), (2, 0, 0, 0)}
    # alike in all: the smaller number takes both, the other stays where it was
    got = C.centroid_clusters(vectors(spark, [(1, [0.5] * 64), (1, [0.5] * 64)])).collect()
    assert [r["cluster"] for r in got] == [0, 0]
    # too large for a distance in a long
    assert C.centroid_clusters(vectors(spark, [(1, [3e38] + [0.0] * 63), (2, [0.5] * 64)])).count() == 1


@pytest.mark.parametrize("guessed", [False, True])
def test_annulus_search_is_exact_and_saves_comparisons(guessed):
    rng = np.random.default_rng(3)
    centroids = rng.integers(-300, 300, (40, 64)) * rng.integers(1, 9, (40, 1))
    x = np.concatenate([rng.integers(-300, 300, (500, 64)) * rng.integers(1, 9, (500, 1)), centroids, (centroids[:20] + centroids[20:]) // 2])
    every = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    search = C.Annulus(centroids)
    where, dist = search.nearest(x, rng.integers(0, 40, len(x)) if guessed else None)
    assert (where == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
    assert search.compared < every.size


def test_annulus_keeps_ties_on_the_boundary():
    # all at one distance, with norms at both edges of the annulus
    centroids = np.array([[8, 0], [0, 0], [4, 4], [4, -4]])
    where, dist = C.Annulus(centroids).nearest(np.array([[4, 0]]), np.array([0]))
    assert (where.tolist(), dist.tolist()) == ([0], [16])
    assert C.Annulus(centroids[::-1].copy()).nearest(np.array([[4, 0]]))[0].tolist() == [0]


# ------------------------------------------------------------------ BPE


def odd_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeiouxyzé") for _ in range(rng.randrange(1, 9)))
    shared = " ".join(word() for _ in range(900))
    texts = [None, "", " ", "\n\t ", "a", "Don't STOP!! 12.5%", "é ́x ﬁ İ ẞ   y", "<|endoftext|> and <|startoftext|>glued", "中文字" * 500, "x" * 30_000, "!?" * 9_000]
    texts += [word() + " " + shared, shared + "\n\n" + word(), "y" * 5000 + " " + shared, shared + "<|endoftext|>" * 300, "  \n ".join(word() for _ in range(3000)), "à " * 4000]
    texts += ["".join(rng.choice("ab \n\t\r'.é́<|>1　") for _ in range(rng.randrange(1, 3000))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("memo", [B.MEMO_BYTES, 2000])
def test_chunked_ids_equal_the_library(name, memo):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    texts = odd_texts()
    codec = B.Codec(open(path, encoding="utf-8").read(), memo_bytes=memo)
    for _ in range(2):  # the second time from what is remembered
        for text, (ids, said) in zip(texts, codec.encode(texts), strict=True):
            want = whole.encode(text or "", add_special_tokens=False).ids
            assert ids.tolist() == want
            assert said == whole.decode(want, skip_special_tokens=False)
    assert codec.reused > 0 and codec.held <= 2 * memo + (1 << 20)


def test_a_tokenizer_whose_words_hang_together_is_still_exact():
    """Without a pre-tokenizer merges go over white space: joins disagree and widen up to whole texts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    made = Tokenizer.from_file(path)
    made.pre_tokenizer = None
    made.normalizer = None
    text = " ".join(["thequickbrown fox's"] * 200)
    codec = B.Codec(made.to_str())
    assert codec.encode([text])[0][0].tolist() == made.encode(text, add_special_tokens=False).ids


def test_chunks_follow_the_content():
    rng = random.Random(2)
    shared = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))
    chunks = lambda t: {t[a:b] for a, b in zip([0, *B.cuts(t)], B.cuts(t), strict=False)}
    one, two = chunks("short lead " + shared), chunks("another, longer lead-in text " * 5 + shared)
    assert len(one & two) >= len(one) - 3
    for t in ("", "a", shared, "z" * 50_000):
        assert "".join(t[a:b] for a, b in zip([0, *B.cuts(t)], B.cuts(t), strict=False)) == t
        assert all(b - a <= B.MOST for a, b in zip([0, *B.cuts(t)], B.cuts(t), strict=False))


def test_bpe_over_a_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    whole = Tokenizer.from_file(B.default_path())
    got = {r["doc_id"]: r for r in queries.op13_bpe(spark, data).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "two words"), (3, ""), (4, "Two  Words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("ids", "n_tokens", "decoded")})
    coded = B.encode(df)
    got = coded.collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded"]) for r in got) == [(0, 2, "two</w> words</w>"), (1, 0, ""), (1, 0, ""), (3, 0, ""), (4, 2, "two</w> words</w>")]
    assert sorted(r["text"] for r in B.decode(coded).collect()) == sorted(r["decoded"] for r in got)
    assert B.encode(df.limit(0)).count() == 0
