"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import STEP, WORD, dropped, grouped, hashed, mixed, powers, rows_kept, small_batches, texts_of, word_codes, written

#: Labelled rows that a model is fitted on, at most, taken in the order of a hash of their id,
#: and the bytes of their texts (a text beyond them is left out whole, never cut).
SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 64_000_000
#: Character n-grams of ``<word>``, besides the whole of it.
GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
DIM = 4
#: Subwords that fewer texts of the sample hold get no vector, nor do those whose share of toxic
#: texts is within so many standard errors of the sample's, so noisy labels are not learnt by
#: heart. Of these screens the one with the least loss on folds of the training sample is taken.
MIN_TEXTS = 3
SCREENS = (4.0, 5.0, 6.0, 7.0)
FOLDS = 3
STEPS = 60
RATE = 0.03
DECAY = 1e-5
#: Means over long texts are small; this fixed factor brings a word in a thousand to unit size.
SCALE = 1000.0
CUT = 0.7
SEED = 11


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def subwords(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, grams=GRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of the n-grams of each ``<word>`` and of the whole of it, kind by kind."""
    size = ends - starts + 2
    first = np.cumsum(size) - size
    total = int(size.sum())
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(total) - first[word]
    inner = (place > 0) & (place < size[word] - 1)
    chars = np.where(place == 0, ord("<"), ord(">")).astype(np.uint64)
    chars[inner] = codes[(starts[word] + place - 1)[inner]]
    chars = mixed(chars + STEP)
    even = np.uint64(buckets - 1) if buckets & (buckets - 1) == 0 else None
    bucket = lambda h: (mixed(h) % np.uint64(buckets) if even is None else mixed(h) & even).astype(np.int32)
    if total:
        yield bucket(np.add.reduceat(chars * powers(int(size.max()))[place], first)), np.arange(len(size))
    rest = size[word] - place  # characters of the word from here on
    h = np.zeros(total, dtype=np.uint64)
    for n in range(1, min(max(grams, default=0), total) + 1):
        h[: total - n + 1] += chars[n - 1 :] * powers(n)[n - 1]
        if n in grams:
            at = np.nonzero((rest >= n) & (size[word] > n))[0]
            yield bucket(h[at] + np.uint64(n)), word[at]


def subword_counts(size: np.ndarray, grams=GRAMS) -> np.ndarray:
    """Subwords of words of ``size`` characters."""
    return 1 + sum(np.where(size + 2 > n, size + 3 - n, 0) for n in grams)


class _Rows:
    """Sparse rows that multiply a matrix, either way round."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int]) -> None:
        self.shape, self.sides = shape, []
        for key, other in ((row, col), (col, row)):
            order = np.argsort(key, kind="stable")
            ends, first = np.unique(key[order], return_index=True)
            self.sides.append((ends, first, other[order], val[order].astype(np.float32)[:, None]))

    def _product(self, side: int, m: np.ndarray) -> np.ndarray:
        ends, first, other, val = self.sides[side]
        out = np.zeros((self.shape[side], m.shape[1]), np.float32)
        if len(ends):
            out[ends] = np.add.reduceat(val * m[other], first, axis=0)
        return out

    def times(self, m: np.ndarray) -> np.ndarray:
        return self._product(0, m)

    def back(self, m: np.ndarray) -> np.ndarray:
        return self._product(1, m)


class SubwordModel:
    """Mean of word vectors (each the mean of its subword vectors), then a two-class softmax."""

    def __init__(self, table: np.ndarray, bias: float, buckets: int = BUCKETS, grams=GRAMS) -> None:
        self.table, self.bias, self.buckets, self.grams = table, bias, buckets, grams

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for text, of, at in grouped(texts):
            codes, starts, ends = word_codes(text)
            if not len(starts):
                continue
            _, one, which = np.unique(hashed(codes, starts, ends), return_index=True, return_inverse=True)  # a word that repeats is scored once
            each = np.zeros(len(one))
            for bucket, word in subwords(codes, starts[one], ends[one], self.buckets, self.grams):
                each += np.bincount(word, self.table[bucket], len(one))
            each = (each / subword_counts((ends - starts)[one], self.grams))[which]
            text_of = np.array(of)[np.searchsorted(at, starts, side="right") - 1]
            total += np.bincount(text_of, each, len(texts))
            count += np.bincount(text_of, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) * SCALE + self.bias, -30, 30)))


class Sample:
    """Labelled texts as flat arrays: the buckets of each word, and each text's distinct words and their counts.

    ``fold`` deals the texts of each class out in turn; ``texts_with`` counts, by fold, class and
    bucket, the texts that hold the bucket.
    """

    def __init__(self, texts: list[str | None], labels: list[int], folds: int = FOLDS, buckets: int = BUCKETS, grams=GRAMS) -> None:
        self.y, self.buckets, self.grams = np.asarray(labels, dtype=np.float32), buckets, grams
        self.fold = np.empty(len(self.y), dtype=np.int64)
        for v in (0, 1):
            of = np.nonzero(self.y == v)[0]
            self.fold[of] = np.arange(len(of)) % folds
        self.texts_with = np.zeros((folds, 2, buckets), dtype=np.int32)
        index: dict[str, int] = {}
        held, self.length = [], []
        for text in texts:
            count = Counter(words_of(text))
            for w in count:
                if w not in index:
                    index[w] = len(index)
            word = np.fromiter((index[w] for w in count), dtype=np.int32, count=len(count))
            held.append((word, np.fromiter(count.values(), dtype=np.int32, count=len(count))))
            self.length.append(max(1, sum(count.values())))
        flat = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.empty(0, t)
        gram, gram_of, done = [], [], 0
        for text, _, _ in grouped([" ".join(index)]):  # words are runs without a gap, so they come back as they are
            codes, starts, ends = word_codes(text)
            for bucket, word in subwords(codes, starts, ends, buckets, grams):
                gram.append(bucket)
                gram_of.append(word + done)
            done += len(starts)
        order = np.argsort(flat(gram_of, np.int32), kind="stable")
        self.gram, self.gram_of = flat(gram, np.int32)[order], flat(gram_of, np.int32)[order]
        self.grams_each = np.bincount(self.gram_of, minlength=len(index)).astype(np.float32)
        begin = np.concatenate([[0], np.cumsum(self.grams_each.astype(np.int64))])
        for (word, _), fold, label in zip(held, self.fold, self.y.astype(int), strict=True):
            if len(word):
                self.texts_with[fold, label, np.unique(np.concatenate([self.gram[begin[i] : begin[i + 1]] for i in word.tolist()]))] += 1
        self.word, self.times = flat([w for w, _ in held], np.int32), flat([n for _, n in held], np.float32)
        self.text_of = np.repeat(np.arange(len(held)), [len(w) for w, _ in held])
        self.length = np.array(self.length, dtype=np.float32)

    def kept(self, folds: list[int], min_texts: int, min_z: float) -> np.ndarray:
        """Buckets that pass the screen on the texts of ``folds``."""
        clean, toxic = self.texts_with[folds].sum(axis=0).astype(np.float64)
        seen, share = clean + toxic, self.y[np.isin(self.fold, folds)].mean()
        z = np.abs(toxic - share * seen) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
        return np.nonzero((seen >= min_texts) & (z >= min_z))[0]

    def matrices(self, rows: np.ndarray, kept: np.ndarray) -> tuple[_Rows, _Rows]:
        """Texts by words and words by kept buckets; rows of each are means."""
        column = np.full(self.buckets, -1, dtype=np.int32)
        column[kept] = np.arange(len(kept))
        good = column[self.gram] >= 0
        has = np.zeros(len(self.grams_each), dtype=bool)
        has[self.gram_of[good]] = True  # the other words are only in the mean's denominator
        place = np.cumsum(has) - 1
        of = self.gram_of[good]
        words = _Rows(place[of], column[self.gram[good]], 1 / self.grams_each[of], (int(has.sum()), len(kept)))
        at = np.full(len(self.y), -1, dtype=np.int64)
        at[rows] = np.arange(len(rows))
        mine = (at[self.text_of] >= 0) & has[self.word]
        text = self.text_of[mine]
        return _Rows(at[text], place[self.word[mine]], self.times[mine] / self.length[text], (len(rows), int(has.sum()))), words


def gradients(texts: _Rows, words: _Rows, p: dict[str, np.ndarray], target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of the softmax over mean vectors, and its gradient with weight decay."""
    mean = texts.times(words.times(p["e"])) * SCALE
    z = mean @ p["w"] + p["b"]
    z -= z.max(1, keepdims=True)
    q = np.exp(z)
    q /= q.sum(1, keepdims=True)
    err = (q - target) / len(target)
    g = {"e": words.back(texts.back((err @ p["w"].T) * SCALE)) + DECAY * p["e"], "w": mean.T @ err + DECAY * p["w"], "b": err.sum(0)}
    return float(-(target * np.log(np.maximum(q, 1e-12))).sum() / len(target)), g


def trained_on(sample: Sample, folds: list[int], min_texts: int, min_z: float, steps: int, dim: int, rate: float, seed: int) -> SubwordModel:
    """Subword vectors and softmax weights by Adam on all texts of ``folds`` at once; vectors start at zero."""
    rows = np.nonzero(np.isin(sample.fold, folds))[0]
    y = sample.y[rows]
    kept = sample.kept(folds, min_texts, min_z)
    texts, words = sample.matrices(rows, kept)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    rng = np.random.default_rng(seed)
    p = {"e": np.zeros((len(kept), dim), np.float32), "w": rng.normal(0, 1, (dim, 2)).astype(np.float32), "b": np.array([0.0, np.log(prior / (1 - prior))], np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    target = np.stack([1 - y, y], 1)
    for t in range(1, steps + 1):
        _, g = gradients(texts, words, p, target)
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    table = np.zeros(sample.buckets, np.float32)
    table[kept] = p["e"] @ (p["w"][:, 1] - p["w"][:, 0])
    return SubwordModel(table, float(p["b"][1] - p["b"][0]), sample.buckets, sample.grams)


def loss(sample: Sample, rows: np.ndarray, model: SubwordModel) -> float:
    """Mean cross-entropy of the model's scores of ``rows``."""
    each = np.bincount(sample.gram_of, model.table[sample.gram], len(sample.grams_each)) / sample.grams_each
    mean = np.bincount(sample.text_of, each[sample.word] * sample.times, len(sample.y)) / sample.length
    q = 1 / (1 + np.exp(-np.clip(mean[rows] * SCALE + model.bias, -30, 30)))
    return float(-np.where(sample.y[rows] > 0, np.log(q), np.log(1 - q)).mean())


def fit(
    texts: list[str | None], labels: list[int], steps: int = STEPS, dim: int = DIM, min_texts: int = MIN_TEXTS, screens: tuple[float, ...] = SCREENS,
    folds: int = FOLDS, rate: float = RATE, buckets: int = BUCKETS, grams=GRAMS, seed: int = SEED,
) -> SubwordModel:
    """The model of all rows, under the screen whose models of the other folds have the least loss on each fold.

    A subword that the sample lacks says nothing; one class only, or no rows, gives that class's
    smoothed share as every score. Equal losses: the strictest screen.
    """
    sample = Sample(texts, labels, folds, buckets, grams)
    y = sample.y
    if not len(y) or y.min() == y.max():
        prior = (y.sum() + 0.5) / (len(y) + 1.0)
        return SubwordModel(np.zeros(buckets, np.float32), float(np.log(prior / (1 - prior))), buckets, grams)
    how = (steps, dim, rate, seed)
    every = list(range(folds))
    best = max(screens)
    if len(screens) > 1 and min((y == 0).sum(), (y == 1).sum()) >= folds > 1:
        others = lambda f: [g for g in every if g != f]
        losses = {z: sum(loss(sample, np.nonzero(sample.fold == f)[0], trained_on(sample, others(f), min_texts, z, *how)) for f in every) for z in screens}
        best = min(sorted(screens, reverse=True), key=losses.__getitem__)
    return trained_on(sample, every, min_texts, best, *how)


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str | None], list[int]]:
    """At most ``rows`` training texts with their labels, half of them toxic if there are as many.

    Of an id with several texts the one with the least hash is taken. Texts come to the driver in
    the order of a hash of their id while their bytes are within ``most_bytes``.
    """
    spark = docs.sparkSession
    mine = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    mine = mine.where((F.crc32(F.col("doc_id").cast("string")) % 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ordered = lambda v: mine.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
    picked = [(r[0], r[1]) for v in (0, 1) for r in ordered(v).collect()]
    if not picked:
        return [], []
    ids = spark.createDataFrame(picked, "doc_id long, toxic int")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most ``rows`` ids; repeats of an id are brought together where it has several texts
    found = text.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found, path = written(found, "labelled")
    order = F.xxhash64("doc_id")
    sizes = found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), order.alias("h")).collect()
    room, taken = most_bytes, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= room:
            room -= r["n"]
            taken.append((r["doc_id"],))
    chosen = found.join(F.broadcast(spark.createDataFrame(taken, "doc_id long")), "doc_id").select("doc_id", "text", "toxic").toArrow()
    dropped(spark, path)
    got = sorted(zip(*(chosen.column(i).to_pylist() for i in range(3)), strict=True), key=lambda r: r[0])
    return [r[1] for r in got], [r[2] for r in got]


def prior_shift(labels: DataFrame, sample: list[int]) -> float:
    """What to add to the bias since the sample has classes in other shares than the labels."""
    row = labels.where((F.crc32(F.col("doc_id").cast("string")) % 3) != 1).agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    pos, neg = sum(sample), len(sample) - sum(sample)
    if not (row[0] and row[1] and pos and neg):
        return 0.0
    return float(np.log(row[0] / row[1]) - np.log(pos / neg))


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **how) -> SubwordModel:
    texts, y = sampled(docs, labels, rows)
    model = fit(texts, y, **how)
    model.bias += prior_shift(labels, y)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= ``cut``).

    The model is fitted on a bounded sample (``sample_rows``) of the labelled rows whose
    crc32(doc_id) mod 3 is not 1, and scores every whole text by its words alone.

    Null and empty texts get the score of the bias alone. A null doc_id is not held out.
    Repeated rows get a row each; several labels of one id count as the largest; without
    labels every score is one half. Other columns are ignored; empty tables give empty results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(trained(docs, labels, sample_rows))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_of(batch, "text"):
                score = pa.array(model.value.scores(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), score], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``cut``."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample_rows))
    return rows_kept(docs, lambda: lambda texts: (model.value.scores(texts) < cut).tolist())
