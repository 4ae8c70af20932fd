"""Benchmark decontamination: SimHash windows of item size, Hamming blocks, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, left, rows_kept, shingles, small_batches, texts_of, word_hashes, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Differing fingerprint bits within which every pair is found: with 4 blocks of 16 bits, two
#: fingerprints that differ in 7 bits or fewer differ in at most one bit of some block, so items
#: stand under each of their blocks' values and under the 16 values next to it.
RADIUS = 7
BLOCKS = 4
#: Items of a size class differ in words by at most this factor; windows take this share of
#: the class's shortest item, and start so often that PROBES of them lie wholly inside every
#: occurrence (items of a few words have room for fewer).
CLASS_RATIO = 1.25
WINDOW_SHARE = 0.7
PROBES = 2
#: Words whose running bit counts are held at a time (windows of more than half of it are summed
#: over several pieces), and words of the items of one index.
STREAM_WORDS = 1 << 13
INDEX_WORDS = 200_000
#: Long windows compared with an index at a time.
LONG_WINDOWS = 64
#: Words by which a candidate is shifted to find its best alignment.
SHIFT = 4

OUT = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def fingerprints(words: np.ndarray, size: int, stride: int) -> np.ndarray:
    """SimHash (n, 8 bytes) of each window of ``size`` words, weighted by how often a word stands in it."""
    starts = np.arange(0, len(words) - size + 1, stride)
    if len(starts) == 0:
        return np.empty((0, 8), dtype=np.uint8)
    if is_long(size):
        return _long_windows(words, size, starts)
    return _windows(_bit_sums(words), size, starts)


def is_long(size: int) -> bool:
    """Whether windows of ``size`` words are too long for one piece."""
    return 2 * size > STREAM_WORDS


#: The bits of a byte as eight 16-bit counters, four in each of two numbers.
_COUNTERS = np.array([[sum(((b >> (4 * h + j)) & 1) << (16 * j) for j in range(4)) for h in range(2)] for b in range(256)], dtype=np.uint64)


def _bit_sums(words: np.ndarray) -> np.ndarray:
    """Running counts of each hash bit; at most 2 ** 16 - 1 words, so that no counter overflows."""
    counters = _COUNTERS[np.ascontiguousarray(words).view(np.uint8)].reshape(-1, 16)
    sums = np.zeros((len(words) + 1, 16), dtype=np.uint64)
    np.cumsum(counters, axis=0, out=sums[1:])
    return sums


def _windows(sums: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    ones = (sums[starts + size] - sums[starts]).view(np.uint16)
    return np.packbits(ones > size // 2, axis=1)


def _long_windows(words: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """``_windows`` for any size: whole bit counts where windows begin or end, added up piece by piece."""
    found = []
    for first in range(0, len(starts), STREAM_WORDS):
        some = starts[first : first + STREAM_WORDS]
        ends = np.union1d(some, some + size)
        counts = np.empty((len(ends), 64), dtype=np.int32)
        before, done = np.zeros(64, dtype=np.int32), 0
        for at in range(int(ends[0]), int(ends[-1]) + 1, STREAM_WORDS):
            sums = _bit_sums(words[at : at + STREAM_WORDS])
            upto = int(np.searchsorted(ends, at + STREAM_WORDS))
            counts[done:upto] = before + sums[ends[done:upto] - at].view(np.uint16)
            before, done = before + sums[-1].view(np.uint16), upto
        ones = counts[np.searchsorted(ends, some + size)] - counts[np.searchsorted(ends, some)]
        found.append(np.packbits(ones > size // 2, axis=1))
    return np.concatenate(found)


_NEXT = np.array([0, *(1 << k for k in range(16))], dtype=np.uint16)


class SizeClass:
    """Fingerprints of items of about one size at every phase at which windows may lie inside them."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        least = min(len(w) for _, w in items)
        self.size = max(1, int(WINDOW_SHARE * least))
        self.stride = max(1, (least - self.size + 1) // PROBES)
        found, self.item, self.phase = [], [], []
        for i, words in items:
            f = fingerprints(words[: self.size + PROBES * self.stride - 1], self.size, 1)
            found.append(f)
            self.item += [i] * len(f)
            self.phase += range(len(f))
        self.prints = np.concatenate(found)
        self.item, self.phase = np.array(self.item), np.array(self.phase)
        self.wide = np.ascontiguousarray(self.prints).view(np.uint64).ravel()
        self.blocks = []
        for block in self.prints.view(np.uint16).T:
            value = (block[:, None] ^ _NEXT).ravel()
            count = np.bincount(value, minlength=1 << 16).astype(np.int32)
            order = (np.argsort(value, kind="stable") // len(_NEXT)).astype(np.int32)
            self.blocks.append((count, (np.cumsum(count) - count).astype(np.int32), order))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, fingerprint) pairs within the radius: all of them, by the blocks; a pair may come several times."""
        wide = np.ascontiguousarray(prints).view(np.uint64).ravel()
        rows, cols = [], []
        for value, (count, first, order) in zip(prints.view(np.uint16).T, self.blocks, strict=True):
            some = np.nonzero(count[value])[0]
            value = value[some]
            n = count[value]
            row = np.repeat(some, n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[value], n)
            col = order[place]
            good = np.bitwise_count(wide[row] ^ self.wide[col]) <= RADIUS
            rows.append(row[good])
            cols.append(col[good])
        return np.concatenate(rows), np.concatenate(cols)


class Index:
    """Benchmark items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.ids = [i for i, _ in items]
        self.words = word_hashes([t for _, t in items])
        self.bags = [_bag(shingles(w, SHINGLE_WORDS)) for w in self.words]
        self.classes: list[SizeClass] = []
        group: list[tuple[int, np.ndarray]] = []
        for i, words in sorted(((i, w) for i, w in enumerate(self.words) if len(w)), key=lambda x: len(x[1])):
            if group and len(words) > CLASS_RATIO * len(group[0][1]):
                self.classes.append(SizeClass(group))
                group = []
            group.append((i, words))
        if group:
            self.classes.append(SizeClass(group))
        self.long = [c for c in self.classes if is_long(c.size)]
        self.short = [c for c in self.classes if not is_long(c.size)]
        self.longest = max((c.size for c in self.short), default=1)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Sorted (start, item) pairs, packed in one number, of windows near an item's."""
        found = [np.empty(0, dtype=np.int64)]
        for c in self.long:
            starts = np.arange(0, len(words) - c.size + 1, c.stride)
            for first in range(0, len(starts), LONG_WINDOWS):
                some = starts[first : first + LONG_WINDOWS]
                row, col = c.near(_long_windows(words, c.size, some))
                found.append(((some[row] - c.phase[col]).astype(np.int64) << 32) | c.item[col])
        step = STREAM_WORDS - self.longest
        for at in range(0, max(len(words) - 1, 1) if self.short else 0, step):
            part = words[at : at + STREAM_WORDS]
            sums = _bit_sums(part)
            for c in self.short:
                starts = np.arange(0, len(part) - c.size + 1, c.stride)
                if len(starts):
                    row, col = c.near(_windows(sums, c.size, starts))
                    found.append(((starts[row] + at - c.phase[col]).astype(np.int64) << 32) | c.item[col])
        return np.unique(np.concatenate(found))

    def similarity(self, doc: np.ndarray, start: int, item: int) -> float:
        """Weighted Jaccard of the item's shingles and those of the window at ``start``."""
        window = doc[start : start + len(self.words[item])]
        return _weighted(_bag(shingles(window, SHINGLE_WORDS)), self.bags[item])

    def similarities(self, doc: np.ndarray, first: int, last: int, item: int) -> list[float]:
        """``similarity`` at each start from ``first`` to ``last``; a step changes two shingles."""
        n = len(self.words[item])
        s = shingles(doc[first : last + n], SHINGLE_WORDS)
        values, counts = self.bags[item]
        place = np.minimum(np.searchsorted(values, s), len(values) - 1)
        place = np.where(values[place] == s, place, -1).tolist()
        width = n - SHINGLE_WORDS + 1
        most, have, common, out = counts.tolist(), [0] * len(counts), 0, []
        for i, p in enumerate(place):
            if p >= 0:
                have[p] += 1
                common += have[p] <= most[p]
            if i >= width and (gone := place[i - width]) >= 0:
                common -= have[gone] <= most[gone]
                have[gone] -= 1
            if i >= width - 1:
                out.append(common / (2 * width - common))
        return out


def _bag(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(s, return_counts=True)


def _weighted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - common
    return common / total if total else 0.0


def matches(index: Index, docs: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, float, int]]:
    """(document, item, similarity, start) of the best window of each pair at the threshold or more.

    The documents' words are read as one stream; verification looks inside one document.
    """
    if not docs:
        return
    bounds = np.cumsum([0, *map(len, docs)])
    best: dict[tuple[int, int], tuple[float, int]] = {}
    known: dict[tuple[int, int, int], float] = {}
    spread: dict[tuple[int, int], list[int]] = {}
    for packed in index.candidates(np.concatenate(docs)).tolist():
        start, item = packed >> 32, packed & 0xFFFFFFFF
        # the middle of the window says which document it is in
        d = int(np.searchsorted(bounds, start + len(index.words[item]) // 2, side="right")) - 1
        if d >= len(docs):
            continue
        last = max(0, len(docs[d]) - len(index.words[item]))
        start = min(max(0, start - int(bounds[d])), last)
        if is_long(len(index.words[item])) and len(docs[d]) >= len(index.words[item]):
            spread.setdefault((d, item), []).append(start)  # neighbouring phases are alike: many starts a passage
            continue
        if (d, item, start) not in known:
            known[d, item, start] = index.similarity(docs[d], start, item)
        s = known[d, item, start]
        if s == 0.0:
            continue
        for at in range(max(0, start - SHIFT), min(last, start + SHIFT) + 1) if s < 1.0 else (start,):
            key = (d, item, at)
            if key not in known:
                known[key] = index.similarity(docs[d], at, item)
            if known[key] >= threshold and (known[key], -at) > best.get((d, item), (0.0, 0)):
                best[d, item] = known[key], -at
    for (d, item), starts in spread.items():
        last = len(docs[d]) - len(index.words[item])
        for first, end in _runs(sorted(starts), 2 * SHIFT + 1):
            first, end = max(0, first - SHIFT), min(last, end + SHIFT)
            for at, s in enumerate(index.similarities(docs[d], first, end, item), first):
                if s >= threshold and (s, -at) > best.get((d, item), (0.0, 0)):
                    best[d, item] = s, -at
    for (d, item), (s, start) in best.items():
        yield d, item, s, -start


def _runs(places: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """(first, last) of the runs of sorted ``places`` whose steps are at most ``gap``."""
    first = before = places[0]
    for p in places[1:]:
        if p - before > gap:
            yield first, before
            first = p
        before = p
    yield first, before


def _index_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The query set in blocks of at most INDEX_WORDS words (one item at least)."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id").toLocalIterator():
        n = len(r["text"] or "") // 5 + 1
        if block and size + n > INDEX_WORDS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contaminated pairs: doc_id, item_id, similarity, start_word, n_words (of the item).

    Every document's words (lower-cased runs of letters, digits and ``_``) pass through
    windows of item size, strided so that a window lies inside any occurrence at whatever
    offset. Windows whose 64-bit SimHash is within RADIUS bits of an item's at the same phase
    are all found; the aligned window's five-word shingles, weighted by how often they stand,
    must reach ``threshold`` as weighted Jaccard. The best window of a pair is reported, of
    equal ones the first. Items may be of any length.

    Null and empty texts or items match nothing; items under five words are one shingle.
    Repeated rows give repeated pairs, a null doc_id a null. Other columns are ignored; an
    empty documents or benchmark table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])

    def search(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for batch in batches:
                for at, texts in texts_of(batch, "text", 128):
                    ids = batch.column(0).slice(at, len(texts)).to_pylist()
                    found = [(ids[d], ix.ids[i], s, start, len(ix.words[i])) for d, i, s, start in matches(ix, word_hashes(texts), threshold)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

        return rows.mapInArrow(run, OUT)

    return _block_by_block(docs, benchmark, search, DataFrame.unionByName)


def _block_by_block(docs: DataFrame, benchmark: DataFrame, search: Callable, joined: Callable) -> DataFrame:
    """``search(index)`` of each block of the benchmark, put together by ``joined``.

    One block's index at a time is in the driver and in the workers: all results but the last
    are written before the next index is made.
    """
    spark = docs.sparkSession
    out, index = None, None
    for block in _index_blocks(benchmark):
        if index is not None:
            part, path = written(search(index), "passages")
            left(path)
            out = part if out is None else joined(out, part)
            index.destroy()
        index = spark.sparkContext.broadcast(Index(block))
    if index is None:
        return spark.createDataFrame([], OUT)
    return search(index) if out is None else joined(out, search(index))


def without_passages(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark."""
    spark, out, index, path = docs.sparkSession, docs, None, None

    def search(rows, index):
        def clean(texts: list[str | None]) -> list[bool]:
            hit = {d for at in range(0, len(texts), 128) for d in _hits(index.value, texts[at : at + 128], threshold, at)}
            return [d not in hit for d in range(len(texts))]

        return rows_kept(rows, lambda: clean, text_col)

    for block in _index_blocks(benchmark):
        if index is not None:
            out, new = written(search(out, index), "clean")
            index.destroy()
            if path:
                dropped(spark, path)
            path = new
        index = spark.sparkContext.broadcast(Index(block))
    if path:
        left(path)
    return docs if index is None else search(out, index)


def _hits(index: Index, texts: list[str | None], threshold: float, at: int) -> Iterator[int]:
    for d, *_ in matches(index, word_hashes(texts), threshold):
        yield at + d
