"""Many queries met with the chunks that a task reads: documents' scores by query, in numpy."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import scoring as S
from ..functions import text as T
from . import index as I
from . import search as R

#: Chunks that meet the queries at a time: their tokens are a matrix.
CHUNKS = 1024


def document_scores(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, found (array<struct<query_id, score>>): of each document the queries that it answers and their scores, as ``search.documents`` gives them.

    ``asked`` (query_id long, tokens) is a stated set, ``docs`` has doc_id and text; null ids are
    left out. Chunks are cut, normalised and scored where a document is read, and nothing moves
    but documents whose id several rows have: a query and a chunk that meet do not become a row.
    Rows with one id and one chunk index hold together what any of them holds, and are scored each.
    """
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    asked = _Asked([(r[0], r[1]) for r in asked.select("query_id", "tokens").collect()])
    fields = StructType([StructField("query_id", LongType()), StructField("score", DoubleType())])
    schema = StructType([docs.schema["doc_id"], StructField("found", ArrayType(fields))])
    several = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if several.isEmpty():
        return _words(docs).mapInArrow(asked.run, schema)
    tokens = docs.sparkSession.createDataFrame([(t,) for t in asked.tokens], "token string")
    # rows of one document that follow each other are one document
    near = _together(_words(docs.join(several, "doc_id", "left_semi")), tokens).repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index")
    return _words(docs.join(several, "doc_id", "left_anti")).mapInArrow(asked.run, schema).unionByName(near.mapInArrow(asked.run, schema))


def _words(docs: DataFrame) -> DataFrame:
    return I.chunks(docs).select("doc_id", "chunk_index", T.words(F.col("norm")).alias("words"))


def _together(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``held``: the asked tokens that the chunk has in any row; chunks without one go."""
    keys = ["doc_id", "chunk_index"]
    each = rows.select(*keys, F.explode("words").alias("token")).join(F.broadcast(tokens), "token", "left_semi").distinct()
    return rows.join(each.groupBy(*keys).agg(F.collect_set("token").alias("held")), keys)


@dataclass
class _Open:
    """The last document so far, of which more chunks may come: its queries, their best scores and how many chunks answer them."""

    id: object
    query: np.ndarray
    best: np.ndarray
    hits: np.ndarray


class _Asked:
    """The queries, by their tokens; those that repeat their tokens alike are met with a chunk in one go."""

    def __init__(self, queries: list[tuple[int, list[str]]]) -> None:
        self.tokens = sorted({t for _, ts in queries for t in ts})
        number = {t: i for i, t in enumerate(self.tokens)}
        lengths = defaultdict(list)
        for t in self.tokens:
            lengths[len(t)].append(t)
        self.lengths = {n: (pa.array(ts), np.array([number[t] for t in ts])) for n, ts in lengths.items()}
        alike = defaultdict(list)
        for q, ts in queries:
            alike[tuple(ts.index(t) for t in ts)].append((q, [number[t] for t in ts]))
        # (places of the tokens, each once; query ids; a row of tokens for each query)
        self.groups = [(sorted(set(p)), np.array([q for q, _ in rows]), np.array([ts for _, ts in rows])) for p, rows in alike.items() if p]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Open | None = None
        for b in batches:
            for at in range(0, b.num_rows, CHUNKS):
                part = b.slice(at, CHUNKS)
                ids = part.column("doc_id")
                new = np.r_[True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)]
                ids = ids.filter(pa.array(new))
                doc, query, best, hits = self._met(part, np.cumsum(new) - 1)
                if last is not None and last.id != ids[0].as_py():
                    yield self._batch(pa.array([last.id], ids.type), np.zeros(len(last.query), np.int64), last.query, last.best, last.hits)
                elif last is not None:
                    doc, query, best, hits = _merged(last, doc, query, best, hits)
                end = np.searchsorted(doc, len(ids) - 1)
                last = _Open(ids[-1].as_py(), query[end:], best[end:], hits[end:])
                if end:
                    yield self._batch(ids, doc[:end], query[:end], best[:end], hits[:end])
        if last is not None:
            yield self._batch(pa.array([last.id], b.column("doc_id").type), np.zeros(len(last.query), np.int64), last.query, last.best, last.hits)

    def _batch(self, ids: pa.Array, doc: np.ndarray, query: np.ndarray, best: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
        score = rounded(best + 0.5 * np.minimum(hits, 5))
        found = pa.StructArray.from_arrays([pa.array(query), pa.array(score)], names=["query_id", "score"])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc[first])), pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)].astype(np.int32)), found)], names=["doc_id", "found"])

    def _met(self, part: pa.RecordBatch, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, query, best score of its chunks, chunks that answer) of all that meet, by document."""
        words = part.column("words")
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        held = _Held(self, words.flatten().dictionary_encode(), n, part.column("held") if "held" in part.schema.names else None)
        norm = S.K1 * ((1 - S.B) + S.B * n / S.AVERAGE_WORDS)
        weight = held.count * (S.K1 + 1) / (held.count + norm[held.chunk])  # of a token in its chunk
        made = [(np.empty(0, np.int64),) * 4]
        for once, ids, tokens in self.groups:
            for at in range(0, len(ids), 2048):
                made.append(_scored(held, weight, doc, once, ids[at : at + 2048], tokens[at : at + 2048]))
        doc, query, best, hits = (np.concatenate(x) for x in zip(*made, strict=True))
        by = np.argsort(doc, kind="stable")
        return doc[by], query[by], best[by], hits[by]


class _Held:
    """The asked tokens that stand in chunks as whole words: ``has`` [token, chunk], ``entry`` [token, chunk] the number of the pair, if there is one.

    With ``more`` (tokens that a chunk holds in some row) also those of them that only start a
    word of the chunk, whose count is 0. Of each pair: its ``chunk``, ``count`` of whole words,
    and of the words that start with the token the ``first`` place and, as bits, the starts of
    windows that hold one (``near``).
    """

    def __init__(self, asked: _Asked, named: pa.DictionaryArray, n: np.ndarray, more: pa.ListArray | None) -> None:
        word, token = [], []
        for length, (known, numbers) in asked.lengths.items():
            at = pc.index_in(pc.utf8_slice_codeunits(named.dictionary, 0, length), value_set=known)
            some = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            word.append(some)
            token.append(numbers[at.take(pa.array(some)).to_numpy(zero_copy_only=False)])
        word, token = np.concatenate([np.empty(0, np.int64), *word]), np.concatenate([np.empty(0, np.int64), *token])
        by = np.argsort(word, kind="stable")
        word, token = word[by], token[by]
        size = np.array([len(t) for t in asked.tokens], np.int64)
        whole = size[token] == pc.utf8_length(named.dictionary).to_numpy(zero_copy_only=False)[word]
        each = np.bincount(word, minlength=len(named.dictionary))  # tokens that a word starts with
        starts = np.cumsum(each) - each
        code = named.indices.to_numpy(zero_copy_only=False)
        chunk = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        times = each[code]
        of = np.repeat(starts[code] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        chunk, place, token, whole = np.repeat(chunk, times), np.repeat(place, times), token[of], whole[of]
        key = token * len(n) + chunk
        self.has = np.zeros((len(asked.tokens), len(n)), bool)
        self.has.ravel()[key[whole]] = True
        if more is not None:
            known = pc.index_in(more.flatten(), value_set=pa.array(asked.tokens)).to_numpy(zero_copy_only=False)
            others, started = np.zeros_like(self.has), np.zeros_like(self.has)
            others[known, np.repeat(np.arange(len(n)), pc.list_value_length(more).to_numpy(zero_copy_only=False))] = True
            started.ravel()[key] = True
            self.has |= others & started
        pairs = np.flatnonzero(self.has)
        self.entry = np.full(self.has.shape, -1, np.int32)
        self.entry.ravel()[pairs] = np.arange(len(pairs))
        self.chunk = pairs % max(len(n), 1)
        entry = self.entry.ravel()[key]
        self.count = np.bincount(entry[whole], minlength=len(pairs))
        self.whole = bool(self.count.all())
        kept = entry >= 0
        entry, place = entry[kept], place[kept]
        self.first = np.zeros(len(pairs), np.int64)
        self.first[entry[::-1]] = place[::-1]  # the last one given stays
        self.near = np.zeros((len(pairs), int(n.max(initial=1)) // 64 + 1), np.uint64)
        np.bitwise_or.at(self.near.ravel(), entry * self.near.shape[1] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        width = 1
        while width < S.WINDOW_WORDS:
            by = min(width, S.WINDOW_WORDS - width)
            moved = self.near >> np.uint64(by)
            moved[:, :-1] |= self.near[:, 1:] << np.uint64(64 - by)
            self.near |= moved
            width += by


def _scored(held: _Held, weight: np.ndarray, doc: np.ndarray, once: list[int], ids: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, query, best, hits) of queries whose tokens are those of a row of ``tokens``, of which ``once`` are the different ones."""
    has = held.has[tokens[:, once[0]]]
    for k in once[1:]:
        has &= held.has[tokens[:, k]]
    query, chunk = np.nonzero(has)
    entries = [held.entry[tokens[query, k], chunk] for k in range(tokens.shape[1])]
    first = np.stack([held.first[entries[k]] for k in once])
    if len(once) > 1:
        near = first.max(axis=0) - first.min(axis=0) < S.WINDOW_WORDS
        far = np.flatnonzero(~near)  # where the first places are far apart, others may be near
        shared = held.near[entries[once[0]][far]]
        for k in once[1:]:
            shared &= held.near[entries[k][far]]
        near[far[shared.any(axis=1)]] = True
        query, chunk, first, entries = query[near], chunk[near], first[:, near], [e[near] for e in entries]
    bm25 = np.zeros(len(query))
    for e in entries:
        bm25 += weight[e]
    every = True if held.whole else np.logical_and.reduce([held.count[e] > 0 for e in entries])
    bm25 += np.where(every, S.ALL_MATCHED, 0.0)
    close = np.zeros(len(query))
    if len(once) > 1:
        gap = np.diff(np.sort(first, axis=0), axis=0).min(axis=0)
        close = np.where(gap <= 3, 4.0, np.where(gap <= 10, 2.0, np.where(gap <= 25, 1.0, 0.0)))
    # all tokens are there, so that the coverage is 1
    score = rounded(bm25 * 2.80 + len(once) * 0.80 + close + 2.50 + np.where(bm25 > 2.0, 1.20, 0.0))
    kept = (bm25 > 0) & (score >= (R.MIN_SCORE_SINGLE if tokens.shape[1] == 1 else R.MIN_SCORE))
    score = rounded(score + (5.0 + np.where(close >= 2.0, 6.0, 0.0)))[kept]
    query, doc = query[kept], doc[chunk[kept]]
    start = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (doc[1:] != doc[:-1])]) if len(query) else np.empty(0, np.int64)
    best = np.maximum.reduceat(score, start) if len(start) else score
    return doc[start], ids[query[start]], best, np.diff(np.r_[start, len(query)])


def _merged(last: _Open, doc: np.ndarray, query: np.ndarray, best: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block has, with what an earlier one has of its first document."""
    end = np.searchsorted(doc, 1)
    known, at = np.unique(np.r_[last.query, query[:end]], return_inverse=True)
    most, n = np.full(len(known), -np.inf), np.zeros(len(known), np.int64)
    np.maximum.at(most, at, np.r_[last.best, best[:end]])
    np.add.at(n, at, np.r_[last.hits, hits[:end]])
    return np.r_[np.zeros(len(known), np.int64), doc[end:]], np.r_[known, query[end:]], np.r_[most, best[end:]], np.r_[n, hits[end:]]


def rounded(x: np.ndarray) -> np.ndarray:
    """Six places, half up in decimal, as Spark rounds."""
    scaled = x * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
    if near.any():
        known, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in known.tolist()])[at]
    return out
