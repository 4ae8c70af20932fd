"""Inverting chunks where they are: the words of many chunks at a time become posting lists, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import hash_head as head

#: Words that a task inverts at a time: more make fewer lists of a word, but a worker has to hold them some twenty times over.
WORDS = 600_000


def inverted(rows: DataFrame, pairs: bool = False) -> DataFrame:
    """Posting lists of ``rows`` (doc_id, chunk_index, seg, words), each task's own: a word may have several, by task and batch.

    ``block`` tells the batches apart: all words of a chunk lie in lists of one block.
    Without ``pairs``: token, seg, block, postings (doc_id, chunk_index, places, n_words) of words of two characters or more.
    With ``pairs``: hash, seg, block, postings (doc_id, chunk_index, tf) of words and of pairs of neighbours, hash being the
    first 8 bytes of the canonical hash, which delta encoding shortens further (of a billion terms one has another's
    with a chance of 1 to 10 billions for each asked). Lists come in the order of their keys within a batch, and nothing is shuffled.
    """
    doc = StructField("doc_id", rows.schema["doc_id"].dataType)
    number = StructField("chunk_index", IntegerType())
    if pairs:
        each, key = StructType([doc, number, StructField("tf", LongType())]), StructField("hash", LongType())
    else:
        each, key = StructType([doc, number, StructField("places", ArrayType(IntegerType())), StructField("n_words", IntegerType())]), StructField("token", StringType())
    schema = StructType([key, StructField("seg", rows.schema["seg"].dataType), StructField("block", LongType()), StructField("postings", ArrayType(each))])
    make = _terms if pairs else _tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                held.append(part)
                n += len(part.column("words").flatten())
                if n >= WORDS:
                    yield from _batch(held, make, block)
                    held, n, block = [], 0, block + 1
        if held:
            yield from _batch(held, make, block)

    return rows.select("doc_id", "chunk_index", "seg", "words").mapInArrow(run, schema)


def _batch(held: list[pa.RecordBatch], make, block: int) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(held).combine_chunks()
    for seg in pc.unique(whole["seg"]):
        chunks = whole.filter(pc.equal(whole["seg"], seg)).combine_chunks()
        words = pa.concat_arrays(chunks["words"].chunks) if chunks.num_rows else None
        if words is None or not len(flat := words.flatten()):
            continue
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        named = flat.dictionary_encode()
        row = np.repeat(np.arange(len(n)), n)
        key, postings = make(named.dictionary, named.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, n, chunks)
        segs = pa.array(np.full(len(key), seg.as_py()), type=whole.schema.field("seg").type)
        blocks = pa.array(np.full(len(key), block))
        out = pa.RecordBatch.from_arrays([key, segs, blocks, postings], names=["hash" if make is _terms else "token", "seg", "block", "postings"])
        for at in range(0, out.num_rows, 20_000):
            yield out.slice(at, 20_000)


def _of(chunks: pa.Table, name: str, rows: np.ndarray) -> pa.Array:
    return pa.concat_arrays(chunks[name].chunks).take(pa.array(rows))


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, np.int64)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), values)


def _tokens(vocab: pa.Array, codes: np.ndarray, row: np.ndarray, n: np.ndarray, chunks: pa.Table) -> tuple[pa.Array, pa.Array]:
    place = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    kept = pc.greater_equal(pc.utf8_length(vocab), 2).to_numpy(zero_copy_only=False)[codes]
    codes, row, place = codes[kept], row[kept], place[kept]
    order = pc.array_sort_indices(vocab).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys = rank[codes] * len(n) + row
    by = np.argsort(keys, kind="stable")  # places stay in order
    keys, row, place = keys[by], row[by], place[by]
    one = _starts(keys)
    at = row[one]
    token = keys[one] // len(n)
    fields = [_of(chunks, "doc_id", at), _of(chunks, "chunk_index", at), _lists(one, pa.array(place.astype(np.int32))), pa.array(n[at].astype(np.int32))]
    first = _starts(token)
    return vocab.take(pa.array(order)).take(pa.array(token[first])), _lists(first, pa.StructArray.from_arrays(fields, names=["doc_id", "chunk_index", "places", "n_words"]))


def _terms(vocab: pa.Array, codes: np.ndarray, row: np.ndarray, n: np.ndarray, chunks: pa.Table) -> tuple[pa.Array, pa.Array]:
    size = len(vocab)
    near = row[1:] == row[:-1]
    terms = np.concatenate([codes, size + codes[:-1][near] * size + codes[1:][near]])
    row = np.concatenate([row, row[:-1][near]])
    known, terms = np.unique(terms, return_inverse=True)
    word = [w.encode() for w in vocab.to_pylist()]
    single = int(np.searchsorted(known, size))  # words come before pairs
    a, b = np.divmod(known[single:] - size, size)
    start = head(b"")[:-4]
    new, length = sha256(start).copy, [n.to_bytes(4, "big") for n in range(4096)]

    def hashed(term: bytes) -> bytes:
        h = new()
        n = len(term)
        h.update((length[n] if n < 4096 else n.to_bytes(4, "big")) + term)
        return h.digest()[:8]

    made = b"".join([*map(hashed, map(word.__getitem__, known[:single].tolist())), *[hashed(word[i] + b" " + word[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]])
    made = np.frombuffer(made, ">i8").astype(np.int64)
    order = np.argsort(made)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, tf = np.unique(rank[terms] * len(n) + row, return_counts=True)
    at = keys % len(n)
    first = _starts(keys // len(n))
    fields = [_of(chunks, "doc_id", at), _of(chunks, "chunk_index", at), pa.array(tf.astype(np.int64))]
    return pa.array(made[order]), _lists(first, pa.StructArray.from_arrays(fields, names=["doc_id", "chunk_index", "tf"]))
