"""Words that mean the same to an encoder: an exact cosine join of sparse vectors through an inverted file of the asked side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import scoring as S

#: Least similarity of a word that stands for a token, and what a match counts.
MIN_SIMILARITY, SEMANTIC_WEIGHT = 0.82, 1.40
MIN_CHARS = 3
#: Words that meet the asked tokens at a time, and what the order of sums may change in a similarity.
BLOCK, NEAR = 4096, 2e-6


def character_grams(word: Column, width: int = 3) -> Column:
    """array<struct<dim, weight>>: a sparse stand-in for a word's embedding: its marked character n-grams, and how often each stands in it."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - width + 1, F.lit(1))), lambda i: F.substr(marked, i, F.lit(width)))
    return F.transform(F.array_sort(F.array_distinct(grams)), lambda g: F.struct(g.alias("dim"), F.size(F.filter(grams, lambda x: x == g)).cast("double").alias("weight")))


def unit(vector: Column) -> Column:
    """The same vector of length 1; without dimensions if it has none."""
    length = F.sqrt(S.total(F.transform(vector, lambda d: d["weight"] * d["weight"])))
    return F.transform(vector, lambda d: F.struct(d["dim"].alias("dim"), (d["weight"] / length).alias("weight")))


def similarity_join(asked: DataFrame, vocab: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """token, word, similarity: all pairs of a cosine of at least ``least`` (rounded to six places).

    Both sides have a name and ``vector`` (array<struct<dim, weight>>, weights not negative); the
    names are ``token`` and ``word``. The asked tokens are a stated set: their inverted file, from
    a dimension to tokens and weights, goes to every task. Words stay where they are; a task sums
    what its words have in common with the tokens, block by block, and only pairs that reach
    ``least`` but for rounding become rows. Each of those is compared once more, in the order of
    its dimensions. Null and empty vectors are similar to nothing.
    """
    t = asked.where("token IS NOT NULL").groupBy("token").agg(F.first("vector").alias("vector")).select("token", unit(F.col("vector")).alias("a"))
    w = vocab.where("word IS NOT NULL").dropDuplicates(["word"]).select("word", unit(F.col("vector")).alias("b"))
    pairs = _near(t.collect(), w, least)
    return pairs.join(t, "token").select("token", "word", F.round(sparse_dot(F.col("a"), F.col("b")), 6).alias("similarity")).where(F.col("similarity") >= least)


def _near(asked: list, w: DataFrame, least: float) -> DataFrame:
    """token, word, b: words (word, b) with every asked token that they are near to, in sums of another order."""
    tokens = [r[0] for r in asked]
    each = [(d["dim"], i, d["weight"]) for i, r in enumerate(asked) for d in r[1] or () if d["weight"] is not None]
    dims = sorted({e[0] for e in each})
    place = {d: i for i, d in enumerate(dims)}
    by = sorted((place[d], i, x) for d, i, x in each)
    of, ids, weights = (np.array([e[k] for e in by], kind) for k, kind in ((0, np.int64), (1, np.int64), (2, np.float64)))
    starts = np.searchsorted(of, np.arange(len(dims) + 1))
    known = pa.array(dims, to_arrow_type(w.schema["b"].dataType.elementType["dim"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                b = part.column("b")
                flat = b.flatten()
                n = pc.fill_null(pc.list_value_length(b), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                code = pc.fill_null(pc.index_in(flat.field("dim"), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                weight = pc.fill_null(flat.field("weight"), 0.0).to_numpy(zero_copy_only=False)
                row, code, weight = row[code >= 0], code[code >= 0], weight[code >= 0]
                many = starts[code + 1] - starts[code]
                # every entry of a word meets all tokens that have its dimension
                to = np.repeat(starts[code] - np.cumsum(many) + many, many) + np.arange(many.sum())
                pair, inverse = np.unique(np.repeat(row, many) * len(tokens) + ids[to], return_inverse=True)
                dot = np.bincount(inverse, np.repeat(weight, many) * weights[to], len(pair))
                pair = pair[dot >= least - NEAR]
                if len(pair):
                    i, j = np.divmod(pair, len(tokens))
                    yield pa.RecordBatch.from_arrays([pa.array([tokens[k] for k in j], pa.string()), part.column("word").take(pa.array(i)), b.take(pa.array(i))], names=["token", "word", "b"])

    return w.mapInArrow(run, StructType([StructField("token", StringType()), w.schema["word"], w.schema["b"]]))


def sparse_dot(a: Column, b: Column) -> Column:
    weights = F.map_from_entries(b)
    shared = F.filter(a, lambda d: F.map_contains_key(weights, d["dim"]))
    return S.total(F.transform(shared, lambda d: d["weight"] * weights[d["dim"]]))


def best_words(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """token, doc_id, chunk_index, word, score: of the similar words that stand in a chunk the closest (ties: the first), and what it counts.

    ``postings`` has token (the word), doc_id and chunk_index, as the index has them.
    """
    return _best(postings.select(F.col("token").alias("word"), "doc_id", "chunk_index").join(pairs, "word"), [])


def best_listed(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """What ``best_words`` gives, from lists (word, block, chunks: array<struct<doc_id, chunk_index>>).

    All lists of a chunk are of one block: those of similar words move once, as lists, to where
    the block's other lists for the token are, and chunks are grouped there.
    """
    found = lists.join(pairs, "word").repartition("block", "token")
    return _best(found.select("block", "token", "word", "similarity", F.inline("chunks")), ["block"])


def _best(found: DataFrame, more: list[str]) -> DataFrame:
    best = F.min_by(F.struct("word", "similarity"), F.struct((-F.col("similarity")).alias("s"), "word")).alias("b")
    rows = found.groupBy(*more, "token", "doc_id", "chunk_index").agg(best)
    return rows.select("token", "doc_id", "chunk_index", "b.word", F.round(F.col("b.similarity") * SEMANTIC_WEIGHT, 6).alias("score"))
