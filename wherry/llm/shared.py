"""Helpers the training-data operators share: written tables, word hashing, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
_GAP = re.compile(r"\W")
_U = np.uint64
STEP = _U(0x9E3779B97F4A7C15)
#: Characters whose words are hashed at a time; longer texts are taken in pieces between words.
GROUP_CHARS = 1 << 18
#: Rows of whole texts that go to a Python worker at a time.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only in local mode, where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="wherry-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker and the JVM beside it hold of whole texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


_LEFT: list[str] = []


def left(*paths: str) -> int:
    """Remember tables that a lazy result still reads; returns how many are known so far."""
    _LEFT.extend(paths)
    return len(_LEFT)


def swept(spark: SparkSession, known: int = 0) -> None:
    """Delete the tables remembered since ``left`` said ``known``; call it when what reads them is written."""
    dropped(spark, *_LEFT[known:])
    del _LEFT[known:]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ words and shingles


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@cache
def _word_chars() -> np.ndarray:
    """Whether each code point is one of a word."""
    out = np.zeros(0x110000, dtype=bool)
    for m in WORD.finditer("".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


_POWERS = np.cumprod(np.full(1 << 12, STEP, dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, STEP, dtype=np.uint64))
    return _POWERS


def word_codes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends): the code points of ``text`` and where its words begin and end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(codes) + 2, dtype=bool)
    inside[1:-1] = _word_chars()[codes]
    edge = np.nonzero(inside[1:] != inside[:-1])[0]
    return codes, edge[::2], edge[1::2]


def hashed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, the same in every worker: a polynomial of its mixed code points."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    terms = mixed(codes[np.repeat(starts, size) + place].astype(np.uint64) + STEP) * powers(int(size.max()))[place]
    return mixed(np.add.reduceat(terms, first) + size.astype(np.uint64))


def grouped(texts: list[str | None], most: int = GROUP_CHARS) -> Iterator[tuple[str, list[int], list[int]]]:
    """(joined text, places in ``texts``, where each begins) of lower-cased texts, at most about ``most`` characters together.

    A longer text comes in several groups, cut where no word is.
    """
    parts, of, at, size = [], [], [], 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        while len(low) > most:
            cut = _GAP.search(low, most)
            if not cut:
                break
            yield low[: cut.start()], [i], [0]
            low = low[cut.start() :]
        if parts and size + len(low) > most:
            yield "\n".join(parts), of, at
            parts, of, at, size = [], [], [], 0
        parts.append(low)
        of.append(i)
        at.append(size)
        size += len(low) + 1
    if parts:
        yield "\n".join(parts), of, at


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's words (lower-cased runs of letters, digits and ``_``), in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for text, of, at in grouped(texts):
        codes, starts, ends = word_codes(text)
        found = np.split(hashed(codes, starts, ends), np.searchsorted(starts, at[1:]))
        for i, h in zip(of, found, strict=True):
            out[i].append(h)
    return [h[0] if len(h) == 1 else np.concatenate(h) for h in out]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter text is one shingle, no words none."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    k = min(width, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * STEP + words[i : i + len(out)]
    return mixed(out + _U(k))


def texts_of(batch: pa.RecordBatch, column: str, step: int = 256) -> Iterator[tuple[int, list]]:
    """(offset, texts) slices of a batch, so that only a few texts are Python strings at a time."""
    values = batch.column(batch.schema.get_field_index(column))
    for at in range(0, batch.num_rows, step):
        yield at, values.slice(at, step).to_pylist()


def rows_kept(docs: DataFrame, keeps: Callable[[], Callable[[list], list[bool]]], text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, but only the rows whose text ``keeps()`` accepts.

    ``keeps()`` is called once a task and gives a function of a list of texts. A row is judged by
    its own text, whatever its id, so null and shared ids need no join and texts are not shuffled.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = keeps()
        for batch in batches:
            mask = [k for _, texts in texts_of(batch, text_col) for k in judge(texts)]
            if all(mask):
                yield batch
            elif any(mask):
                yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


# ------------------------------------------------------------------ connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """(node, root): the smallest node of each connected component, for every node on an edge.

    Nodes may be of any type with an order. Alternates the large-star and small-star steps until
    nothing changes; each round is one written table, so neither edges nor labels ever reach the
    driver and a lost executor costs one round. Returns the table and its path (drop it when it
    has been read).
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs, path = written(pairs, "cc")
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        # each node and its lower neighbours hang off the lowest of them
        small = small.select(F.col("u"), F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        new, new_path = written(small, "cc")
        found = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, path)
        pairs, path = new, new_path
        if found == mark:
            break
        mark = found
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots), path
