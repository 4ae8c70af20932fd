"""Posting lists and vectors as bytes, for stores that keep blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the block format: its version, and the marks of a posting in the path before and in a new one.
VERSION, SAME_PATH, NEW_PATH = 2, 0, 1
POSTING = "array<struct<path:string,chunk_index:int,tf:int,flags:int>>"


def _varint(n: int) -> bytes:
    if n < 0:
        raise ValueError("negative number")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise ValueError("truncated block")
        self.at += n
        return part

    def number(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            shift += 7
            if value >= 1 << 64 or shift > 70:
                raise ValueError("number too long")
            if b < 0x80:
                return value


def encoded(postings: list[tuple[str, int, int, int]]) -> bytes:
    """A block of (path, chunk_index, tf, flags), sorted; a chunk may stand once."""
    out, path, chunk = [bytes([VERSION]), _varint(len(postings))], None, 0
    for p, c, tf, flags in sorted(postings):
        if p == path and c <= chunk:
            raise ValueError("a chunk stands twice")
        if p == path:
            out += [bytes([SAME_PATH]), _varint(c - chunk)]
        else:
            name = p.encode()
            out += [bytes([NEW_PATH]), _varint(len(name)), name, _varint(c)]
        out += [_varint(tf), bytes([flags])]
        path, chunk = p, c
    return b"".join(out)


def decoded(block: bytes) -> list[tuple[str, int, int, int]]:
    """The postings of a block; anything short, left over or out of range is refused."""
    at = _Cursor(block)
    if at.take(1)[0] != VERSION:
        raise ValueError("unknown version")
    out, path = [], None
    for _ in range(at.number()):
        mark = at.take(1)[0]
        if mark == NEW_PATH:
            n = at.number()
            if not 0 < n <= 0xFFFF:
                raise ValueError("bad path")
            path, base, least = at.take(n).decode(), 0, 0
        elif mark == SAME_PATH and path is not None:
            base, least = out[-1][1], 1
        else:
            raise ValueError("bad mark")
        step, tf = at.number(), at.number()
        if step < least or base + step > 0x7FFFFFFF or not 0 < tf <= 0x7FFFFFFF:
            raise ValueError("number out of range")
        out.append((path, base + step, tf, at.take(1)[0]))
    if at.at != len(block):
        raise ValueError("bytes after the block")
    return out


def posting_blocks(postings: DataFrame, rows: int = 4096) -> DataFrame:
    """hash, block, data: the postings (hash, path, chunk_index, tf, flags) of a term in blocks.

    ``rows`` is the aim for a block: a term's paths are dealt to as many blocks as its count asks
    for, so that no block grows with the table.
    """
    size = postings.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("blocks"))
    dealt = postings.join(size, "hash").withColumn("block", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
    lists = dealt.groupBy("hash", "block").agg(F.collect_list(F.struct("path", "chunk_index", "tf", "flags")).alias("p"))

    def pack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda xs: encoded([(x["path"], x["chunk_index"], x["tf"], x["flags"]) for x in xs]))

    return lists.select("hash", "block", F.pandas_udf(pack, "binary")("p").alias("data"))


def postings_of(blocks: DataFrame) -> DataFrame:
    """hash, path, chunk_index, tf, flags of packed blocks."""

    def unpack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda data: [dict(zip(("path", "chunk_index", "tf", "flags"), p, strict=True)) for p in decoded(bytes(data))])

    return blocks.select("hash", F.inline(F.pandas_udf(unpack, POSTING)("data")))


def vector_bytes(v: Column) -> Column:
    """32-bit floats, least byte first; null for null."""

    def pack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: np.asarray(x, dtype="<f4").tobytes(), na_action="ignore")

    return F.pandas_udf(pack, "binary")(v)


def vector_of(data: Column) -> Column:
    """The floats of a blob; an empty vector for null, and bytes beyond the last whole float are ignored."""

    def unpack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: np.frombuffer(bytes(x or b"")[: len(x or b"") // 4 * 4], dtype="<f4"))

    return F.pandas_udf(unpack, "array<float>")(data)
