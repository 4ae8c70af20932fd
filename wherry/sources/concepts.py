"""Concept assets in their binary form, as rows; damage is a row too."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: numbers are little-endian; a head of version and count, then per record two texts with 16-bit lengths, a byte for the type, and a 32-bit number of 32-bit floats.
HEAD, SHORT, LONG = struct.Struct("<ii"), struct.Struct("<H"), struct.Struct("<i")
#: What the type's byte says.
TYPES = ("OBJECT", "COLOR", "PLACE", "ACTION", "PERSON")
SCHEMA = "path string, version int, place int, concept_id string, english string, type string, embedding array<float>, error string"
#: Components of a vector that a record may have; more are taken for damage.
MOST_DIMENSIONS = 1 << 16


def records(data: bytes) -> Iterator[tuple]:
    """(version, place, id, english, type, embedding, error); what cannot be read ends the file with an error."""
    at = version = place = 0

    def take(n: int) -> bytes:
        nonlocal at
        if n < 0 or at + n > len(data):
            raise ValueError(f"record {place} is cut off")
        at += n
        return data[at - n : at]

    try:
        version, count = HEAD.unpack(take(HEAD.size))
        while place < count:
            texts = [take(SHORT.unpack(take(SHORT.size))[0]).decode("utf-8") for _ in range(2)]
            kind, dims = take(1)[0], LONG.unpack(take(LONG.size))[0]
            if not 0 <= dims <= MOST_DIMENSIONS:
                raise ValueError(f"record {place} has {dims} components")
            if kind >= len(TYPES):
                raise ValueError(f"record {place} has type {kind}")
            yield version, place, *texts, TYPES[kind], np.frombuffer(take(4 * dims), dtype="<f4"), None
            place += 1
        if at < len(data):
            raise ValueError(f"{len(data) - at} bytes after the last record")
    except (ValueError, struct.error) as e:
        yield version, place, None, None, None, None, str(e)


def concepts(files: DataFrame) -> DataFrame:
    """path, version, place, concept_id, english, type, embedding, error of every record of ``files`` (path, content).

    Records have no fixed length, so a file is read by one task, record by record; null contents
    are damaged files.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, data in zip(part["path"], part["content"], strict=True):
                out = []
                for r in records(bytes(data or b"")):
                    out.append((path, *r))
                    if len(out) == 1024:
                        yield _frame(out)
                        out = []
                if out:
                    yield _frame(out)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files of a folder."""
    return concepts(spark.read.format("binaryFile").load(path))
