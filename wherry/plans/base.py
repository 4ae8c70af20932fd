"""Registering queries with the SQL they must equal, and SQL fragments in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Stated query sets; the words occur in the driver's tables at every scale.
QUERY_SET = ((1, "with this"), (2, "thre tion"), (3, "that from"), (4, "The"), (5, "er thon on"), (6, "in the that"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, data, schema: str) -> DataFrame:
    return spark.createDataFrame(list(data), schema)


def query_set(spark: SparkSession) -> DataFrame:
    return rows(spark, QUERY_SET, "query_id int, query string")


# ------------------------------------------------------------------ DuckDB fragments


def lit(x) -> str:
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (tuple, list)):
        return "[" + ", ".join(map(lit, x)) + "]"
    return "NULL" if x is None else str(x)


def values(data) -> str:
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in data)


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}]', ' ', 'g'), ' +', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda x: length(x) >= 2)"


QUERY_SQL = f"q(query_id, query) AS (SELECT * FROM (VALUES {values(QUERY_SET)}))"
ASKED_SQL = f"{QUERY_SQL}, asked AS (SELECT query_id, query, {norm('query')} AS norm, {tokens(norm('query'))} AS tokens FROM q)"
CHUNK_SQL = f"""
t AS (SELECT doc_id, {trimmed("coalesce(text, '')")} AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(greatest(CAST(ceil(length(t) / {T.CHUNK_CHARS}.0) AS BIGINT), 1))) AS i FROM t),
c AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, {trimmed(f"substring(t, i * {T.CHUNK_CHARS} + 1, {T.CHUNK_CHARS})")} AS chunk_text FROM s),
chunks AS (SELECT *, {norm("chunk_text")} AS norm FROM c WHERE length(chunk_text) >= {T.MIN_CHUNK_CHARS})
"""


def bm25(toks: str, words: str) -> str:
    n = f"(1.5 * (0.25 + 0.75 * len({words}) / 120.0::DOUBLE))"
    f = f"(CASE WHEN length(t) < 2 THEN 0 ELSE len(list_filter({words}, lambda w: w = t)) END)"
    every = f"len({toks}) > 0 AND len(list_filter({toks}, lambda t: {f} = 0)) = 0"
    return f"(coalesce(list_sum(list_transform({toks}, lambda t: {f} * 2.5::DOUBLE / ({f} + {n}))), 0.0) + CASE WHEN {every} THEN 3.5 ELSE 0.0 END)"


def weight(toks: str, i: str) -> str:
    t = f"{toks}[{i} + 1]"
    return (
        f"(CASE WHEN length({t}) <= 2 THEN 0.8::DOUBLE WHEN length({t}) >= 4 THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END"
        f" + CASE WHEN len({toks}) >= 2 AND {i} = len({toks}) - 1 THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END"
        f" + CASE WHEN regexp_matches({t}, '[0-9]') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END)"
    )


def coverage(toks: str, words: str) -> str:
    w = weight(toks, "i")
    whole = f"list_sum(list_transform(range(len({toks})), lambda i: {w}))"
    hit = f"list_sum(list_transform(range(len({toks})), lambda i: CASE WHEN list_contains({words}, {toks}[i + 1]) THEN {w} ELSE 0.0::DOUBLE END))"
    return f"({hit} / {whole})"


def proximity(toks: str, words: str) -> str:
    place = f"(coalesce(list_position(list_transform({words}, lambda w: starts_with(w, t)), true), 0) - 1)"
    places = f"list_sort(list_filter(list_transform(list_distinct({toks}), lambda t: {place}), lambda p: p >= 0))"
    least = f"list_min(list_transform(range(1, len({places})), lambda i: ({places})[i + 1] - ({places})[i]))"
    return (
        f"CAST(CASE WHEN len({toks}) < 2 OR {least} IS NULL THEN 0 WHEN {least} <= 3 THEN 4 WHEN {least} <= 10 THEN 2 WHEN {least} <= 25 THEN 1 ELSE 0 END AS DOUBLE)"
    )


def in_window(toks: str, words: str, width: int = 15) -> str:
    # a window that holds all tokens may start at one of their places
    near = f"len(list_filter({toks}, lambda t: len(list_filter({words}[s + 1 : s + {width}], lambda w: starts_with(w, t))) = 0)) = 0"
    return f"(len({toks}) < 2 OR len(list_filter(range(len({words})), lambda s: {near})) > 0)"


def cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i]::DOUBLE * {y}[i]::DOUBLE))"
    return f"round({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 6)"
