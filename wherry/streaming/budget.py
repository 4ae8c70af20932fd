"""Work under a time budget, and work that waits for what it needs: postponed, tried again, failed in the end."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feeds import arrivals

#: Seconds that a file may take, and how often a file that took longer is tried again.
BUDGET_S, RETRIES = 30.0, 2
#: Files of a batch of reconciliation.
SWEEP = 64

DONE, POSTPONED, FAILED = "done", "postponed", "failed"


class Timed:
    """Runs a function of one text, and says what it gave and the seconds it took; what takes longer than ``seconds`` is given up."""

    def __init__(self, work: Callable[[str], object], seconds: float = BUDGET_S) -> None:
        self.work, self.seconds = work, seconds
        self.pool = ThreadPoolExecutor(1)

    def __call__(self, text: str, attempt: int) -> tuple[object, float]:
        began = time.monotonic()
        asked = self.pool.submit(self.work, text)
        try:
            return asked.result(self.seconds), time.monotonic() - began
        except Late:
            # the thread cannot be stopped: it is left to end, and the next text gets a new one
            self.pool.shutdown(wait=False, cancel_futures=True)
            self.pool = ThreadPoolExecutor(1)
            return None, float("inf")


def attempted(rows: DataFrame, make: Callable[[], Callable[[str, int], tuple]], kind: str, seconds: float = BUDGET_S, retries: int = RETRIES) -> DataFrame:
    """``rows`` (id, text, attempt) with status, value (of Spark type ``kind``) and error.

    ``make`` gives, once a task, a function of a text and its attempt (from 0) that returns a
    value and the seconds it took. Within the budget that is done, beyond it postponed; after
    ``retries`` more attempts, or an exception, it has failed. A null text is done, with a null
    value.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = make()
        for part in parts:
            out = []
            for text, attempt in zip(part["text"], part["attempt"], strict=True):
                try:
                    value, took = work(text, int(attempt)) if text is not None else (None, 0.0)
                    error = None if took <= seconds else f"over {seconds:g} s"
                    status = DONE if took <= seconds else POSTPONED if attempt < retries else FAILED
                    out.append((status, value if status == DONE else None, error))
                except Exception as e:  # noqa: BLE001  one bad text must not end the stream
                    out.append((FAILED, None, f"{type(e).__name__}: {e}"))
            made = pd.DataFrame(out, columns=["status", "value", "error"], index=part.index, dtype=object)
            yield pd.concat([part, made], axis=1)

    return rows.select("id", "text", "attempt").mapInPandas(run, f"{_types(rows)}, status string, value {kind}, error string")


def _types(rows: DataFrame) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in ("id", "text", "attempt"))


def drained(spark: SparkSession, queue: str, out: str, checkpoint: str, schema: str, work: Callable[[DataFrame], DataFrame], files_per_batch: int = SWEEP) -> DataFrame:
    """Run ``work`` over a queue of files until it is empty; id, attempt, status, value, error of the ends.

    ``queue`` is a folder of Parquet files (id, text, attempt). Rows that ``work`` postpones go
    to the end of the queue, a file of the batch's own name, so a batch that comes again after a
    failure writes the same files. Postponed rows are not among the results: each id ends once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        made = work(batch).persist()
        try:
            made.where(F.col("status") != POSTPONED).drop("text").write.mode("overwrite").parquet(f"{out}/b{number}")
            later = made.where(F.col("status") == POSTPONED)
            if not later.isEmpty():
                later.select("id", "text", (F.col("attempt") + 1).alias("attempt")).write.mode("overwrite").parquet(f"{queue}/again{number}")
        finally:
            made.unpersist()

    source = arrivals(spark, f"{queue}/*", spark.createDataFrame([], schema).schema, files_per_batch)
    stream = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.parquet(f"{out}/*")


# ------------------------------------------------------------------ capabilities


def capabilities(needs: DataFrame, present: DataFrame, depth: int = 8) -> DataFrame:
    """capability, state: FULL if it and all it needs, directly or not, are present; else BLOCKED.

    ``needs`` has capability and needed, ``present`` capability. A capability that needs itself
    in a circle asks for no more than the circle. ``depth`` bounds the steps of needs, which are
    few: there are as many rows as kinds of capabilities, not as files.
    """
    pairs = needs.select("capability", "needed").distinct()
    every = pairs.select("capability").unionByName(pairs.select(F.col("needed").alias("capability"))).unionByName(present.select("capability")).distinct()
    closed = every.select("capability", F.col("capability").alias("needed"))
    step = pairs.select(F.col("capability").alias("by"), F.col("needed").alias("more"))
    levels = [closed]
    for _ in range(depth):
        levels.append(levels[-1].join(step, F.col("needed") == F.col("by")).select("capability", F.col("more").alias("needed")).distinct())
    closed = reduce(DataFrame.unionByName, levels).distinct()
    held = present.select(F.col("capability").alias("needed"), F.lit(True).alias("ok")).distinct()
    known = closed.join(held, "needed", "left").groupBy("capability").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("full"))
    return known.select("capability", F.when(F.col("full"), "FULL").otherwise("BLOCKED").alias("state"))


def released(files: DataFrame, states: DataFrame) -> DataFrame:
    """Files that wait for a package (state PACKAGE_MISSING) whose capability is now FULL."""
    full = states.where("state = 'FULL'").select("capability")
    return files.where("state = 'PACKAGE_MISSING'").join(F.broadcast(full), "capability", "left_semi")  # there are few kinds
