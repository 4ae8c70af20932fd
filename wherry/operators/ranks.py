"""Places in a global order: running totals over partitions, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.feeds import work_dir

#: Partitions that a window of a level holds at most.
FAN = 256


def offsets(counts: DataFrame, by: list[str], part: str = "part", n: str = "n") -> DataFrame:
    """(by, part, before): how many of a group's rows lie in its earlier partitions.

    ``counts`` has the rows ``n`` of each group ``by`` in each partition ``part`` (0, 1, ...;
    not null). Totals are made over blocks of ``FAN`` partitions, blocks of blocks and so on, so
    a window never holds more than ``FAN`` rows, however many partitions a hot group spans. Only
    the largest partition number comes to the driver. Null groups are groups of their own; no
    rows give no rows.
    """
    level = counts.groupBy(*by, F.col(part).cast("long").alias("__p")).agg(F.sum(n).cast("long").alias("__n"))
    most = counts.agg(F.max(part)).first()[0] or 0
    out = None
    shift = 0
    while True:
        block = F.shiftright("__p", 8)
        earlier = Window.partitionBy(*by, block).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        here = level.select(*by, "__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
        if out is None:
            out = here
        else:
            up = here.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], F.col("__p").alias("__up"), F.col("__before").alias("__more"))
            same = F.shiftright("__p", shift) == F.col("__up")
            for i, c in enumerate(by):
                same &= F.col(c).eqNullSafe(F.col(f"__{i}"))
            out = out.join(up, same).select(*by, "__p", (F.col("__before") + F.col("__more")).alias("__before"))
        if most >> (shift + 8) == 0:
            break
        shift += 8
        level = level.groupBy(*by, block.alias("__p")).agg(F.sum("__n").alias("__n"))
    return out.select(*by, F.col("__p").cast("int").alias(part), F.col("__before").alias("before"))


def ranked(rows: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in a global order of columns such as ``F.desc("score")`` or names; the order must be total for the places to be determined.

    Rows are sorted over all tasks and written once, in that order; a row's place is its place
    in its partition and the rows of those before it. No rows give no rows.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    path = work_dir(spark, "ranked")
    placed.write.parquet(path)
    lined = spark.read.schema(placed.schema).parquet(path)
    # (the number of the partition, and the place in it, as Spark documents them)
    part = F.shiftright("__at", 33).cast("int")
    lined = lined.withColumns({"__part": part, "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = offsets(lined.groupBy("__part").agg(F.count(F.lit(1)).alias("n")), [], "__part")
    return lined.join(before, "__part").withColumn(out, F.col("before") + F.col("__place") + 1).drop("__at", "__part", "__place", "before")


def rank_correlation(scores: DataFrame, a: str, b: str, position: list[str]) -> DataFrame:
    """One row: n, pearson and rank (the correlation of descending ranks; ties go by position). Null scores rank last; fewer than two rows correlate with nothing."""
    one = ranked(scores.select(a, b, *position), [F.desc_nulls_last(a), *position], "__a")
    two = ranked(one, [F.desc_nulls_last(b), *position], "__b")
    return two.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(a, b), 6).alias("pearson"), F.round(F.corr("__a", "__b"), 6).alias("rank"))
