"""From raw documents to token ids: toxicity, boilerplate, near duplicates, benchmarks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes each stage's result in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.llm import decontaminate, line_dedup, ngram_join, sentencepiece_codec, toxicity
from wherry.llm.shared import dropped, free_name, left, swept, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from ``docs`` and labels.

    Every row is judged by its own text: null and shared ids, repeated rows and null or empty
    texts (scored by the bias alone) need no rule of their own. No rows give no rows.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that stand on many sites; n_chars follows a text that changed.

    Null and empty texts stay; a null source is the one site ''. Null and shared ids and
    repeated rows get their own text's result. No rows give no rows.
    """
    out = line_dedup.cleaned(docs)
    new = {"text": F.col("line.text"), "n_chars": F.when(F.col("line.n_removed") > 0, F.char_length("line.text")).otherwise(F.col("doc.n_chars")).cast("long")}
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the smallest id's (null ids last, ties by a hash of the text).

    Rows are told apart by id and text, so another text under the same id is judged by itself;
    of rows that repeat both, one stays. Rows without words (null, empty) all stay. No rows give
    no rows.
    """
    joined, path = written(ngram_join.ngram_join(docs).where("class_key IS NOT NULL").select("doc_id", "text_hash", "class_key"), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = joined.groupBy("class_key").agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("first"))
    both = joined.join(first, "class_key").withColumn("stays", F.col("text_hash").eqNullSafe(F.col("first.text_hash")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    # (written, so that their number is known)
    names = [free_name(docs, n) for n in ("id", "text_hash")]
    others, others_path = written(both.where("NOT stays").select("doc_id", "text_hash").distinct().toDF(*names), "others")
    again = both.where("stays").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again, again_path = written(again.select("doc_id", "text_hash").toDF(*names), "repeated")
    dropped(spark, path)
    left(others_path, again_path)
    same = (F.xxhash64("text") == F.col(names[1])) & F.col("doc_id").eqNullSafe(F.col(names[0]))
    kept = docs.join(others.hint("shuffle_hash"), same, "left_anti")  # the same plan at every size; texts need no sort
    if again.isEmpty():
        return kept
    # rows that repeat id and text are rare: only they are brought together
    one = kept.join(again, same, "left_semi").withColumn(names[1], F.xxhash64("text")).dropDuplicates(["doc_id", names[1]]).drop(names[1])
    return kept.join(again, same, "left_anti").unionByName(one)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark, each judged by its own text.

    Null and empty texts hold none and stay; null and shared ids and repeated rows need no rule.
    No rows, or an empty benchmark, change nothing.
    """
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, n_tokens, ids, parity.

    Null and empty texts have no ids; null and shared ids and repeated rows get a row each.
    """
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("n-gram join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: Hashing, trained models and tokenizers have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path, known = None, left()
    for name, stage in STAGES:
        docs, new = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        swept(spark, known)
        if path:
            dropped(spark, path)
        path = new
    return docs
