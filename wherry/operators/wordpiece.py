"""WordPiece ids of texts: each distinct word is cut once, by a join with the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.barrier import settled

#: Fixed values of the encoder: ids of padding, unknown words, the begin and the end of a text; ids of a text; the longest word; the mark of what goes on a word.
PAD, UNKNOWN, BEGIN, END = 0, 100, 101, 102
MAX_IDS, MAX_WORD = 128, 100
GOES_ON = "##"
#: Characters of a text that are cleaned first; only where they hold too few words is the whole text.
HEAD = 2048


def cleaned(c: Column) -> Column:
    """Lower case without accents, everything but a to z and digits a blank."""
    return F.trim(F.regexp_replace(T.unaccented(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def segmented(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, ids (array<int>): every distinct word from its start on by the longest piece of the vocabulary, or the unknown id.

    ``vocab`` has piece and id; pieces that go on a word begin with ``##``. All parts of a word
    that are no longer than the longest piece are joined with the vocabulary, which Spark
    broadcasts or shuffles as its size asks; the longest piece at each place is then followed
    from the start of the word to its end. Words of more than ``MAX_WORD`` characters and those
    with a place where no piece fits are unknown.
    """
    words = words.select("word").where("word <> ''").distinct()
    longest = vocab.agg(F.max(F.length(F.regexp_replace("piece", f"^{GOES_ON}", "")))).first()[0] or 0
    short = words.where(F.length("word") <= MAX_WORD)
    n = F.length("word")
    each = short.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    each = each.select("word", "start", F.explode(F.sequence(F.lit(1), F.greatest(F.least(n - F.col("start"), F.lit(longest)), F.lit(1)))).alias("n"))
    piece = F.concat(F.when(F.col("start") > 0, GOES_ON).otherwise(""), F.substr("word", F.col("start") + 1, F.col("n")))
    hits = each.select("word", "start", "n", piece.alias("piece")).join(vocab.select("piece", "id"), "piece")
    best = hits.groupBy("word", "start").agg(F.max(F.struct("n", "id")).alias("b"))
    places = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("start", "b"))).alias("places"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))

    def step(state: Column, place: Column) -> Column:
        hit = F.col("places")[place]
        here = (state["at"] == place) & hit.isNotNull()
        return F.when(here, F.struct((place + hit["n"]).alias("at"), F.concat(state["ids"], F.array(hit["id"].cast("int"))).alias("ids"))).otherwise(state)

    rows = words.join(places, "word", "left")
    cut = F.aggregate(F.sequence(F.lit(0), F.length("word") - 1), none, step)
    rows = rows.withColumn("cut", F.when(F.col("places").isNotNull(), cut))
    whole = F.col("cut.at") == F.length("word")
    return rows.select("word", F.when(F.coalesce(whole, F.lit(False)), F.col("cut.ids")).otherwise(F.array(F.lit(UNKNOWN))).alias("ids"))


def encoded(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, input_ids (``MAX_IDS`` of them), n_ids: begin, the words' ids as far as they fit, end, padding.

    A word has an id at least, so only as many words as ids can count are looked up. Null and
    empty texts are begin and end. Ids of documents are unique and not null.
    """
    room = MAX_IDS - 2
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), head=F.split(cleaned(F.substring("text", 1, HEAD)), " "))
    enough = (F.size("head") > room) | (F.length(F.coalesce("text", F.lit(""))) <= HEAD)  # the last word of a head may be cut off
    rows = settled(rows, words=F.slice(F.when(enough, F.col("head")).otherwise(F.split(cleaned(F.col("text")), " ")), 1, room)).select("doc_id", "words")
    each = rows.select("doc_id", F.posexplode("words").alias("at", "word")).where("word <> ''")
    found = each.join(segmented(each.select("word"), vocab), "word")
    ids = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("w"))  # as many as there is room for
    rows = rows.select("doc_id").join(ids.select("doc_id", F.slice(F.flatten("w.ids"), 1, room).alias("ids")), "doc_id", "left")
    rows = rows.withColumn("ids", F.concat(F.array(F.lit(BEGIN)), F.coalesce("ids", F.array().cast("array<int>")), F.array(F.lit(END))))
    padded = F.concat("ids", F.array_repeat(F.lit(PAD), MAX_IDS - F.size("ids")))
    return rows.select("doc_id", padded.alias("input_ids"), F.size("ids").cast("long").alias("n_ids"))
