"""Building the indexes: chunks, postings, canonical terms, vocabulary, language metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.barrier import settled


def chunks(docs: DataFrame, min_chars: int = T.MIN_CHUNK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunk_text, norm: a narrow transformation, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), T.trimmed(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    rows = rows.select("doc_id", F.explode(T.chunk_spans(F.col("t"))).alias("c"))
    rows = rows.select("doc_id", F.col("c.chunk_index").cast("int").alias("chunk_index"), F.col("c.chunk_text").alias("chunk_text"))
    return rows.where(F.length("chunk_text") >= min_chars).withColumn("norm", T.normalized(F.col("chunk_text")))


def embeds(chunk_index, every: int = 3):
    """Every third chunk is embedded."""
    return F.pmod(chunk_index, F.lit(every)) == 0


def postings(chunked: DataFrame) -> DataFrame:
    """token, doc_id, chunk_index, tf, first_pos: one row for each token of a chunk.

    All rows of a chunk come from one input row, so the partial aggregate is the whole count.
    """
    rows = chunked.select("doc_id", "chunk_index", F.posexplode(T.words(F.col("norm"))).alias("pos", "token"))
    rows = rows.where(F.length("token") >= 2)
    return rows.groupBy("token", "doc_id", "chunk_index").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").cast("long").alias("first_pos"))


def own_postings(chunked: DataFrame) -> DataFrame:
    """What ``postings`` gives of chunks that are one row each: a chunk's words are sorted and counted where it lies, and nothing moves."""
    placed = F.transform(T.words(F.col("norm")), lambda w, i: F.struct(w.alias("token"), i.alias("pos")))
    rows = settled(chunked.select("doc_id", "chunk_index", "norm"), p=F.sort_array(F.filter(placed, lambda x: F.length(x["token"]) >= 2))).where(F.size("p") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get("p", i)["token"] != F.get("p", i - 1)["token"]))
    rows = settled(rows.drop("norm"), first=first)
    tf = lambda i, k: F.coalesce(F.get("first", k + 1), F.size("p")) - i
    each = lambda i, k: F.struct(F.get("p", i)["token"].alias("token"), tf(i, k).cast("long").alias("tf"), F.get("p", i)["pos"].cast("long").alias("first_pos"))
    return rows.select("doc_id", "chunk_index", F.inline(F.transform("first", each))).select("token", "doc_id", "chunk_index", "tf", "first_pos")


def document_postings(docs: DataFrame) -> DataFrame:
    """What ``postings`` gives of the chunks of ``docs`` (doc_id, text); only documents whose id several rows have are brought together."""
    docs = docs.select("doc_id", "text")
    several = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"))
    if several.isEmpty():
        return own_postings(chunks(docs))
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    return own_postings(chunks(docs.join(several, same, "left_anti"))).unionByName(postings(chunks(docs.join(several, same, "left_semi"))))


def vocabulary(chunked: DataFrame, min_chars: int = 3, asked: DataFrame | None = None) -> DataFrame:
    """Distinct words of three characters or more; with ``asked`` (token; a stated set) only those that begin like one of them, which is all that ``expansions`` looks at."""
    words = F.filter(T.words(F.col("norm")), lambda w: F.length(w) >= min_chars)
    if asked is not None:
        begins = asked.where(F.length("token") >= min_chars).agg(F.collect_set(F.substring("token", 1, min_chars)).alias("begins"))  # one row
        chunked = chunked.select("norm").crossJoin(F.broadcast(begins))
        words = F.filter(words, lambda w: F.array_contains("begins", F.substring(w, 1, min_chars)))
    return chunked.select(F.explode(words).alias("word")).distinct()


def expansions(tokens: DataFrame, vocab: DataFrame, used: int = 5, min_chars: int = 3) -> DataFrame:
    """token, word, ord: the shortest words that start with each token (ties by word).

    The join is an equality on the first ``min_chars`` characters; the window keeps a bounded
    number of rows per token before anything is sorted in full (WindowGroupLimit).
    """
    asked = tokens.select("token").where(F.length("token") >= min_chars).distinct()
    pairs = vocab.join(
        F.broadcast(asked),  # the tokens of a stated query set
        (F.substring("word", 1, min_chars) == F.substring("token", 1, min_chars)) & F.col("word").startswith(F.col("token")),
    )
    order = Window.partitionBy("token").orderBy(F.length("word"), "word")
    return pairs.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= used)


def canonical_postings(chunked: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """hash, doc_id, chunk_index: a term counts once in a chunk; only of the ``asked`` terms (term, those of a stated query set), if given."""
    terms = T.canonical_terms(T.canonical_tokens(F.col("chunk_text")))
    rows = _asked_terms(chunked.select("doc_id", "chunk_index", F.explode(terms).alias("term")), asked)
    return rows.select(T.hash_of(F.col("term")).alias("hash"), "doc_id", "chunk_index")


def _asked_terms(rows: DataFrame, asked: DataFrame | None) -> DataFrame:
    """Terms that are not asked go before they are counted, hashed or moved."""
    return rows if asked is None else rows.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")


def counted_postings(chunked: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """hash, doc_id, chunk_index, tf: terms with how often they stand in a chunk, hashed once for each chunk; only of the ``asked`` terms (term), if given."""
    terms = T.canonical_terms(T.canonical_tokens(F.col("chunk_text")), once=False)
    rows = _asked_terms(chunked.select("doc_id", "chunk_index", F.explode(terms).alias("term")), asked).groupBy("doc_id", "chunk_index", "term").agg(F.count(F.lit(1)).alias("tf"))
    return rows.select(T.hash_of(F.col("term")).alias("hash"), "doc_id", "chunk_index", "tf")


def published_lookup(hashes: DataFrame, index: DataFrame, files: DataFrame, limit: int = 1000) -> DataFrame:
    """query_id, doc_id, chunk_index, matched, tf, ord: chunks of published files with any hash of each query.

    ``index`` has counted postings, ``files`` doc_id and state. Most terms first, then most
    occurrences, then by file and chunk; ``limit`` is the page.
    """
    asked = hashes.select("query_id", "hash").distinct()
    shown = files.where(F.col("state") == "PUBLISHED").select("doc_id").distinct()
    found = index.join(F.broadcast(asked), "hash").groupBy("query_id", "doc_id", "chunk_index").agg(F.count(F.lit(1)).alias("matched"), F.sum("tf").alias("tf"))
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("tf"), "doc_id", "chunk_index")
    return found.join(shown, "doc_id", "left_semi").withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= limit)


def without_documents(index: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without those of ``gone`` (doc_id); a term that loses all its postings is gone too."""
    return index.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def strong_prefix(asked: DataFrame, vocab: DataFrame, min_chars: int = 4, longer: int = 2, least: int = 2) -> DataFrame:
    """query_id, strong: whether some token of ``min_chars`` or more starts ``least`` words that are ``longer`` characters longer."""
    tokens = asked.select("query_id", F.explode("tokens").alias("token")).where(F.length("token") >= min_chars).distinct()
    words = vocab.join(
        F.broadcast(tokens.select("token").distinct()),  # the tokens of a stated query set
        (F.substring("word", 1, min_chars) == F.substring("token", 1, min_chars)) & F.col("word").startswith(F.col("token")) & (F.length("word") >= F.length("token") + longer),
    )
    hit = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = tokens.join(hit, "token").select("query_id").distinct().withColumn("strong", F.lit(True))
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("strong", F.lit(False)).alias("strong"))


def postings_lookup(hashes: DataFrame, index: DataFrame, every: bool = False, limit: int | None = None) -> DataFrame:
    """query_id, doc_id, chunk_index, matched, ord: chunks with any (or ``every``) hash of each query."""
    asked = hashes.select("query_id", "hash").distinct()
    found = index.join(F.broadcast(asked), "hash").groupBy("query_id", "doc_id", "chunk_index").agg(F.count(F.lit(1)).alias("matched"))
    if every:
        n = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        found = found.join(F.broadcast(n), "query_id").where("matched = n").drop("n")
    return ordered_lookup(found, limit)


def ordered_lookup(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds ``ord``: most terms first, then by file and chunk; the first ``limit`` of a query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), "doc_id", "chunk_index")
    ranked = found.withColumn("ord", F.row_number().over(order))
    return ranked.where(F.col("ord") <= limit) if limit else ranked


#: Translation families and the language tags they serve.
FAMILIES = {
    "romance": ("ro", "fr", "es", "it", "pt"),
    "germanic": ("de", "nl", "sv", "da", "no", "is"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "greek": ("el",),
    "turkish": ("tr",),
}


def language_route(lang):
    """Family of a language tag: identity for English, und when unknown, else unsupported."""
    low = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    out = F.when(low == "en", "identity").when(low.isin("", "und"), "und")
    for family, tags in FAMILIES.items():
        out = out.when(low.isin(*tags), family)
    return out.otherwise("unsupported")


def language_meta(chunked: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks and characters of each document in each language, with its route."""
    rows = chunked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("chunk_text")).alias("char_count"))
    return docs.select("doc_id", "lang", language_route(F.col("lang")).alias("family")).join(rows, "doc_id")


def language_summary(meta: DataFrame) -> DataFrame:
    return meta.groupBy("lang", "family").agg(
        F.count_distinct("doc_id").alias("docs"), F.sum("chunk_count").alias("chunks"), F.sum("char_count").alias("chars")
    )


def language_profile(meta: DataFrame, key: str) -> DataFrame:
    """Dominant language (most characters, ties by tag) and whether there are several."""
    per = meta.groupBy(key, "lang").agg(F.sum("char_count").alias("chars"))
    return per.groupBy(key).agg(
        F.min_by("lang", F.struct((-F.col("chars")).alias("c"), F.col("lang"))).alias("dominant"),
        (F.count(F.lit(1)) > 1).alias("mixed"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"),
    )
