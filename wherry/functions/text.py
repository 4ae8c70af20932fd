"""Text functions as columns: normalising, tokens, chunks, hashes, extraction."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS = 800
MIN_CHUNK_CHARS = 5
MAX_CANONICAL_TOKENS = 4096
MAX_STRUCTURAL_TOKENS = 12
TOKEN = r"[\p{L}\p{N}]{2,}"
STRUCTURAL_TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}_'’-]*"

#: Word families of the query side, form -> lemma.
LEMMAS = {"masini": "masina", "flori": "floare", "trandafiri": "trandafir", "copii": "copil"}
#: Pairs of phrases that stand for each other.
ALIASES = (("invoice", "factura"),)
#: Words by which a query asks for documents, asks for images, or names a visual subject.
DOCUMENT_WORDS = (
    "invoice", "factura", "facturi", "bill", "bills", "receipt", "chitanta", "contract", "document", "documents", "pdf",
    "report", "raport", "statement", "extras", "form", "formular", "passport", "pasaport", "certificate", "certificat",
    "license", "licence", "adeverinta",
)
IMAGE_WORDS = (
    "photo", "photos", "photograph", "photographs", "picture", "pictures", "image", "images", "poza", "poze", "imagine",
    "fotografie", "fotografii",
)
SUBJECT_WORDS = (
    "cat", "cats", "pisica", "pisici", "dog", "dogs", "caine", "caini", "rose", "roses", "trandafir", "flower", "flowers", "floare",
)


def trimmed(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


# ------------------------------------------------------------------ normalising


@cache
def _unaccented() -> tuple[str, str]:
    """Letters that decompose into one base and marks of U+0300-036F, and their bases."""
    made = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all("̀" <= m <= "ͯ" for m in marks):
            made.append((chr(code), base))
    return "".join(a for a, _ in made), "".join(b for _, b in made)


def unaccented(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_unaccented()), "[̀-ͯ]", "")


def normalized(c: Column) -> Column:
    """Search form: no accents, lower case, letters and digits apart by single spaces."""
    c = F.coalesce(c, F.lit(""))
    # a text of single bytes has no accents
    c = F.when(F.octet_length(c) == F.length(c), c).otherwise(unaccented(c))
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def canonical(c: Column) -> Column:
    """Canonical form of text that is composed already: lower case; accents stay."""
    return F.lower(F.coalesce(c, F.lit("")))


def compatible(c: Column) -> Column:
    """NFKC by an Arrow function, for scripts and compatibility forms that no built-in composes."""

    def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.pandas_udf(nfkc, T.StringType())(c)


def words(norm: Column) -> Column:
    """Words of a search form; the empty text has one empty word."""
    return F.split(norm, " ")


def query_tokens(norm: Column) -> Column:
    return F.filter(words(norm), lambda x: F.length(x) >= 2)


def lemmatised(norm: Column) -> Column:
    lemmas = F.create_map(*[F.lit(x) for pair in LEMMAS.items() for x in pair])
    return F.array_join(F.transform(words(norm), lambda w: F.coalesce(lemmas[w], w)), " ")


def alias_expansions(c: Column) -> Column:
    """Query with each place of an alias replaced by its other side, in order, each once."""
    text = F.trim(F.regexp_replace(canonical(c), r"\s+", " "))

    def replaced(tokens: Column, source: str, other: str) -> Column:
        n = len(source.split(" "))
        here = lambda i: F.get(tokens, i - 1) == source if n == 1 else F.array_join(F.slice(tokens, i, F.lit(n)), " ") == source
        starts = F.filter(F.sequence(F.lit(1), F.size(tokens)), here)
        parts = lambda i: F.concat(F.slice(tokens, F.lit(1), i - 1), F.array(F.lit(other)), F.slice(tokens, i + n, F.size(tokens)))
        return F.transform(starts, lambda i: F.array_join(parts(i), " "))

    def every(tokens: Column) -> Column:
        return F.array_distinct(F.concat(*[replaced(tokens, *pair) for a, b in ALIASES for pair in ((a, b), (b, a))]))

    # words are named through a lambda: as an expression they would be cut again at each place
    return F.get(F.transform(F.array(F.split(text, " ")), every), 0)


def document_intent(tokens: Column) -> Column:
    has = lambda words_: F.arrays_overlap(tokens, F.array(*map(F.lit, words_)))
    return (F.size(tokens) > 0) & (has(DOCUMENT_WORDS) | ~(has(IMAGE_WORDS) | has(SUBJECT_WORDS)))


def image_intent(tokens: Column) -> Column:
    has = lambda words_: F.arrays_overlap(tokens, F.array(*map(F.lit, words_)))
    return (F.size(tokens) > 0) & (has(IMAGE_WORDS) | has(SUBJECT_WORDS) | ~has(DOCUMENT_WORDS))


# ------------------------------------------------------------------ canonical terms


def canonical_tokens(c: Column) -> Column:
    return F.slice(F.regexp_extract_all(canonical(c), F.lit(TOKEN), F.lit(0)), 1, MAX_CANONICAL_TOKENS)


def canonical_terms(tokens: Column, once: bool = True) -> Column:
    """Tokens and pairs of neighbours; a term counts once however often it stands, or with ``once`` off as often as it does."""

    def made(tokens: Column) -> Column:
        first = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
        pairs = F.zip_with(first, F.slice(tokens, 2, MAX_CANONICAL_TOKENS), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.concat(tokens, pairs)) if once else F.concat(tokens, pairs)

    # tokens are named through a lambda, so that a text is cut once
    return F.get(F.transform(F.array(tokens), made), 0)


DOMAIN, VERSION = "term", "norm-v1"


def canonical_hash(term: Column, version: str = VERSION, domain: str = DOMAIN) -> Column:
    """32 hex characters of SHA-256 over length-prefixed domain, version and trimmed, collapsed text."""
    return hash_of(F.trim(F.regexp_replace(canonical(term), r"\s+", " ")), version, domain)


def hash_of(text: Column, version: str = VERSION, domain: str = DOMAIN) -> Column:
    """The canonical hash of text that is in canonical form already, as the terms of ``canonical_terms`` are."""
    fields = (F.lit(domain), F.lit(version), text)
    parts = [x for f in fields for x in (F.unhex(F.lpad(F.hex(F.octet_length(f)), 8, "0")), F.encode(f, "utf-8"))]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def hash_head(text: bytes, version: str = VERSION, domain: str = DOMAIN) -> bytes:
    """What ``hash_of`` hashes, up to the text itself, for Python that hashes each term of a batch once."""
    fields = (domain.encode(), version.encode())
    return b"".join(len(f).to_bytes(4, "big") + f for f in fields) + len(text).to_bytes(4, "big")


# ------------------------------------------------------------------ structural spans


def structural_tokens(c: Column) -> Column:
    text = F.trim(F.regexp_replace(canonical(c), r"\s+", " "))
    return F.slice(F.regexp_extract_all(text, F.lit(STRUCTURAL_TOKEN), F.lit(0)), 1, MAX_STRUCTURAL_TOKENS)


# ------------------------------------------------------------------ chunks


def chunk_spans(c: Column) -> Column:
    """array<struct<chunk_index, chunk_text>>: trimmed 800-character slices that are not empty.

    ``c`` is a column of trimmed text: an expression would be computed again for each slice.
    """
    text = c
    last = F.greatest(F.ceil(F.length(text) / CHUNK_CHARS).cast("int") - 1, F.lit(0))
    made = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("chunk_index"), trimmed(F.substr(text, i * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS))).alias("chunk_text")),
    )
    return F.filter(made, lambda x: F.length(x["chunk_text"]) > 0)


# ------------------------------------------------------------------ extraction


def xml_to_text(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return trimmed(F.regexp_replace(c, r"\s+", " "))


def mail_html_to_text(c: Column) -> Column:
    """Scripts and styles go, block ends become line ends, other tags blanks."""
    c = F.coalesce(c, F.lit(""))
    for tag in ("script", "style"):
        c = F.regexp_replace(c, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</p\s*>|</div\s*>|</li\s*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(c, r"[ \t\x0B\f\r]+", " ")
    return trimmed(F.regexp_replace(c, r" *\n+ *", "\n"))


def ocr_normalized(c: Column) -> Column:
    """Words of two letters or more of the Latin letters and digits that OCR can read, lower case."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9ăâîșțĂÂÎȘȚ\s]", " ")
    return F.array_join(F.transform(F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: F.length(w) >= 2), F.lower), " ")


def distinct_matches(c: Column, pattern: str) -> Column:
    return F.array_join(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))), ", ")


PERSON = r"\b[A-ZĂÂÎȘȚ][a-zăâîșț]+\s+[A-ZĂÂÎȘȚ][a-zăâîșț]+\b"
LONG_NUMBER = r"\b\d{4,}\b"


def document_type(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(low.contains("invoice") | low.contains("factura"), "invoice")
        .when(low.contains("identity") | low.contains("identitate"), "identity")
        .when(low.contains("contract"), "contract")
        .otherwise("")
    )


def snippet_text(c: Column) -> Column:
    """Text on one line, as snippets are cut from it."""
    return trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def first_token(tokens: Column, low: Column) -> Column:
    """The first query token that stands in the lower-cased text; null if none."""
    return F.get(F.filter(tokens, lambda t: (F.trim(t) != "") & low.contains(F.lower(t))), 0)


def snippet(clean: Column, token: Column, pos: Column) -> Column:
    """Text around the place (from 0) of ``token``, which is marked; without one the first 180 characters.

    Give columns, not expressions: they are named many times.
    """
    start, end = F.greatest(F.lit(0), pos - 3), F.least(F.length(clean), pos + 140)
    part = F.substr(clean, start + 1, end - start)
    part = F.concat(F.when(start > 0, "...").otherwise(""), part, F.when(end < F.length(clean), " ...").otherwise(""))
    quoted = F.concat(F.lit(r"(?i)\Q"), token, F.lit(r"\E"))
    marked = F.regexp_replace(part, quoted, F.concat(F.lit("【"), F.upper(token), F.lit("】")))
    short = F.when(F.length(clean) > 180, F.concat(F.substring(clean, 1, 180), F.lit("..."))).otherwise(clean)
    return F.when(token.isNull(), short).otherwise(marked)


def fallback_snippet(c: Column, chars: int = 220) -> Column:
    """The start of a text on one line, where no query word is to be shown; line ends are blanks."""
    text = trimmed(F.translate(F.coalesce(c, F.lit("")), "\n\r", "  "))
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def extension(name: Column) -> Column:
    """Lower-cased extension: after the last dot, if that is after the last slash and not the end."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./\\]+)$", 1))


#: Folders that say nothing about where a file comes from.
PLAIN_FOLDERS = ("storage", "emulated", "primary", "media", "data", "files")


def source_label(path: Column, kind: Column) -> Column:
    """Where a file comes from, by its kind and path."""
    path = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    clean = lambda x: F.upper(F.translate(trimmed(x), "_-", "  "))
    parts = F.transform(F.split(path, "/"), clean)
    folders = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    seen = lambda x: F.when(x.contains("SCREENSHOT"), "SCREENSHOTS").when(x.contains("WHATSAPP"), "WHATSAPP").when(x.contains("TIKTOK"), "TIKTOK")
    known = lambda x: F.when(x == "DCIM", "DCIM").when(x.isin("DOWNLOAD", "DOWNLOADS"), "DOWNLOADS").when(x.isin("DOCUMENT", "DOCUMENTS"), "DOCUMENTS")
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), 0)
    plain = F.get(F.filter(folders, lambda x: (x != "") & ~x.rlike(r"^\p{Nd}+$") & ~F.lower(x).isin(*PLAIN_FOLDERS)), 0)
    rest = F.when(F.trim(F.coalesce(kind, F.lit(""))) == "", "DOCUMENT").otherwise(clean(kind))
    return (
        F.when(F.upper(kind) == "EMAIL", "EMAIL")
        .when(F.lower(path).contains("email_attachment") | F.lower(path).contains("email-attachment"), "EMAIL ATTACHMENT")
        .otherwise(F.coalesce(first(F.transform(folders, seen)), first(F.transform(parts, known)), plain, rest))
    )


#: Extensions of images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "heic", "heif")


def category(kind: Column, name: Column) -> Column:
    kind, ext = F.upper(F.trim(F.coalesce(kind, F.lit("")))), extension(name)
    return (
        F.when(kind == "EMAIL", "EMAIL")
        .when((kind == "IMAGE") | ext.isin(*IMAGE_EXTENSIONS), "IMAGES")
        .when((kind == "PDF") | (ext == "pdf"), "PDF")
        .when(ext.isin("doc", "docx"), "WORD")
        .when(ext.isin("xls", "xlsx"), "EXCEL")
        .when(ext.isin("ppt", "pptx"), "POWERPOINT")
        .when(ext == "txt", "TEXT")
        .otherwise("OTHER_DOCUMENTS")
    )


#: Folders and sizes by which machine-made files are known.
GENERATED_FOLDERS = ("build", "dist", "target", "out", "cache", "tmp", "temp", "generated", "node_modules", "__pycache__")
SAMPLE_CHARS = 24 * 1024
LARGE_CHARS = 512 * 1024
#: Phrases by which a generator names itself; the last two only together.
DECLARED = ("automatically generated", "auto-generated", "machine generated", "generated file")
DECLARED_BOTH = ("generated by", "do not edit")


def policy_signals(path: Column, text: Column) -> dict[str, Column]:
    """The five signs of a low-value, machine-made file; over samples of its head, middle and tail."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    middle = F.when(n > 2 * SAMPLE_CHARS, F.substr(text, F.floor(n / 2).cast("int") + 1, F.lit(SAMPLE_CHARS))).otherwise("")
    tail = F.when(n > SAMPLE_CHARS, F.substr(text, n - SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS))).otherwise("")
    sample = F.lower(F.concat(F.substring(text, 1, SAMPLE_CHARS), middle, tail))
    size = F.length(sample)
    has = lambda *xs: sample.rlike("|".join(xs))
    declared = has(*DECLARED) | (has(DECLARED_BOTH[0]) & has(DECLARED_BOTH[1]))
    angles = F.regexp_count(sample, F.lit("[<>]"))
    markup = (size >= 1000) & (F.regexp_count(sample, F.lit("</")) >= 20) & (F.floor(angles * 100 / size) >= 3)
    tokens = F.filter(F.split(sample, r"\s+"), lambda t: F.length(t) >= 3)
    odd = F.size(F.filter(tokens, lambda t: t.rlike(r"[/\\_=<>]")))
    prose = (size >= 2000) & (F.size(tokens) >= 100) & (F.floor(odd * 100 / F.size(tokens)) >= 45)
    folder = F.arrays_overlap(F.split(F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), "/"), F.array(*map(F.lit, GENERATED_FOLDERS)))
    return {"large_file": n >= LARGE_CHARS, "generated_path": folder, "declaration": declared, "markup_heavy": markup, "low_prose": prose}


def policy_skips(s: dict[str, Column]) -> Column:
    count = sum((c.cast("int") for c in s.values()), F.lit(0))
    return (s["declaration"] & (count >= 2)) | ((count >= 3) & s["large_file"] & (s["markup_heavy"] | s["low_prose"]))


def stable_mail_id(provider: Column, account: Column, message: Column) -> Column:
    """email://provider/account/message, each in unpadded URL-safe base64."""
    # line ends, which long values get, are left out
    b64 = lambda x: F.rtrim(F.translate(F.base64(F.encode(x, "utf-8")), "+/\r\n", "-_"), F.lit("="))
    return F.concat(F.lit("email://"), b64(F.lower(provider)), F.lit("/"), b64(account), F.lit("/"), b64(message))


def mail_index_text(subject: Column, sender: Column, to: Column, cc: Column, body: Column) -> Column:
    """The fields that are not empty, trimmed, a line each; ``to`` and ``cc`` are arrays."""
    fields = F.concat(F.array(subject, sender), to, cc, F.array(body))
    return F.array_join(F.filter(F.transform(fields, lambda x: trimmed(F.coalesce(x, F.lit("")))), lambda x: x != ""), "\n")


def decimal_thread_id(hex_id: Column) -> Column:
    """A hexadecimal thread id in decimal; what is not hexadecimal stays."""
    value = F.trim(F.coalesce(hex_id, F.lit("")))
    return F.when(value.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(value, 16, 10)).otherwise(value)
