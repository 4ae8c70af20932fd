"""Files as DataFrames: listing, routing, plain text, office documents, PDF and image hooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.sax.saxutils import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Folders that hold no documents, and extensions by the way they are read.
SKIPPED = r"(?i)/android/(data|obb)/|/cache/|/\.thumbnails/"
IMAGES = T.IMAGE_EXTENSIONS
DOCUMENTS = ("txt", "html", "htm", "csv", "json", "xml", "md", "rtf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
PLAIN = ("txt", "csv", "json", "xml", "md", "html", "htm")
#: Words of which any one tells a screenshot of the search itself.
OWN_SCREENSHOT = ("ai search results", "ai search explanation", "memories found", "ai detected the searched terms")


def listing(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """path, modified, size (and content) of all files below a folder, but those of skipped folders.

    Without ``content`` only the listing is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    columns = ["path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *(["content"] if content else [])]
    return files.where(~F.col("path").rlike(SKIPPED)).select(*columns)


def route(path: Column) -> Column:
    """IMAGE, PDF, DOCUMENT or null (not indexed), by extension."""
    ext = T.extension(path)
    return F.when(ext.isin(*IMAGES), "IMAGE").when(ext == "pdf", "PDF").when(ext.isin(*DOCUMENTS), "DOCUMENT")


def discovered(files: DataFrame) -> DataFrame:
    return files.select(route(F.col("path")).alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def internal_artifact(name: Column) -> Column:
    return name.rlike(r"^(canonical_runtime_.*|mcanonical.*\.pdf|m\d+_progress\.xml)$")


def own_screenshot(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (low.contains(w) for w in OWN_SCREENSHOT))


def resumed(files: DataFrame, last: str | None) -> DataFrame:
    """Files after the last path of an interrupted run, in the order of their paths."""
    return files.where(F.col("path") > last) if last else files


def plain_text(content: Column, strip_html: bool = True, path: Column | None = None) -> Column:
    """Lines joined by blanks; HTML loses its tags unless it is to be kept as it is."""
    joined = T.trimmed(F.regexp_replace(content.cast("string"), r"\r?\n", " "))
    if not strip_html or path is None:
        return joined
    return F.when(T.extension(path).isin("html", "htm"), T.xml_to_text(joined)).otherwise(joined)


# ------------------------------------------------------------------ office documents


def _xml_text(xml: str) -> str:
    text = unescape(re.sub(r"<[^>]+>", " ", xml), {"&quot;": '"', "&apos;": "'"})
    return re.sub(r"\s+", " ", text).strip()


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _xml_text(z.read("word/document.xml").decode("utf-8", "replace"))


def xlsx_text(data: bytes) -> str:
    """Cells of all sheets in order; shared strings stand in for their numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_xml_text(x) for x in re.findall(r"<si\b.*?</si>", z.read("xl/sharedStrings.xml").decode("utf-8", "replace"), re.S)]
        cells = []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            sheet = z.read(name).decode("utf-8", "replace")
            for head, body in re.findall(r"<c\b([^>]*)>(.*?)</c>", sheet, re.S):
                value = _xml_text("".join(re.findall(r"<(?:v|t)\b[^>]*>(.*?)</(?:v|t)>", body, re.S)))
                if re.search(r'\bt="s"', head) and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                cells.append(value)
        return " ".join(c for c in cells if c)


READERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "xlsx": xlsx_text}


def office_text(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, text, error of files with a reader for their extension; an unreadable file is a row with an error.

    ``readers`` may add providers (PDF text, OCR) that this library does not bring along.
    """
    known = READERS | (readers or {})

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text, error = [], []
            for path, data in zip(part["path"], part["content"], strict=True):
                try:
                    text.append(known[path.rpartition(".")[2].lower()](bytes(data)))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  a broken file must not end the job
                    text.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": part["path"], "text": text, "error": error})

    mine = files.where(T.extension(F.col("path")).isin(*known)).select("path", "content")
    return mine.mapInPandas(read, "path string, text string, error string")
