"""Mail as DataFrames: MIME messages, and replay of message and change pages as a data source."""

from __future__ import annotations

import base64
import email
import email.policy
import json
import os
from collections.abc import Iterator
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T

ATTACHMENT = "struct<name:string,mime:string,cid:string,disposition:string,size:bigint>"
MESSAGE = f"message_id string, subject string, sender string, recipients array<string>, cc array<string>, body string, html string, attachments array<{ATTACHMENT}>, error string"


def parsed(data: bytes) -> dict:
    """A MIME message: decoded headers, plain body (or else HTML), attachments' descriptions."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    every = lambda name: [f"{n} <{a}>" if n else a for n, a in getaddresses([str(x) for x in m.get_all(name, [])])]
    plain, html, attached = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        kind, how = part.get_content_type(), (part.get_content_disposition() or "").lower()
        if how == "attachment" or part.get_filename() or kind not in ("text/plain", "text/html"):
            payload = part.get_payload(decode=True) or b""
            cid = (part["Content-ID"] or "").strip("<> ") or None
            attached.append({"name": part.get_filename(), "mime": kind, "cid": cid, "disposition": how or None, "size": len(payload)})
            continue
        raw = part.get_payload(decode=True) or b""
        try:
            content = raw.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            content = raw.decode("utf-8", "replace")
        (html if kind == "text/html" else plain).append(content)
    text = lambda name: str(m[name]) if m[name] is not None else None
    return {
        "message_id": (text("Message-ID") or "").strip("<> ") or None, "subject": text("Subject"), "sender": ", ".join(every("From")) or None,
        "recipients": every("To"), "cc": every("Cc"), "body": "\n".join(plain).strip() or None, "html": "\n".join(html) or None, "attachments": attached, "error": None,
    }


def messages(files: DataFrame) -> DataFrame:
    """One row per file of ``files`` (path, content); the body is the plain text, or else the HTML's."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, data in zip(part["path"], part["content"], strict=True):
                try:
                    out.append({"path": path} | parsed(bytes(data)))
                except Exception as e:  # noqa: BLE001  a broken message must not end the job
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            columns = ["path", *(x.split(" ")[0] for x in MESSAGE.split(", "))]
            yield pd.DataFrame(out, columns=columns)

    rows = files.select("path", "content").mapInPandas(read, f"path string, {MESSAGE}")
    return rows.withColumn("body", F.coalesce("body", T.mail_html_to_text(F.col("html"))))


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _PageReader(DataSourceReader):
    """Pages are files of a folder, ``{"messages": [...]}`` each, read a page per task."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[_Page]:
        return [_Page(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith(".json")]

    def read(self, page: _Page) -> Iterator[tuple]:
        with open(page.path, encoding="utf-8") as f:
            found = json.load(f)
        for m in found.get("messages", []):
            payload = m.get("payload", {})
            headers = {h["name"].lower(): h["value"] for h in payload.get("headers", [])}
            yield m.get("id"), m.get("threadId"), headers.get("subject"), headers.get("from"), _body(payload), int(m.get("internalDate") or 0)


def _body(part: dict) -> str:
    """Text of the first plain part, in depth-first order, else of the first part with data."""
    found: list[tuple[bool, str]] = []

    def walk(p: dict) -> None:
        data = p.get("body", {}).get("data")
        if data:
            found.append((p.get("mimeType") == "text/plain", base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")))
        for x in p.get("parts", []):
            walk(x)

    walk(part)
    return next((t for plain, t in found if plain), found[0][1] if found else "")


class MailPages(DataSource):
    """``spark.dataSource.register(MailPages)``; ``spark.read.format("mail_pages").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "mail_pages"

    def schema(self) -> str:
        return "message_id string, thread_id string, subject string, sender string, body string, ts long"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


def change_rows(pages: DataFrame) -> DataFrame:
    """(id, kind) of change pages with arrays added, modified and deleted."""
    made = F.concat(*[F.transform(F.coalesce(F.col(k), F.array().cast("array<string>")), _change(k)) for k in ("added", "modified", "deleted")])
    return pages.select(F.explode(made).alias("c")).select("c.id", "c.kind")


def _change(kind: str):
    return lambda x: F.struct(x.alias("id"), F.lit(kind).alias("kind"))
