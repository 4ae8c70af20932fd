"""Mail pages as a stream that can stop and go on: bounded pages, continuation tokens, one account at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .mail import _body

#: Bounds and default of the messages of a page.
LEAST_PAGE, MOST_PAGE, PAGE = 1, 500, 100
FIRST = "1"
#: Bytes of a page in which its continuation token is looked for, and how a page begins that names it first.
HEAD = 4096
_NAMED = re.compile(r'\s*\{\s*"nextPageToken"\s*:\s*(null|"(?:[^"\\]|\\.)*")\s*[,}]')
#: Tasks of a batch of many pages.
TASKS = 64


class FolderTransport:
    """Pages of a folder, ``<root>/<account>/page=<token>/*``: ``{"messages": [...], "nextPageToken": ...}`` each.

    ``root`` is a path or an address that Arrow's file systems know (file, hdfs, s3, gs ...).
    """

    def __init__(self, root: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)

    def _file(self, account: str, token: str) -> str | None:
        folder = f"{self.root.rstrip('/')}/{account}/page={token}"
        found = self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return min((f.path for f in found if f.is_file and not f.base_name.startswith(("_", "."))), default=None)

    def following(self, account: str, token: str, size: int) -> str | None:
        """The token of the page after one: from the page's first bytes if it is named there, else from the whole page."""
        if name := self._file(account, token):
            with self.files.open_input_file(name) as f:
                begin = f.read(HEAD).decode("utf-8", "ignore")
            if named := _NAMED.match(begin):
                return json.loads(named[1])
        return self.page(account, token, size).get("nextPageToken")

    def page(self, account: str, token: str, size: int) -> dict:
        """A page of at most ``size`` messages; an unknown token is a page of nothing."""
        name = self._file(account, token)
        if name is None:
            return {"messages": [], "nextPageToken": None}
        with self.files.open_input_stream(name) as f:
            out = json.loads(f.read().decode("utf-8"))
        if len(out.get("messages", [])) > size:
            raise ValueError(f"page {token} has more than {size} messages")
        return out


class _Page(InputPartition):
    def __init__(self, tokens: list[str]) -> None:
        self.tokens = tokens

    @property
    def token(self) -> str:
        """The first page."""
        return self.tokens[0]


class PageStreamReader(DataSourceStreamReader):
    """Offsets are (account, token of the next page, pages so far); null is the end of the account's pages.

    A batch has at most ``pages_per_batch`` pages, one task each. Where pages lie waiting, each
    batch that came full is followed by one of up to twice as many pages, and ``backlog_pages``
    at most (default: ``pages_per_batch``), several a task: the number of batches does not grow
    with the backlog as its pages do. The driver follows the continuation tokens once for each
    batch, since a token is known only from the page before it; messages are read by tasks. The offset of the last batch that was planned is kept in the ``state`` folder: Spark
    plans a batch that had not ended once more by itself, and asks where to go on from there,
    without saying what it knows. Another account starts at its first page.
    """

    def __init__(self, options: dict, transport=None) -> None:
        self.account, self.size = options["account"], int(options.get("page_size", PAGE))
        if not LEAST_PAGE <= self.size <= MOST_PAGE:
            raise ValueError(f"a page has {LEAST_PAGE} to {MOST_PAGE} messages")
        self.most = self.room = int(options.get("pages_per_batch", "8"))
        self.backlog = max(self.most, int(options.get("backlog_pages", self.most)))
        self.root, self.state = options["path"], options.get("state")
        self.make = transport or FolderTransport
        self.reached: dict | None = None
        self.followed: tuple[dict, dict, list[str]] | None = None

    def initialOffset(self) -> dict:
        return {"account": self.account, "token": FIRST, "pages": 0}

    def _marks(self) -> tuple:
        where, path = fs.FileSystem.from_uri(self.state) if "://" in self.state or self.state.startswith("file:") else (fs.LocalFileSystem(), self.state)
        return where, f"{path.rstrip('/')}/reached.json"

    def _planned(self) -> dict | None:
        if not self.state:
            return None
        where, path = self._marks()
        if where.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with where.open_input_stream(path) as f:
            return json.loads(f.read().decode())

    def latestOffset(self) -> dict:
        """As many pages as a batch may have beyond the last batch that was planned, in this run or before."""
        at = self.reached or self._planned()
        if at is None or at["account"] != self.account:
            at = self.initialOffset()
        tokens, self.reached = self._ahead(at, self.room)
        self.followed = (at, self.reached, tokens)
        self.room = min(2 * self.room, self.backlog) if len(tokens) == self.room else self.most
        return self.reached

    def _ahead(self, at: dict, pages: int | None) -> tuple[list[str], dict]:
        """(tokens of the pages from ``at`` on, the offset after them)."""
        source, tokens, token = self.make(self.root), [], at["token"]
        while token is not None and (pages is None or len(tokens) < pages):
            tokens.append(token)
            token = source.following(self.account, token, self.size) if hasattr(source, "following") else source.page(self.account, token, self.size).get("nextPageToken")
        return tokens, {"account": self.account, "token": token, "pages": at["pages"] + len(tokens)}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        begin = start if start["account"] == end["account"] == self.account else self.initialOffset()
        self.reached = end
        self._mark(end)
        if self.followed and self.followed[:2] == (begin, end):
            tokens = self.followed[2]
        else:  # a batch of an earlier run
            tokens = self._ahead(begin, end["pages"] - begin["pages"])[0]
        n = -(-len(tokens) // max(self.most, TASKS))
        return [_Page(tokens[i : i + n]) for i in range(0, len(tokens), n or 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        source = self.make(self.root)
        for token in partition.tokens:
            for m in source.page(self.account, token, self.size).get("messages", []):
                payload = m.get("payload") or {}
                headers = {h["name"].lower(): h.get("value") for h in payload.get("headers", [])}
                yield self.account, token, m.get("id"), m.get("threadId"), headers.get("subject"), headers.get("from"), _body(payload), int(m.get("internalDate") or 0)

    def commit(self, end: dict) -> None:
        """Nothing to do: the stream's own checkpoint says what is done."""

    def _mark(self, end: dict) -> None:
        if self.state:
            where, path = self._marks()
            where.create_dir(path.rpartition("/")[0], recursive=True)
            with where.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(end).encode())
            where.move(f"{path}.new", path)


class MailPageStream(DataSource):
    """``spark.dataSource.register(MailPageStream)``; ``spark.readStream.format("mail_page_stream")`` with path, account, state, page_size, pages_per_batch, backlog_pages."""

    @classmethod
    def name(cls) -> str:
        return "mail_page_stream"

    def schema(self) -> str:
        return "account string, page string, message_id string, thread_id string, subject string, sender string, body string, ts long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStreamReader(self.options)
