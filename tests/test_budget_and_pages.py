"""Streams that stop and go on: mail pages, time budgets, capabilities."""

import json
import time

from wherry.sources.pages import MailPageStream, PageStreamReader
from wherry.streaming import budget as Y


def mailbox(root, account, sizes):
    n = 0
    for i, size in enumerate(sizes, 1):
        folder = root / account / f"page={i}"
        folder.mkdir(parents=True)
        messages = [{"id": f"{account}{n + j}", "threadId": "t", "internalDate": str(n + j), "payload": {"headers": [{"name": "Subject", "value": "s"}], "mimeType": "text/plain", "body": {"data": "aGk"}}} for j in range(size)]
        n += size
        (folder / "part.txt").write_text(json.dumps({"messages": messages, "nextPageToken": str(i + 1) if i < len(sizes) else None}))
    return n


def run(spark, options, sink, mark, batches):
    """Runs of one batch each, as when a run stops after its pages."""
    stream = spark.readStream.format("mail_page_stream").options(**options).load()
    for _ in range(batches):
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(sink).awaitTermination()
    return sorted(r["message_id"] for r in spark.read.parquet(sink).collect())


def test_pages_stop_and_go_on(spark, tmp_path):
    total = mailbox(tmp_path / "box", "ann", [3, 0, 2, 4, 1])
    spark.dataSource.register(MailPageStream)
    options = {"path": str(tmp_path / "box"), "account": "ann", "state": str(tmp_path / "state"), "page_size": "4", "pages_per_batch": "2"}
    sink, mark = str(tmp_path / "sink"), str(tmp_path / "mark")
    assert run(spark, options, sink, mark, 1) == ["ann0", "ann1", "ann2"]
    assert len(run(spark, options, sink, mark, 1)) == 9
    assert run(spark, options, sink, mark, 2) == sorted(f"ann{i}" for i in range(total))
    assert run(spark, options, sink, mark, 2) == sorted(f"ann{i}" for i in range(total))


def test_another_account_starts_at_its_first_page(spark, tmp_path):
    mailbox(tmp_path / "box", "ann", [2, 2, 2])
    mailbox(tmp_path / "box", "bob", [1, 1, 1])
    spark.dataSource.register(MailPageStream)
    options = {"path": str(tmp_path / "box"), "account": "ann", "state": str(tmp_path / "state"), "pages_per_batch": "2"}
    sink, mark = str(tmp_path / "sink"), str(tmp_path / "mark")
    run(spark, options, sink, mark, 1)
    got = run(spark, options | {"account": "bob"}, sink, mark, 3)
    assert got == ["ann0", "ann1", "ann2", "ann3", "bob0", "bob1", "bob2"]


def test_offsets_and_bounds(tmp_path):
    mailbox(tmp_path, "ann", [1, 1, 1])
    options = {"path": str(tmp_path), "account": "ann", "state": str(tmp_path / "state"), "pages_per_batch": "2"}
    r = PageStreamReader(options)
    two = r.latestOffset()
    assert two == {"account": "ann", "token": "3", "pages": 2}
    assert [p.token for p in r.partitions(r.initialOffset(), two)] == ["1", "2"]
    # a reader that starts anew goes on after the planned batch, also when Spark has not ended it
    again = PageStreamReader(options)
    end = again.latestOffset()
    assert end == {"account": "ann", "token": None, "pages": 3} and [p.token for p in again.partitions(two, end)] == ["3"]
    assert again.latestOffset() == end
    for size in ("0", "501"):
        try:
            PageStreamReader(options | {"page_size": size})
        except ValueError:
            continue
        raise AssertionError(size)


class Slow:
    """A tenth of its length, until the attempt that its digit names."""

    def __call__(self, text, attempt):
        if text == "boom":
            raise ValueError("no")
        return text.upper(), 5.0 if attempt >= int(text[-1]) else 50.0


def test_postponed_then_failed(spark, tmp_path):
    rows = [(1, "a0", 0), (2, "b1", 0), (3, "c2", 0), (4, "d3", 0), (5, "boom", 0), (6, None, 0)]
    queue = str(tmp_path / "queue")
    spark.createDataFrame(rows, "id long, text string, attempt int").repartition(3).write.parquet(f"{queue}/first")
    out = Y.drained(spark, queue, str(tmp_path / "out"), str(tmp_path / "mark"), "id long, text string, attempt int", lambda b: Y.attempted(b, Slow, "string"), 2)
    got = {r["id"]: (r["attempt"], r["status"], r["value"]) for r in out.collect()}
    assert got == {1: (0, "done", "A0"), 2: (1, "done", "B1"), 3: (2, "done", "C2"), 4: (2, "failed", None), 5: (0, "failed", None), 6: (0, "done", None)}


def test_timed_gives_up():
    work = Y.Timed(lambda t: time.sleep(float(t)) or t, 0.2)
    assert work("0", 0)[0] == "0" and work("1", 0) == (None, float("inf")) and work("0", 1)[0] == "0"


def test_capabilities(spark):
    needs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("d", "gone")], "capability string, needed string")
    present = spark.createDataFrame([(c,) for c in ("a", "b", "c", "x", "y", "d", "alone")], "capability string")
    got = {r["capability"]: r["state"] for r in Y.capabilities(needs, present).collect()}
    assert got == {"a": "FULL", "b": "FULL", "c": "FULL", "x": "FULL", "y": "FULL", "d": "BLOCKED", "gone": "BLOCKED", "alone": "FULL"}
    files = spark.createDataFrame([(1, "a", "PACKAGE_MISSING"), (2, "d", "PACKAGE_MISSING"), (3, "a", "DONE"), (4, None, "PACKAGE_MISSING")], "id long, capability string, state string")
    assert [r["id"] for r in Y.released(files, Y.capabilities(needs, present)).collect()] == [1]


def test_merging_rewrites_the_buckets_of_a_batch(spark, tmp_path):
    from wherry.operators.tableset import TableSet
    from wherry.streaming import feeds as X

    tables = TableSet(spark, str(tmp_path), buckets=8)
    apply = X.merging(tables, "t", "k", ["n"])
    rows = lambda *r: spark.createDataFrame(list(r), "k long, n long, v string")
    apply(rows(*[(i, 1, "a") for i in range(30)], (None, 1, "a")), 0)
    first = tables.manifest()["tables"]["t"]["files"]
    for _ in range(2):
        apply(rows((3, 2, "b"), (3, 3, "c"), (4, 0, "late"), (None, 2, "b"), (99, 1, "new")), 1)
    got = {(r["k"], r["n"], r["v"]) for r in tables.read("t").collect()}
    assert got == {(i, 1, "a") for i in range(30) if i != 3} | {(3, 3, "c"), (None, 2, "b"), (99, 1, "new")}
    assert any(f == first.get(b) for b, f in tables.manifest()["tables"]["t"]["files"].items())
