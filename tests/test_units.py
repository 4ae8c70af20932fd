"""Single functions and operators against values written by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from wherry.functions import scoring as S
from wherry.functions import text as T
from wherry.operators import fuse as U
from wherry.operators import graph as G
from wherry.operators import index as I
from wherry.operators import search as R
from wherry.operators import store as K
from wherry.sources import files, mail
from wherry.streaming import feeds


def value(spark, column, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def words(text):
    return F.array(*[F.lit(w) for w in text.split(" ")])


@pytest.mark.parametrize("text, norm", [("Été  à-la CARTE!", "ete a la carte"), ("", ""), (None, ""), ("ÄÖ ß ș", "ao ß s"), ("--", "")])
def test_normalized(spark, text, norm):
    assert value(spark, T.normalized(F.lit(text).cast("string"))) == norm


@pytest.mark.parametrize(
    "query, found", [("invoice", ["factura"]), ("FACTURA", ["invoice"]), ("  Invoice   APA ", ["factura apa"]), ("factura apa", ["invoice apa"]), ("invoices", []), ("prefactura", [])]
)
def test_alias(spark, query, found):
    assert value(spark, T.alias_expansions(F.lit(query))) == found


@pytest.mark.parametrize(
    "query, document, image",
    [("invoice", True, False), ("factura engie", True, False), ("pisica alba", False, True), ("white cat", False, True), ("daniela", True, True), ("house", True, True)],
)
def test_intent(spark, query, document, image):
    tokens = words(query)
    assert value(spark, T.document_intent(tokens)) is document
    assert value(spark, T.image_intent(tokens)) is image


def test_whole_tokens_and_acronyms(spark):
    assert value(spark, F.array_contains(words("red car parked"), "car"))
    assert not value(spark, F.array_contains(words("take care"), "car"))
    assert value(spark, S.acronym_at(words("contractul a ramas"), F.lit("car")))
    assert not value(spark, S.acronym_at(words("contractul ramas"), F.lit("car")))


def test_canonical_hash(spark):
    h = lambda x, **k: value(spark, T.canonical_hash(F.lit(x), **k))
    assert h("  Water   Bill  ") == h("water bill")
    assert h("water bill") != h("water bill", version="norm-v2")
    assert len(h("x")) == 32


def test_canonical_terms(spark):
    terms = value(spark, T.canonical_terms(T.canonical_tokens(F.lit("Water bill and gas bill"))))
    assert {"water", "water bill", "gas bill"} <= set(terms)
    assert terms.count("bill") == 1
    assert value(spark, T.canonical_terms(T.canonical_tokens(F.lit("")))) == []


@pytest.mark.parametrize(
    "path, label",
    [
        ("/storage/emulated/0/DCIM/Camera/dog.jpg", "DCIM"), ("/storage/emulated/0/Pictures/Screenshots/shot.png", "SCREENSHOTS"),
        ("/storage/emulated/0/WhatsApp/Media/x.jpg", "WHATSAPP"), ("/storage/emulated/0/Download/a.pdf", "DOWNLOADS"), ("/storage/emulated/0/My_Notes/12/x", "MY NOTES"),
    ],
)
def test_source_label(spark, path, label):
    assert value(spark, T.source_label(F.lit(path), F.lit("IMAGE"))) == label


@pytest.mark.parametrize(
    "path, text, skipped",
    [
        ("/build/a.html", "<div class='row'>x</div>\n" * 25_000, True), ("/a/note.txt", "a short note", False),
        ("/build/note.txt", "a short note", False), ("/build/b.txt", "plain words of prose here " * 25_000, False),
    ],
)
def test_policy(spark, path, text, skipped):
    rows = spark.createDataFrame([(path, text)], "path string, text string")
    s = T.policy_signals(F.col("path"), F.col("text"))
    flat = rows.select([c.alias(n) for n, c in s.items()])
    assert flat.select(T.policy_skips({n: F.col(n) for n in s})).first()[0] is skipped


def test_mail_ids(spark):
    assert value(spark, T.stable_mail_id(F.lit("Gmail"), F.lit("a@b"), F.lit("m?1"))) == "email://Z21haWw/YUBi/bT8x"
    assert value(spark, T.decimal_thread_id(F.lit("ff"))) == "255"
    assert value(spark, T.decimal_thread_id(F.lit("no"))) == "no"


def test_chunks_and_vocabulary(spark):
    docs = spark.createDataFrame([(1, "a" * 801), (2, None), (3, "  \n "), (4, "abcd"), (5, "hello world")], "doc_id long, text string")
    rows = [(r["doc_id"], r["chunk_index"], len(r["chunk_text"])) for r in I.chunks(docs).orderBy("doc_id", "chunk_index").collect()]
    assert rows == [(1, 0, 800), (5, 0, 11)]
    assert {r[0] for r in I.vocabulary(I.chunks(docs)).collect()} == {"a" * 800, "hello", "world"}


def test_bm25(spark):
    one = value(spark, S.bm25(words("red"), words("red car")))
    assert one == pytest.approx(2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 120)) + 3.5)
    assert value(spark, S.bm25(words("red sky"), words("red car"))) == pytest.approx(one - 3.5)


def test_proximity_and_windows(spark):
    far = "a1 " + "x " * 20 + "b1"
    assert value(spark, S.proximity(words("a1 b1"), words("a1 x b1"))) == 4.0
    assert value(spark, S.proximity(words("a1 b1"), words(far))) == 1.0
    assert value(spark, S.proximity(words("a1 a1"), words("a1 b1"))) == 0.0
    assert value(spark, S.in_window(words("a1 b1"), words("a1 x b1")))
    assert not value(spark, S.in_window(words("a1 b1"), words(far)))


@pytest.mark.parametrize(
    "scores, keep", [((0.3009, 0.1914, 0.1796, 0.1771, 0.1751), 1), ((0.2815, 0.2722, 0.2087, 0.2034, 0.1971), 2), ((0.2603, 0.2582, 0.2540, 0.2501, 0.2462), 5), ((0.2504, 0.2503, 0.2502, 0.2501, 0.2500), 5)]
)
def test_image_cutoff(spark, scores, keep):
    rows = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "query_id int, rank long, score double")
    assert R.image_cutoff(rows).count() == keep


def cutoff(spark, rows):
    df = spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], "query_id int, rank long, modality string, score double, tier string, confidence double, agreement double")
    out = U.adaptive_cutoff(df).collect()
    return sum(r["shown"] for r in out), out[0]["reason"]


def test_adaptive_cutoff(spark):
    image = lambda tier, s=1.0: ("IMAGE", s, tier, None, None)
    assert cutoff(spark, [image(t, 1 - i / 10) for i, t in enumerate(["BEST", "BEST", "PARTIAL", "PARTIAL", "RELATED"])]) == (2, "MATCH_TIER_BOUNDARY")
    assert cutoff(spark, [image("PARTIAL")] * 4) == (4, "ALL_RESULTS_MEANINGFUL")
    assert cutoff(spark, [("DOCUMENT", 1.0, None, None, None), ("DOCUMENT", 0.1, None, None, None)]) == (2, "ALL_RESULTS_MEANINGFUL")
    assert cutoff(spark, [("DOCUMENT", s, None, None, None) for s in (1.0, 0.99, 0.98, 0.2, 0.19)]) == (3, "DISTRIBUTION_ELBOW")


def test_mixed_rank(spark):
    rows = spark.createDataFrame([(1, "DOCUMENT", 1, 40.0), (1, "DOCUMENT", 2, 30.0), (1, "IMAGE", 1, 5.0), (1, "IMAGE", 2, 4.0)], "query_id int, modality string, id long, score double")
    got = [(r["modality"][0] + str(r["id"]), r["rel"]) for r in U.mixed_rank(rows).orderBy("rank").collect()]
    assert got == [("D1", 1.0), ("I1", 1.0), ("I2", 0.8), ("D2", 0.75)]


def test_agreement_breadth_first(spark):
    one = value(spark, S.agreement(F.lit(1), F.lit(2), F.lit(1.0)))
    two = value(spark, S.agreement(F.lit(2), F.lit(2), F.lit(0.02)))
    assert two > one


def test_confidence_is_tri_state(spark):
    null = F.lit(None).cast("double")
    assert value(spark, S.confidence(null, null, null, null, null, F.lit(True))) is None
    assert value(spark, S.confidence(F.lit(0.25), null, F.lit(1.0), null, null, F.lit(False))) == pytest.approx(0.5)
    assert value(spark, S.margin_signal(F.lit(1), F.lit(2.0), F.lit(1.0), F.lit(1.0))) is None
    assert value(spark, S.margin_signal(F.lit(2), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0.0


def test_interpretations(spark):
    q = spark.createDataFrame([(1, "poza cu pisica alba langa flori"), (2, "one"), (3, "")], "query_id int, query string")
    rows = G.interpretations(q).orderBy("query_id", "ord").collect()
    kinds = [r["kind"] for r in rows if r["query_id"] == 1]
    assert kinds[0] == "WHOLE_QUERY" and kinds[-1] == "ATOMIC_CONJUNCTION" and kinds.count("PHRASE_GROUP") >= 1 and len(kinds) <= 8
    assert [r["kind"] for r in rows if r["query_id"] == 2] == ["WHOLE_QUERY", "ATOMIC_CONJUNCTION"]


def test_expansion_limits_and_cycles(spark):
    rel = spark.createDataFrame([("a", "b", "CHILD"), ("b", "a", "CHILD"), ("b", "c", "RELATED"), ("c", "d", "CHILD")], "src string, dst string, kind string")
    start = spark.createDataFrame([("a",)], "node string")
    assert [r["node"] for r in G.expand(start, rel, depth=3).orderBy("ord").collect()] == ["b", "c", "d"]
    assert [r["node"] for r in G.expand(start, rel, depth=3, limit=1).collect()] == ["b"]
    assert [r["node"] for r in G.expand(start, rel, depth=3, kinds=("CHILD",)).collect()] == ["b"]


def test_change_sets(spark):
    ch = spark.createDataFrame([("1", "added"), ("1", "deleted"), ("2", "modified"), ("3", "added"), ("3", "added")], "id string, kind string")
    assert {tuple(r) for r in K.change_sets(ch).collect()} == {("1", "delete"), ("2", "upsert"), ("3", "upsert")}


def test_stale_generations(spark):
    f = spark.createDataFrame([(1, 2, "PENDING"), (2, 1, "PENDING")], "doc_id int, generation int, state string")
    commits = spark.createDataFrame([(1, 1), (2, 1)], "doc_id int, generation int")
    assert {(r["doc_id"], r["state"]) for r in K.published(f, commits).collect()} == {(1, "PENDING"), (2, "PUBLISHED")}


@pytest.mark.parametrize("done, mark, expired, mode", [(True, "9", False, "incremental"), (True, None, False, "full"), (False, "9", False, "full"), (True, "9", True, "full")])
def test_sync_mode(done, mark, expired, mode):
    assert feeds.sync_mode(done, mark, expired) == mode


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_text(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(zipped({"word/document.xml": "<w:p><w:t>Fish &amp; chips</w:t></w:p>"}))
    sheet = '<c r="A1" t="s"><v>0</v></c><c r="B1"><v>42</v></c>'
    (tmp_path / "b.xlsx").write_bytes(zipped({"xl/sharedStrings.xml": "<sst><si><t>Name</t></si></sst>", "xl/worksheets/sheet1.xml": sheet}))
    (tmp_path / "c.docx").write_bytes(b"broken")
    rows = {r["path"].rpartition("/")[2]: r for r in files.office_text(files.listing(spark, str(tmp_path), content=True)).collect()}
    assert rows["a.docx"]["text"] == "Fish & chips"
    assert rows["b.xlsx"]["text"] == "Name 42"
    assert rows["c.docx"]["error"].startswith("BadZipFile")


def test_mime(spark, tmp_path):
    (tmp_path / "plain.eml").write_bytes(b"From: A <a@x>\r\nTo: b@x, C <c@x>\r\nSubject: =?utf-8?B?w4l0w6k=?=\r\n\r\nhello\r\n")
    (tmp_path / "html.eml").write_bytes(b"Subject: h\r\nContent-Type: text/html\r\n\r\n<p>one</p><script>x</script><p>two</p>")
    mixed = b"Subject: m\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nbody\r\n--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD\r\n--b--\r\n"
    (tmp_path / "mixed.eml").write_bytes(mixed)
    rows = {r["path"].rpartition("/")[2]: r for r in mail.messages(files.listing(spark, str(tmp_path), content=True)).collect()}
    assert rows["plain.eml"]["subject"] == "Été" and rows["plain.eml"]["body"] == "hello" and rows["plain.eml"]["recipients"] == ["b@x", "C <c@x>"]
    assert rows["html.eml"]["body"] == "one\ntwo"
    assert rows["mixed.eml"]["body"] == "body" and [(a["name"], a["size"]) for a in rows["mixed.eml"]["attachments"]] == [("a.pdf", 3)]


def test_mail_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"messages": [{"id": "1", "threadId": "t", "internalDate": "5", "payload": {"headers": [{"name": "Subject", "value": "S"}], "parts": [{"mimeType": "text/plain", "body": {"data": "aGk"}}]}}]}')
    spark.dataSource.register(mail.MailPages)
    assert spark.read.format("mail_pages").load(str(tmp_path)).first().asDict() == {"message_id": "1", "thread_id": "t", "subject": "S", "sender": None, "body": "hi", "ts": 5}


def test_import_without_training_data_package():
    """Nothing outside wherry.llm imports it."""
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "wherry"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_posting_blocks_round_trip_and_refuse_damage():
    from wherry.operators import codec

    rows = [("b/é.txt", 3, 1, 0), ("a", 0, 300, 7), ("a", 200, 2, 255), ("b/é.txt", 2**31 - 1, 2**31 - 1, 1)]
    block = codec.encoded(rows)
    assert codec.decoded(block) == sorted(rows) and codec.decoded(codec.encoded([])) == []
    assert block[:4] == bytes([2, 4, 1, 1])
    with pytest.raises(ValueError):
        codec.encoded([("a", 1, 1, 0), ("a", 1, 2, 0)])
    bad = [block[:n] for n in range(len(block))] + [block + b"\0", b"\x01" + block[1:], bytes([2, 1, 0, 1, 1, 0]), bytes([2, 1, 1, 0, 0, 1, 0]), bytes([2, 1, 1, 1, 97, 0, 0, 0])]
    for data in bad:
        with pytest.raises(ValueError):
            codec.decoded(data)


def test_posting_blocks_are_bounded(spark):
    from wherry.operators import codec

    rows = spark.range(200).select(F.when(F.col("id") < 150, "hot").otherwise("cold").alias("hash"), F.concat(F.lit("p"), "id").alias("path"), F.lit(0).alias("chunk_index"), F.lit(1).alias("tf"), F.lit(0).alias("flags"))
    blocks = codec.posting_blocks(rows, rows=25)
    assert {r["hash"]: r["n"] for r in blocks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).collect()} == {"hot": 6, "cold": 2}
    assert sorted(codec.postings_of(blocks).collect()) == sorted(rows.collect())


def test_vector_codec(spark):
    from wherry.operators import codec

    rows = spark.createDataFrame([(1, [1.5, -2.0]), (2, None), (3, [])], "id int, v array<float>")
    out = {r["id"]: r for r in rows.select("id", codec.vector_bytes(F.col("v")).alias("d")).select("id", "d", codec.vector_of(F.col("d")).alias("v")).collect()}
    assert bytes(out[1]["d"]) == b"\x00\x00\xc0\x3f\x00\x00\x00\xc0" and out[1]["v"] == [1.5, -2.0]
    assert out[2]["d"] is None and out[2]["v"] == [] and out[3]["v"] == []


def test_provider_failures_are_rows(spark):
    from wherry.operators import providers

    class Picky:
        def __call__(self, texts):
            if "bad" in texts:
                raise ValueError("refused")
            return [len(t) for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None), (4, "")], "id int, text string").coalesce(1)
    out = {r["id"]: (r["value"], r["error"]) for r in providers.provided(rows, Picky, "long").collect()}
    assert out == {1: (3, None), 2: (None, "ValueError: refused"), 3: (None, None), 4: (0, None)}


def test_routes_and_own_screenshots(spark):
    tags = {"ro": "romance", "pt": "romance", "ca": "unsupported", "is": "germanic", "sl": "slavic", "tr": "turkish", "el": "greek", "EN ": "identity", "": "und", "xx": "unsupported"}
    for tag, family in tags.items():
        assert value(spark, I.language_route(F.lit(tag))) == family
    for text, own in (("AI Search RESULTS", True), ("12 memories found", True), ("search results", False), (None, False)):
        assert value(spark, files.own_screenshot(F.lit(text).cast("string"))) is own


def test_person_names_equal_brute_force(spark, data):
    import re

    from wherry.plans import catalog

    pattern = re.compile(r"\b[A-ZĂÂÎȘȚ][a-zăâîșț]+\s+[A-ZĂÂÎȘȚ][a-zăâîșț]+\b", re.A)
    turns = spark.read.parquet(f"{data}/conversations.parquet").collect()
    # Java's \b and \s as Spark uses them: letters of any script are word characters, blanks are ASCII
    plain = re.compile(r"(?<!\w)[A-ZĂÂÎȘȚ][a-zăâîșț]+[ \t\n\x0B\f\r]+[A-ZĂÂÎȘȚ][a-zăâîșț]+(?!\w)")
    got = {(r["conv_id"], r["turn"]): r["names"] for r in catalog.queries()["person_names"](spark, data).collect()}
    assert len(got) == len(turns)
    for r in turns:
        text = r["text"] or ""
        if text.isascii():
            assert got[r["conv_id"], r["turn"]] == ", ".join(dict.fromkeys(pattern.findall(text)))
        else:
            assert got[r["conv_id"], r["turn"]] == ", ".join(dict.fromkeys(plain.findall(text)))


def test_old_versions_go(spark, tmp_path):
    t = feeds.VersionedTable(spark, str(tmp_path / "t"), "id long")
    for v in range(4):
        t.write(spark.range(v + 1), v)
    assert t.versions() == [2, 3] and t.read().count() == 4


def test_settled_columns_are_computed_once(spark):
    from wherry.functions.barrier import settled

    rows = settled(spark.range(3), x=F.sqrt(F.col("id") + 1)).where("x > 1").withColumn("y", F.col("x") * F.col("x"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1
    assert sorted(round(r["y"], 6) for r in rows.collect()) == [2.0, 3.0]


# ------------------------------------------------------------------ WordPiece and binary assets


def test_wordpiece_takes_the_longest_piece(spark):
    from wherry.operators import wordpiece as W

    vocab = {"un": 200, "##able": 201, "##a": 202, "##b": 203, "##ble": 204, "cat": 205, "c": 206, "##at": 207, "cats": 208, "x": 209}

    def cut(word):
        if len(word) > W.MAX_WORD:
            return [W.UNKNOWN]
        at, ids = 0, []
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
            if end is None:
                return [W.UNKNOWN]
            ids.append(vocab[("##" if at else "") + word[at:end]])
            at = end
        return ids

    words = ["unable", "cat", "cats", "catsa", "caat", "unab", "unabx", "z", "x" * 101, "cat"]
    pieces = spark.createDataFrame(list(vocab.items()), "piece string, id int")
    got = {r["word"]: r["ids"] for r in W.segmented(spark.createDataFrame([(w,) for w in [*words, "", None]], "word string"), pieces).collect()}
    assert got == {w: cut(w) for w in words}
    docs = spark.createDataFrame([(1, "  Cát, UNABLE! "), (2, None), (3, ""), (4, "cats z " * 300)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in W.encoded(docs, pieces).collect()}
    assert out[1]["input_ids"][:6] == [101, 205, 200, 201, 102, 0] and out[1]["n_ids"] == 5
    assert out[2]["input_ids"] == out[3]["input_ids"] == [101, 102] + [0] * 126
    assert out[4]["input_ids"] == [101] + [208, 100] * 63 + [102] and all(len(r["input_ids"]) == 128 for r in out.values())
    assert W.encoded(docs, pieces.limit(0)).where("doc_id = 1").first()["input_ids"][:4] == [101, 100, 100, 102]


def test_concept_assets(spark, tmp_path):
    import struct

    from wherry.sources import concepts as C

    def record(name, english, kind, values):
        texts = b"".join(struct.pack("<H", len(t.encode())) + t.encode() for t in (name, english))
        return texts + bytes([kind]) + struct.pack("<i", len(values)) + struct.pack(f"<{len(values)}f", *values)

    good = struct.pack("<ii", 2, 2) + record("a", "ä", 0, [1.0, -0.5]) + record("b", "", 4, [])
    files = {"good": good, "short": good[:-3], "long": good + b"x", "type": struct.pack("<ii", 2, 1) + record("a", "b", 5, []), "huge": struct.pack("<ii", 2, 1) + b"\0\0\0\0\0" + struct.pack("<i", -1)}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    got = {}
    for r in C.read_concepts(spark, str(tmp_path)).orderBy("place").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["place"], r["concept_id"], r["english"], r["type"], r["embedding"], r["error"]))
    first, second = (0, "a", "ä", "OBJECT", [1.0, -0.5], None), (1, "b", "", "PERSON", [], None)
    assert got["good"] == [first, second]
    assert got["short"] == [first, (1, None, None, None, None, "record 1 is cut off")]
    assert got["long"] == [first, second, (2, None, None, None, None, "1 bytes after the last record")]
    assert got["type"] == [(0, None, None, None, None, "record 0 has type 5")]
    blank = C.concepts(spark.createDataFrame([("a", b""), ("b", None)], "path string, content binary")).collect()
    assert [(r["path"], r["error"]) for r in blank] == [("a", "record 0 is cut off"), ("b", "record 0 is cut off")]
    assert got["huge"][0][-1] == "record 0 has -1 components"
