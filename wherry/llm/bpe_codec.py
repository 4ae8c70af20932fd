"""BPE encoding by chunks: texts are cut where their content says, each chunk is encoded once, joins are repaired."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mixed, small_batches, texts_of

#: The tokenizer's file is a parameter and never copied into the repository; this is its name in the package of public tokenizers.
TOKENIZER = "word_bpe_49k.json"
#: Chunks end where the hash of the last WINDOW code points has CUT_BITS zero bits, between LEAST and MOST code points.
WINDOW, CUT_BITS, LEAST, MOST = 24, 9, 128, 4096
#: Bytes of chunks and ids that a worker remembers, twice: those used lately and those before. As much again for words.
MEMO_BYTES = 32 << 20
#: What a remembered word costs besides its characters and ids.
WORD_COST = 200
#: Code points of texts that are cut and encoded together.
GROUP = 1 << 20
THREADS = 2

_U = np.uint64
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)
#: White space before which every tokenizer that parts words at white space may be cut; others are not relied on.
_GAP = re.compile(r"[ \n\t\r]+")
_BARE = re.compile(r"[^ \n\t\r]+")
_WORD = re.compile(r"[ \n\t\r]*[^ \n\t\r]+")
_PROBES = ("a b", "A1's  \n\tb-c don't 12,5 é e\u0301 x\u00a0y z", " lead, trail.\nEND of 2 lines", "<|x|> ... !? 中文 字 \u0301 mark")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.full(size, x, dtype=np.uint64)) for x in (_M, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def cuts(text: str) -> list[int]:
    """Where the chunks of a text end: a rolling hash decides, so equal passages are cut alike wherever they stand."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out, base, piece = [], 0, 1 << 20
    marks = []
    while base < n:
        # (pieces overlap by a window, so that the hash is the same as if there were none)
        a = max(0, base - WINDOW)
        c = codes[a : base + piece]
        up, down = _powers(len(c))
        s = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(c + _U(1)) * down)])
        h = (s[WINDOW:] - s[:-WINDOW]) * up[WINDOW - 1 :]
        at = np.nonzero((mixed(h) >> _U(64 - CUT_BITS)) == 0)[0] + WINDOW + a
        marks.append(at[at > base])
        base += piece
    begin = 0
    for m in np.concatenate(marks).tolist():
        while m - begin > MOST:
            begin += MOST
            out.append(begin)
        if m - begin >= LEAST:
            out.append(m)
            begin = m
    while n - begin > MOST:
        begin += MOST
        out.append(begin)
    if begin < n:
        out.append(n)
    return out


class Chunk:
    """A chunk's text before its first gap, the body from there to its last gap with its ids, and what comes after.

    Without two gaps there is no body, and all of the chunk is head.
    """

    __slots__ = ("body", "head", "ids", "tail")

    def __init__(self, text: str) -> None:
        self.ids: np.ndarray | None = None
        first = _GAP.search(text)
        a = first.start() if first else 0
        b = max(text.rfind(g) for g in " \n\t\r")
        while b > a and text[b - 1] in " \n\t\r":
            b -= 1
        if b > a:
            self.head, self.body, self.tail = text[:a], text[a:b], text[b:]
        else:
            self.head, self.body, self.tail = text, "", ""

    def size(self) -> int:
        return 400 + 2 * (len(self.head) + len(self.body) + len(self.tail)) + (0 if self.ids is None else self.ids.nbytes)


class Codec:
    def __init__(self, data: str, threads: int = THREADS, memo_bytes: int = MEMO_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_str(data)
        self.made.no_truncation()
        self.made.no_padding()
        self.names: dict[int, str] = {i: t for t, i in self.made.get_vocab(with_added_tokens=True).items()}
        #: Without a decoder the library joins the tokens by spaces; else whole texts are decoded by it.
        self.plain = self.made.decoder is None
        self.memo: dict[str, Chunk] = {}
        self.older: dict[str, Chunk] = {}
        self.held, self.memo_bytes = 0, memo_bytes
        self.words: dict[str, bytes] = {}
        self.word_bytes = 0
        special = [(t.content, i) for i, t in sorted(self.made.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.parting = special[0] if special else None
        #: What a word is, if a text is the sum of its words: without the white space before it, else with it.
        self.word = next((w for w in (_BARE, _WORD) if all(sum(self._ids(w.findall(t)), []) == self._ids([t])[0] for t in _PROBES)), None)
        self.encoded = self.reused = self.repairs = self.widened = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.made.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _apart(self, words: list[str]) -> list[bytes]:
        """Ids of each word alone. Many go into one text, parted by a special token, which nothing is joined across."""
        if self.parting is None:
            return [array("I", x).tobytes() for x in self._ids(words)]
        text, mark = self.parting
        groups = [words[i : i + 512] for i in range(0, len(words), 512)]
        out = []
        for ws, ids in zip(groups, self._ids([text.join(g) for g in groups]), strict=True):
            ids = np.array(ids, dtype=np.uint32)
            ends = np.append(np.nonzero(ids == mark)[0], len(ids)).tolist()
            if len(ends) == len(ws):
                raw, at = ids.tobytes(), 0
                for e in ends:
                    out.append(raw[4 * at : 4 * e])
                    at = e + 1
            else:  # a word holds the token's own spelling
                out += [array("I", x).tobytes() for x in self._ids(ws)]
        return out

    def _bodies(self, bodies: list[str]) -> list[np.ndarray]:
        """Ids of bodies: where a text is the sum of its words, each word is looked up, and encoded where it is new."""
        if self.word is None:
            return [np.array(x, dtype=np.uint32) for x in self._ids(bodies)]
        cut = [self.word.findall(b) for b in bodies]
        known = self.words
        new = list({w for ws in cut for w in ws} - known.keys())
        if new:
            learnt = dict(zip(new, self._apart(new), strict=True))
            size = sum(len(w) + len(x) for w, x in learnt.items()) + WORD_COST * len(new)
            if self.word_bytes + size > self.memo_bytes:
                # those that this group uses stay
                known = self.words = {w: known[w] for ws in cut for w in ws if w in known}
                self.word_bytes = sum(len(w) + len(x) for w, x in known.items()) + WORD_COST * len(known)
            if size <= self.memo_bytes:
                known |= learnt
                self.word_bytes += size
            else:
                known = known | learnt
        return [np.frombuffer(b"".join([known[w] for w in ws]), dtype=np.uint32) for ws in cut]

    def _learn(self, texts: list[str]) -> dict[str, Chunk]:
        """The chunks of these texts; those not known are encoded now, each once."""
        found: dict[str, Chunk] = {}
        fresh = []
        for t in texts:
            if t in found:
                self.reused += 1
            elif (c := self.memo.get(t) or self.older.get(t)) is not None:
                found[t] = c
                self.reused += 1
            else:
                found[t] = Chunk(t)
                fresh.append(found[t])
        bodies = [c for c in fresh if c.body]
        for c, ids in zip(bodies, self._bodies([c.body for c in bodies]), strict=True):
            c.ids = ids
        self.encoded += len(fresh)
        for t, c in found.items():
            if t not in self.memo:
                if self.held > self.memo_bytes:
                    self.memo, self.older, self.held = {}, self.memo, 0
                self.memo[t] = c
                self.held += c.size() + 2 * len(t)
        return found

    def _joined(self, spans: list[tuple[Chunk | None, str, Chunk | None]]) -> list[list[int]]:
        """Ids of the texts between two bodies.

        Each is encoded with words of the bodies around it, as they are in the text. If the ids
        begin and end as the bodies' own ids do there, the join is repaired; else twice as many
        words are taken, until the bodies are whole and nothing is left to disagree with: then
        the ids stand for the bodies too.
        """
        out: list[list[int] | None] = [None] * len(spans)
        todo, words = list(range(len(spans))), 1
        while todo:
            asked = []
            for i in todo:
                before, text, after = spans[i]
                a, b = _last_words(before, words), _first_words(after, words)
                asked.append((a, b, a + text + b))
            sides = self._bodies([x for q in asked for x in q[:2]])
            again = []
            for k, (i, whole) in enumerate(zip(todo, self._ids([q[2] for q in asked]), strict=True)):
                before, _, after = spans[i]
                a, b = sides[2 * k].tolist(), sides[2 * k + 1].tolist()
                n = len(whole) - len(b)
                agrees = n >= len(a) and whole[: len(a)] == a and whole[n:] == b
                agrees &= not a or before.ids[len(before.ids) - len(a) :].tolist() == a
                agrees &= not b or after.ids[: len(b)].tolist() == b
                if agrees:
                    out[i] = whole[len(a) : n]
                elif asked[k][0] == (before.body if before else "") and asked[k][1] == (after.body if after else ""):
                    out[i] = None  # even whole bodies do not agree
                else:
                    again.append(i)
            self.widened += len(again)
            todo, words = again, words * 2
        self.repairs += len(spans)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
        """(ids, their text) of whole texts, as the library gives them."""
        pieces = []
        for text in texts:
            begin, own = 0, []
            for end in cuts(text or ""):
                own.append(text[begin:end])
                begin = end
            pieces.append(own)
        known = self._learn([p for own in pieces for p in own])
        plan, spans = [], []
        for own in pieces:
            # bodies, and the texts between them: a tail and the next head, over chunks without a gap
            parts, between, before = [], "", None
            for p in own:
                c = known[p]
                between += c.head
                if c.body:
                    parts += [len(spans), c]
                    spans.append((before, between, c))
                    before, between = c, c.tail
            if between or own:
                parts.append(len(spans))
                spans.append((before, between, None))
            plan.append(parts)
        joined = self._joined(spans)
        out = []
        for text, parts in zip(texts, plan, strict=True):
            if any(isinstance(p, int) and joined[p] is None for p in parts):
                ids = np.array(self._ids([text])[0], dtype=np.uint32)
                out.append((ids, self.decode(ids)))
                continue
            ids = [p.ids if isinstance(p, Chunk) else np.array(joined[p], dtype=np.uint32) for p in parts]
            ids = np.concatenate(ids) if ids else np.empty(0, dtype=np.uint32)
            out.append((ids, self.decode(ids)))
        return out

    def decode(self, ids) -> str:
        """The library's decoding, special tokens too."""
        if self.plain:
            return " ".join(map(self.names.__getitem__, np.asarray(ids).tolist()))
        return self.made.decode(np.asarray(ids).tolist(), skip_special_tokens=False)


def _last_words(c: Chunk | None, n: int) -> str:
    if c is None:
        return ""
    at = len(c.body)
    for _ in range(n):
        back = at
        while back > 0 and c.body[back - 1] not in " \n\t\r":
            back -= 1
        while back > 0 and c.body[back - 1] in " \n\t\r":
            back -= 1
        at = back
        if at == 0:
            break
    return c.body[at:]


def _first_words(c: Chunk | None, n: int) -> str:
    if c is None:
        return ""
    at = 0
    for _ in range(n):
        m = _WORD.match(c.body, at)
        if not m:
            return c.body
        at = m.end()
    return c.body[:at]


_CODECS: dict[tuple, Codec] = {}


def codec_of(data: str, threads: int = THREADS) -> Codec:
    """The worker's codec, with the chunks of earlier tasks."""
    key = (xxhash.xxh3_64_intdigest(data.encode()), threads)
    if key not in _CODECS:
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


def _grouped(texts: list[str | None]) -> Iterator[list[str | None]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t or "") > GROUP:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or "")
    if some:
        yield some


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), decoded.

    Ids are those of the tokenizers library for the whole text, without special tokens added,
    truncation or padding; a special token's own spelling in a text is that token. ``decoded`` is
    the library's decoding of the ids. Null and empty texts have no ids and decode to an empty
    text; repeated rows and null ids get a row each; other columns are ignored; an empty table
    gives an empty result. The driver reads the tokenizer's file and sends it to the tasks.
    """
    small_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_text(encoding="utf-8"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value, threads)
        for batch in batches:
            for at, texts in texts_of(batch, "text", 128):
                for some in _grouped(texts):
                    ids, said = zip(*codec.encode(some), strict=True)
                    own = batch.column(0).slice(at, len(some))
                    at += len(some)
                    yield pa.RecordBatch.from_arrays([own, pa.array(map(len, ids), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(said, pa.string())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of ids as ``encode`` gives them; null ids give an empty text."""
    data = rows.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                text = pa.array([codec.decode(np.frombuffer(x or b"", dtype="<u4")) for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), text], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
