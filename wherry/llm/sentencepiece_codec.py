"""SentencePiece models on the tokenizers library: encoding, decoding and parity."""

from __future__ import annotations

import gc
import os
import re
import struct
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, texts_of

#: The model; a parameter, never copied into the repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Threads with which a worker encodes a batch.
THREADS = 2
#: Distinct parts of texts that a worker keeps encoded, twice: those used lately and those before.
MEMO_PARTS = 200_000

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


# ------------------------------------------------------------------ the model file


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def protobuf_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; lengths give bytes, fixed fields their bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n = 8 if kind == 1 else 4
            if kind == 2:
                n, at = _varint(data, at)
            elif kind not in (1, 5):
                raise ValueError(f"wire type {kind}")
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Model:
    """What encoding needs of a ModelProto."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk_surface = UNIGRAM, False, " ⁇ "
        self.charsmap, self.dummy_prefix, self.trim_spaces, self.escape = b"", True, True, True
        for number, value in protobuf_fields(data):
            if number == 1:
                f = dict(protobuf_fields(value))
                score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
                self.pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(protobuf_fields(value))
                self.kind = f.get(3, UNIGRAM)
                self.byte_fallback = bool(f.get(35, 0))
                self.unk_surface = f[44].decode() if 44 in f else self.unk_surface
                if f.get(24, 0):
                    raise ValueError("models that mark spaces after words are not supported")
            elif number == 3:
                f = dict(protobuf_fields(value))
                self.charsmap = f.get(2, b"")
                self.dummy_prefix, self.trim_spaces, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        self.unk = next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        #: No piece goes on after a space mark that follows another character, so a text may be
        #: cut before each run of space marks without changing its best segmentation.
        self.separable = not any(SPACE in p.lstrip(SPACE) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED, UNUSED))


def tokenizer(model: Model):
    """The tokenizers-library equivalent, for normalised and escaped parts of a text."""
    from tokenizers import AddedToken, Tokenizer, models

    if model.kind == UNIGRAM:
        low = min((s for _, s, t in model.pieces if t == NORMAL), default=0.0)
        vocab = [(p, s if t == NORMAL else (0.0 if t == USER_DEFINED else low - 1000.0)) for p, s, t in model.pieces]
        made = Tokenizer(models.Unigram(vocab, model.unk, model.byte_fallback))
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p: (s, i) for i, (p, s, t) in enumerate(model.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
        merges = []
        for p, (s, i) in usable.items():
            for k in range(1, len(p)):
                if p[:k] in usable and p[k:] in usable:
                    merges.append((-s, i, usable[p[:k]][1], (p[:k], p[k:])))
        # SentencePiece merges the best-scored piece first
        merges = [m for *_, m in sorted(merges)]
        made = Tokenizer(models.BPE(vocab, merges, unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0))
    own = [p for p, _, t in model.pieces if t == USER_DEFINED]
    if own:
        made.add_tokens([AddedToken(p, normalized=False) for p in own])
    return made


class Codec:
    """Encodes and decodes texts; each distinct part is encoded, decoded and compared once."""

    def __init__(self, data: bytes, threads: int = THREADS, parity: bool = True, memo_parts: int = MEMO_PARTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import normalizers

        self.model = Model(data)
        self.made = tokenizer(self.model)
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.part = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if self.model.separable else "(?s:.+)")
        m = self.model
        #: Whether a part can be given to the library as a text of its own: it adds the space mark again, and changes nothing else.
        self.by_part = m.dummy_prefix and m.escape and m.separable and not m.trim_spaces and not m.charsmap
        #: Pieces that stand for themselves; None for bytes, unknown and control pieces.
        self.plain = [p if t in (NORMAL, USER_DEFINED, UNUSED) else None for p, _, t in m.pieces]
        self.bytes_of = {i: int(p[3:-1], 16) for i, (p, _, t) in enumerate(self.model.pieces) if t == BYTE}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.wrong: set[str] = set()  # parts without parity; none for a supported model
        self.memo_parts = memo_parts
        self.check = None
        if parity:
            import sentencepiece

            self.check = sentencepiece.SentencePieceProcessor(model_proto=data)

    def normalized(self, text: str) -> str:
        """SentencePiece's normalisation: character map, white space, space marks, dummy prefix."""
        m = self.model
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if m.trim_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = " " + text if m.dummy_prefix else text
        return text.replace(" ", SPACE) if m.escape else text

    def _learn(self, parts: list[str]) -> None:
        """Encode, compare and decode parts; without garbage collection, since many small objects come and none form cycles."""
        on = gc.isenabled()
        gc.disable()
        try:
            self._learn_now(parts)
        finally:
            if on:
                gc.enable()

    def _learn_now(self, parts: list[str]) -> None:
        if len(self.memo) + len(parts) > self.memo_parts:
            self.memo, self.older = {}, self.memo
        fresh = []
        for p in parts:
            if (x := self.older.get(p)) is not None:
                self.memo[p] = x
            else:
                fresh.append(p)
        ids = [e.ids for e in self.made.encode_batch_fast(fresh, add_special_tokens=False)]
        said = ids
        if self.check is not None and self.by_part:
            # the library adds the prefix itself; one mark alone is a piece
            said = self.check.encode([p[1:].replace(SPACE, " ") for p in fresh], num_threads=1)
            if SPACE in fresh:
                said[fresh.index(SPACE)] = [self.check.piece_to_id(SPACE)]
        plain, memo = self.plain, self.memo
        for p, x, y in zip(fresh, ids, said, strict=True):
            memo[p] = array("i", x).tobytes()
            try:
                same = "".join([plain[i] for i in x]) == p
            except TypeError:
                same = self.pieces_text(x) == p
            if not same or x != y:
                self.wrong.add(p)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool | None]]:
        """(ids, parity) of each text; parity: the library agrees and decoding gives the normalised text back; None if not asked."""
        cut = [self.part.findall(self.normalized(t)) if t else [] for t in texts]
        memo = self.memo
        new = list({p for parts in cut for p in parts if p not in memo})
        if new:
            self._learn(new)
        memo, out = self.memo, []
        for text, parts in zip(texts, cut, strict=True):
            known = list(map(memo.get, parts))
            if None in known:  # the memo has moved on
                self._learn([p for p in dict.fromkeys(parts) if p not in memo])
                known = [self.memo.get(p) or self.older[p] for p in parts]
                memo = self.memo
            ids = np.frombuffer(b"".join(known), dtype=np.int32)
            good = None
            if self.check is not None:
                good = not (self.wrong and self.wrong.intersection(parts))
                if text and not self.by_part:
                    good &= self.check.encode(text) == ids.tolist()
            out.append((ids, good))
        return out

    def pieces_text(self, ids: list[int]) -> str:
        """Escaped text of ids; runs of byte pieces are read as UTF-8."""
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i is not None:
                p, _, t = self.model.pieces[i]
                out.append(self.model.unk_surface if t == UNKNOWN else "" if t == CONTROL else p)
        return "".join(out)

    def decode(self, ids: list[int] | None) -> str:
        text = self.pieces_text([] if ids is None else ids).replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_CODECS: dict[tuple, Codec] = {}


def codec_of(data: bytes, threads: int = THREADS, parity: bool = True) -> Codec:
    """The worker's codec for a model, with what it has learnt in earlier tasks."""
    key = (xxhash.xxh3_64_intdigest(data), threads, parity)
    if key not in _CODECS:
        _CODECS[key] = Codec(data, threads, parity)
    return _CODECS[key]


def model_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, model: str | bytes = MODEL, threads: int = THREADS, id_col: str = "doc_id", text_col: str = "text", parity: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids, parity.

    ``parity`` holds if for every part of the text (cut before runs of spaces, where no piece
    of the model crosses) the SentencePiece library gives the same ids and decoding gives the
    part back; a model that trims spaces, maps characters or joins words is compared with the
    library by whole texts. It is null without ``parity``. The driver reads the model (a path
    there, or its bytes) and broadcasts it.

    Null and empty texts have no ids and parity true. Repeated rows and null ids get a row
    each; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(model_bytes(model) if isinstance(model, str) else model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("parity", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value, threads, parity)
        for batch in batches:
            for at, texts in texts_of(batch, "text", 128):
                ids, same = zip(*codec.encode(texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(map(len, ids), pa.int64()), _lists(ids), pa.array(same, pa.bool_())],
                    schema=schema,
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, parity boolean")


def decode(rows: DataFrame, model: str | bytes = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give an empty text."""
    data = rows.sparkSession.sparkContext.broadcast(model_bytes(model) if isinstance(model, str) else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value, parity=False)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                text = pa.array([codec.decode(x) for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), text], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
