"""Row pattern matching: regular expressions over each key's rows in time order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import offsets
from .shared import components, dropped, left, written

PATTERN = "A (D+ U+)+ P?"
#: Longest time between a row and the one before it, for D, U and P.
GAP_US = 30 * 60 * 1_000_000

# A row's symbol says what it may be besides A: nothing (x), down, up, a goal (p), a goal that
# goes down or up (d, u). NONE fits no letter.
NONE = 0
_SYMBOL = np.frombuffer(b"xDU?pdu?", dtype=np.uint8)
_OFF = {ord("p"): ord("x"), ord("d"): ord("D"), ord("u"): ord("U")}
_LETTER = bytes.maketrans(b"xpdu", b"APDU")
_CLASS = {"A": r"[^\x00]", "D": "[Dd]", "U": "[Uu]", "P": "(?P<P>[pdu])"}


def compiled(pattern: str):
    """The pattern over symbols; spaces mean nothing. It begins with A, which stands nowhere else: a segment has no other row that only A fits."""
    plain = "".join(pattern.split())
    if plain[:1] != "A" or plain[1:2] in ("*", "+", "?", "{") or plain.count("A") != 1 or "|" in regex.sub(r"\([^()]*\)", "", plain):
        raise ValueError("a pattern is one A and what follows it")
    return regex.compile("".join(_CLASS.get(c, c) for c in plain).encode())


def _symbols(t: dict[str, np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, goes on) of rows in order; the first goes on from nothing."""
    n = len(t["time"])
    near = np.zeros(n, dtype=bool)
    # (unsigned, so that times far apart do not wrap around)
    pause = t["time"][1:].astype(np.uint64) - t["time"][:-1].astype(np.uint64)
    near[1:] = t["valid"][1:] & t["valid"][:-1] & (t["key"][1:] == t["key"][:-1]) & (t["chain"][1:] == t["chain"][:-1]) & (pause <= np.uint64(gap))
    fits, goal = near & ((t["bits"] & 1) > 0), near & ((t["bits"] & 2) > 0)
    down, up = fits.copy(), fits.copy()
    down[1:] &= t["cents"][1:] < t["cents"][:-1]
    up[1:] &= t["cents"][1:] > t["cents"][:-1]
    sym = _SYMBOL[down + 2 * up + 4 * goal]
    return np.where(t["valid"], sym, NONE).astype(np.uint8), down | up | goal


def matched(t: dict[str, np.ndarray], symbols: np.ndarray, goes_on: np.ndarray, pattern) -> list[tuple[int, int, bytes]]:
    """(first row, row after the last, letters) of each start's match, in the rows' order.

    Starts are taken by ascending cents. A goal with fewer cents than the start is no goal for it
    nor for any later start, so its symbol loses that meaning once and for all. Segments lie side
    by side in one bytearray: none is left by a match, since its next row fits only A.
    """
    buf, letters = bytearray(symbols), symbols.tobytes().translate(_LETTER)
    cents = t["cents"]
    can = np.append(goes_on[1:], False) & (symbols != NONE) if not pattern.match(b"x") else symbols != NONE
    starts = np.nonzero(can)[0]
    starts = starts[np.argsort(cents[starts], kind="stable")]
    goals = np.nonzero((symbols == ord("p")) | (symbols == ord("d")) | (symbols == ord("u")))[0]
    goals = goals[np.argsort(cents[goals], kind="stable")]
    # how many goals are below each start
    below = np.searchsorted(cents[goals], cents[starts], side="left").tolist()
    goals, off, out = goals.tolist(), 0, []
    at_start = pattern.match
    for s, n in zip(starts.tolist(), below, strict=True):
        while off < n:
            buf[goals[off]] = _OFF[buf[goals[off]]]
            off += 1
        if m := at_start(buf, s):
            e = m.end()
            label = bytearray(letters[s:e])
            label[0] = 65
            for a, b in m.spans("P") if "P" in pattern.groupindex else ():
                label[a - s : b - s] = b"P" * (b - a)
            out.append((s, e, bytes(label)))
    out.sort()
    return out


_ROWS = ("part", "place", "chain", "key", "time", "id", "cents", "valid", "bits")
_FOUND = (
    "what byte, part int, place long, chain long, key long, time long, id long, cents long, valid boolean, bits byte, "
    "last_id long, n_rows long, sum_cents long, labels string"
)
MATCH, EDGE, LINK = 0, 1, 2
_TYPES = {"part": pa.int32(), "place": pa.int64(), "chain": pa.int64(), "key": pa.int64(), "time": pa.int64(), "id": pa.int64(), "cents": pa.int64(), "valid": pa.bool_(), "bits": pa.int8()}
_MORE = {"last_id": pa.int64(), "n_rows": pa.int64(), "sum_cents": pa.int64(), "labels": pa.string()}
_SCHEMA = pa.schema([("what", pa.int8()), *_TYPES.items(), *_MORE.items()])


def _out(what: int, t: dict, rows, **more) -> pa.RecordBatch:
    own = [pa.array(t[c][rows], k) for c, k in _TYPES.items()]
    n = len(own[0])
    rest = [pa.array(more[c], k) if c in more else pa.nulls(n, k) for c, k in _MORE.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, what, np.int8)), *own, *rest], schema=_SCHEMA)


def _matches(t: dict, pattern, gap: int) -> Iterator[pa.RecordBatch]:
    sym, on = _symbols(t, gap)
    found = matched(t, sym, on, pattern)
    if found:
        s, e = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        total = np.concatenate([[0], np.cumsum(t["cents"])])
        yield _out(MATCH, t, s, last_id=t["id"][e - 1], n_rows=e - s, sum_cents=total[e] - total[s], labels=[f[2].decode() for f in found])


def _cut(t: dict, a: int, b: int | None) -> dict:
    return {c: v[a:b] for c, v in t.items()}


def _scan(batches: Iterator[dict], pattern, gap: int, part: int | None) -> Iterator[pa.RecordBatch]:
    """Matches of the segments in batches of ordered rows; only the last segment is kept between batches.

    With a ``part`` number, the first and the last segment may go on in the neighbouring
    partitions: their rows come out as edges, tied to the boundary before (number ``part``) or
    after (``part + 1``) the partition. A partition without a boundary between segments also
    gives a link of its two boundaries.
    """
    open_, first = None, part is not None
    for t in batches:
        if open_ is not None:
            t = {c: np.concatenate([open_[c], t[c]]) for c in _ROWS}
        if not len(t["time"]):
            continue
        begins = np.nonzero(~_symbols(t, gap)[1])[0]
        if first and len(begins) > 1:
            head = _cut(t, 0, begins[1])
            yield _out(EDGE, head | {"chain": np.full(begins[1], part)}, slice(None))
            first = False
            t = _cut(t, begins[1], None)
            begins = begins[1:] - begins[1]
        open_ = _cut(t, begins[-1], None)
        if begins[-1]:
            yield from _matches(_cut(t, 0, begins[-1]), pattern, gap)
    if part is None:
        if open_ is not None:
            yield from _matches(open_, pattern, gap)
        return
    if first:
        nothing = {c: np.zeros(1, dtype=np.int64) for c in _ROWS} | {"chain": np.array([part])}
        yield _out(LINK, nothing, [0])
    if open_ is not None:
        yield _out(EDGE, open_ | {"chain": np.full(len(open_["time"]), part if first else part + 1)}, slice(None))


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}


def row_matches(
    rows: DataFrame, pattern: str = PATTERN, key: str = "client_id", time: str = "ts", id: str = "click_id", kind: str = "kind", value: str = "value",
    never: str = "error", goal: str = "click", gap_us: int = GAP_US,
) -> DataFrame:
    """Matches of ``pattern`` in each key's distinct rows, ordered by time and id (further ties by a digest of the row).

    One row per match: key (under its own name), match_no (from 1 per key, by first row),
    first_id, last_id, n_rows, sum_cents, labels (a letter per row). Cents are
    floor(100 * value + 0.5). A fits every row with a finite value; D a row with fewer cents than
    the row before it and a kind other than ``never``; U one with more; P one of kind ``goal``
    with at least the first row's cents. D, U and P also need the row before at most ``gap_us``
    earlier. Each row is a start: after a match the search goes on at the row after its first.

    Rows with a null key or time are dropped; null, infinite and NaN values fit no letter, but
    part their neighbours; a null kind fits A only; rows that differ in any column (extra ones
    too) are different rows; null ids come first among equal times. No rows give no rows. Keys
    and ids are whole numbers, times have no zone or are instants.

    Rows are sorted over all tasks (by key, time, id and digest), so a hot key is cut into as many
    partitions as its rows need. A segment, the rows a match may hold, ends at a pause, at a
    value that is not there, or at a row that only A fits; those across partitions are brought
    together by the boundaries they cross, all others are matched where they lie. A segment is
    held by one task, and its matches' letters are as many as the square of its rows.
    """
    known = compiled(pattern)
    others = [c for c in rows.columns if c not in (key, time, id, kind, value)]
    digest = F.md5(F.to_json(F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]), {"ignoreNullFields": "false"}))
    col = lambda c: F.col(f"`{c}`")
    bare = rows.where(col(key).isNotNull() & col(time).isNotNull()).select(
        col(key).cast("long").alias("key"), col(time).alias("time"), col(id).cast("long").alias("id"), col(kind).alias("kind"), col(value).cast("double").alias("value"), digest.alias("digest")
    )
    one = bare.distinct()  # combined before it moves, so that copies of a row do not
    amount = F.col("value")
    valid = amount.isNotNull() & ~F.isnan("value") & (F.abs(amount) < float("inf"))
    bits = F.coalesce((F.col("kind") != never).cast("byte"), F.lit(0).cast("byte")) + 2 * F.coalesce((F.col("kind") == goal).cast("byte"), F.lit(0).cast("byte"))
    tie = F.xxhash64("kind", "value", "digest").alias("tie")
    cents = F.when(valid, F.floor(F.lit(100.0) * amount + 0.5)).otherwise(0).cast("long")
    lined = one.select("key", "time", "id", tie, cents.alias("cents"), valid.alias("valid"), bits.cast("byte").alias("bits"))
    lined = lined.repartitionByRange("key", "time", "id", "tie").sortWithinPartitions("key", "time", "id", "tie").drop("tie")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def numbered() -> Iterator[dict]:
            at = 0
            for b in batches:
                n = b.num_rows
                t = {"key": b.column(0).to_numpy(), "time": b.column(1).cast(pa.timestamp("us")).cast(pa.int64()).to_numpy() if pa.types.is_timestamp(b.column(1).type) else b.column(1).cast(pa.int64()).to_numpy()}
                t |= {"id": pc.fill_null(b.column(2), _NO_ID).to_numpy(), "cents": b.column(3).to_numpy(), "valid": b.column(4).to_numpy(zero_copy_only=False), "bits": b.column(5).to_numpy()}
                yield t | {"part": np.full(n, part, np.int32), "place": np.arange(at, at + n), "chain": np.zeros(n, np.int64)}
                at += n

        return _scan(numbered(), known, gap_us, part)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(map(_arrays, batches), known, gap_us, None)

    spark = rows.sparkSession
    found, found_path = written(lined.mapInArrow(search, _FOUND), "pattern-rows")
    edges = found.where(F.col("what") == EDGE).select(*_ROWS)
    links = found.where(F.col("what") == LINK).select(F.col("chain").alias("a"), (F.col("chain") + 1).alias("b"))
    cc_path = None
    if not links.isEmpty():
        roots, cc_path = components(links)
        joined = edges.join(roots.select(F.col("node").alias("chain"), "root"), "chain", "left")
        edges = joined.withColumn("chain", F.coalesce("root", "chain")).select(*_ROWS)
    crossing = edges.repartition("chain").sortWithinPartitions("chain", "part", "place").mapInArrow(again, _FOUND)
    crossing, crossing_path = written(crossing, "pattern-crossing")
    if cc_path:
        dropped(spark, cc_path)
    left(found_path, crossing_path)
    all_ = found.where(F.col("what") == MATCH).unionByName(crossing)
    before = offsets(all_.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")), ["key"])
    no = F.row_number().over(Window.partitionBy("key", "part").orderBy("place"))
    ranked = all_.select("key", "part", "id", "last_id", "n_rows", "sum_cents", "labels", no.alias("no"))
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return ranked.join(before, ["key", "part"]).select(
        F.col("key").alias(key), (F.col("no") + F.col("before")).alias("match_no"), real("id").alias("first_id"), real("last_id").alias("last_id"), "n_rows", "sum_cents", "labels"
    )


#: Stands for a null id inside tasks.
_NO_ID = -(1 << 63)
