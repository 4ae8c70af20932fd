"""N-gram Jaccard self-join: MinHash LSH forest, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, dropped, left, shingles, small_batches, texts_of, word_hashes, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Trees of the forest and signature values along each.
TREES = 24
DEPTH = 10
#: Chance with which a pair exactly at the threshold shares a matched prefix.
TARGET_RECALL = 0.98
#: Sets under one whole label of which a task holds back no more: the others are linked to the first as they come, and only the first goes up. Changes no component.
CROWD = 64
#: 64-bit words of the bitmap by which texts are told that need no comparison: the broadcast's bound.
FILTER_WORDS = 1 << 18
PLACE = f"pmod(shiftright(row, 6), {FILTER_WORDS}L)"
HOLDS = "getbit(bits, cast(row & 63L AS int)) = 1"
#: Sets whose labels a task keeps.
KNOWN_SETS = 8_192
#: Documents, and characters, of a block whose pairs one group of rows verifies.
BLOCK_DOCS = 256
BLOCK_CHARS = 2_000_000


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The matched prefix, shortened value by value until a pair at the threshold has the target recall."""
    while depth > 1 and prefix_recall(threshold, trees, depth) < target:
        depth -= 1
    return depth


def prefix_recall(similarity: float, trees: int = TREES, depth: int = DEPTH) -> float:
    """Chance that a pair of this similarity shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


class MinHasher:
    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.mul = rng.integers(0, 2**31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 2**32, trees * depth, dtype=np.uint32)

    def labels(self, sh: np.ndarray) -> bytes:
        """The trees' labels: 16 bits of the smallest value of each hash function, big-endian."""
        folded = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
        low = np.full(len(self.mul), np.iinfo(np.uint32).max, dtype=np.uint32)
        for at in range(0, len(folded), 256):
            part = folded[at : at + 256, None] * self.mul
            part += self.add
            np.minimum(low, part.min(axis=0), out=low)
        return (low & np.uint32(0xFFFF)).astype(">u2").tobytes()


def signatures(docs: DataFrame, trees: int, depth: int, width: int) -> DataFrame:
    """doc_id, text_hash, set_key (128 bits of the shingle set), labels in the forest, chars (of the text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_key", pa.binary()), ("labels", pa.binary()), ("chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = MinHasher(trees, depth), {}  # labels of sets seen lately: copies are often neighbours
        for batch in batches:
            for at, texts in texts_of(batch, "text"):
                keys, labels = [], []
                for words in word_hashes(texts):
                    sh = np.unique(shingles(words, width))
                    key = label = None
                    if len(sh):
                        key = xxhash.xxh3_128_digest(sh.tobytes())
                        if (label := known.get(key)) is None:
                            if len(known) >= KNOWN_SETS:
                                known.clear()
                            known[key] = label = hasher.labels(sh)
                    keys.append(key)
                    labels.append(label)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(keys, pa.binary()), pa.array(labels, pa.binary()),
                     pa.array([len(t or "") for t in texts], pa.int64())], schema=schema,
                )

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, set_key binary, labels binary, chars long")


class NodeRuns:
    """Star edges of one task's rows of the forest, which come sorted by (tree, label).

    In every node the matched prefix starts at the whole label and is shortened to ``prefix``
    values. Where at least ``crowd`` sets share a whole label they are linked there, and the
    first of them stands for all on the way up; the others go up by themselves. A run of equal
    labels is held back until it ends or is a crowd, so at most ``crowd`` rows wait. ``ends``
    are the nodes that may go on in other tasks.
    """

    def __init__(self, prefix: int, crowd: int) -> None:
        self.cut, self.crowd = 2 + 2 * prefix, crowd
        self.keys: np.ndarray | None = None  # rows that wait
        self.nodes = np.empty(0, dtype=np.int64)
        self.crowded: tuple[bytes, int] | None = None  # the crowd that may go on, and its first set
        self.sparse: tuple[bytes, int] | None = None  # likewise the latest node of the shortened prefix
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.ends: dict[bytes, int] = {}
        self.first_sparse = True

    def add(self, keys: np.ndarray, nodes: np.ndarray, last: bool = False) -> None:
        if self.keys is not None:
            keys, nodes = np.concatenate([self.keys, keys]), np.concatenate([self.nodes, nodes])
        self.keys = None
        if self.crowded and len(nodes):
            more = len(nodes) if (same := (keys == np.frombuffer(self.crowded[0], np.uint8)).all(axis=1)).all() else int(np.argmin(same))
            self.edges.append((np.full(more, self.crowded[1]), nodes[:more]))
            keys, nodes = keys[more:], nodes[more:]
            if len(nodes) or last:
                self.ends[self.crowded[0]] = self.crowded[1]
                self.crowded = None
        if not len(nodes):
            if last:
                self._shortened(keys[:, : self.cut], nodes, last)
            return
        new = np.ones(len(nodes), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        start = np.nonzero(new)[0]
        size = np.diff(np.append(start, len(nodes)))
        if not last:
            if size[-1] >= self.crowd:
                self.crowded = keys[-1].tobytes(), int(nodes[start[-1]])
            else:
                self.keys, self.nodes = keys[start[-1] :], nodes[start[-1] :]
                keys, nodes, start, size = keys[: start[-1]], nodes[: start[-1]], start[:-1], size[:-1]
                if not len(start):
                    return
        if not self.ends:
            self.ends[keys[0].tobytes()] = int(nodes[0])  # the first label may have begun in another task
        if last:
            self.ends[keys[-1].tobytes()] = int(nodes[start[-1]])
        crowded = np.repeat(size >= self.crowd, size)
        lead = np.repeat(nodes[start], size)
        self.edges.append((lead[crowded], nodes[crowded]))
        up = ~crowded
        up[start] = True
        self._shortened(keys[up, : self.cut], nodes[up], last)

    def _shortened(self, keys: np.ndarray, nodes: np.ndarray, last: bool) -> None:
        if len(nodes):
            new = np.ones(len(nodes), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            new[0] = self.sparse is None or keys[0].tobytes() != self.sparse[0]
            start = np.maximum.accumulate(np.where(new, np.arange(len(nodes)), -1))
            lead = np.where(start >= 0, nodes[start], self.sparse[1] if self.sparse else 0)
            self.edges.append((lead, nodes))
            if self.first_sparse:
                self.ends[b"p" + keys[0].tobytes()] = int(lead[0])
                self.first_sparse = False
            self.sparse = keys[-1].tobytes(), int(lead[-1])
        if last and self.sparse:
            self.ends[b"p" + self.sparse[0]] = self.sparse[1]

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The edges so far, without loops."""
        a, b = (np.concatenate([e[k] for e in self.edges]) if self.edges else np.empty(0, np.int64) for k in range(2))
        self.edges = []
        keep = a != b
        return a[keep], b[keep]


def forest_edges(reps: DataFrame, trees: int, depth: int, prefix: int, crowd: int = CROWD) -> tuple[DataFrame, str]:
    """(a, b): edges that join the sets under each node of the forest, as stars.

    Each tree's labels are sorted over all tasks by (tree, label, node): a trie node is a run of
    neighbours with a common prefix, however many tasks it spans, so a hot node spreads.
    Runs that cross tasks are joined by boundary rows, a few a task.
    """
    rows = reps.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.substr(F.col("labels"), i * (2 * depth) + 1, F.lit(2 * depth)))).alias("tree", "label"))
    rows = rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    schema = pa.schema([("key", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = NodeRuns(prefix, crowd)
        empty = np.empty((0, 2 + 2 * depth), dtype=np.uint8)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = np.empty((n, 2 + 2 * depth), dtype=np.uint8)
            keys[:, :2] = np.asarray(batch.column(1)).astype(">u2").view(np.uint8).reshape(n, 2)
            labels = batch.column(2).cast(pa.binary(2 * depth))
            at = labels.offset * 2 * depth
            keys[:, 2:] = np.frombuffer(labels.buffers()[1], dtype=np.uint8)[at : at + n * 2 * depth].reshape(n, 2 * depth)
            seen.add(keys, np.asarray(batch.column(0)))
            a, b = seen.taken()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.binary()), pa.array(a), pa.array(b)], schema=schema)
        seen.add(empty, np.empty(0, dtype=np.int64), last=True)
        a, b = seen.taken()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.binary()), pa.array(a), pa.array(b)], schema=schema)
        if seen.ends:
            ids = pa.array(list(seen.ends.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.ends), pa.binary()), ids, ids], schema=schema)

    table, path = written(rows.mapInArrow(runs, "key binary, a long, b long"), "forest")
    edge = table.where("key IS NULL").select("a", "b")
    ends = table.where("key IS NOT NULL")
    heads = ends.groupBy("key").agg(F.min("a").alias("head"))
    across = ends.join(heads, "key").select(F.col("head").alias("a"), F.col("b"))
    return edge.unionByName(across).where("a <> b"), path


def bitmap(keys: DataFrame) -> DataFrame:
    """(place, bits): which of FILTER_WORDS * 64 bits the 64-bit ``row`` of some key falls on; at most FILTER_WORDS rows."""
    return keys.groupBy(F.expr(PLACE).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(row & 63L AS int)))").alias("bits"))


def shingled(members: DataFrame, width: int) -> DataFrame:
    """``members`` (comp, blocks, node, copies, text) with the sorted hashes of its shingles in place of the text."""
    kinds = [("comp", pa.int64()), ("blocks", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("hashes", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_of(batch, "text", 64):
                made = pa.array([np.unique(shingles(w, width)).tobytes() for w in word_hashes(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(texts)) for i in range(4)), made], schema=pa.schema(kinds))

    return members.select("comp", "blocks", "node", "copies", "text").mapInArrow(run, "comp long, blocks int, node long, copies long, hashes binary")


def verified_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links, root) of each block pair; ``members`` has comp, i, j, blk, node, copies, hashes.

    Pairs within a group of rows with one (comp, i, j) are counted by products of the
    set-by-shingle matrix: no pair becomes a row. ``root`` links the sets that belong together.
    """
    schema = pa.schema([("node", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = list(zip(*(column[n].to_pylist() for n in ("comp", "i", "j")), strict=True))
            rest = list(zip(*(column[n].to_pylist() for n in ("node", "blk", "copies")), strict=True))
            out = []
            for r, here in enumerate(keys):
                if here != key:
                    out += _links(held, threshold)
                    key, held = here, []
                held.append((*rest[r], np.frombuffer(column["hashes"][r].as_py(), dtype=np.uint64), here[1] == here[2]))
            if out:
                yield _batch(out, schema)
        if out := _links(held, threshold):
            yield _batch(out, schema)

    rows = members.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return rows.mapInArrow(run, "node long, n_links long, root long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of sets whose Jaccard similarity is the threshold or more."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values = values[order]
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)[order]
    del order
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    del values
    count = np.diff(np.append(np.nonzero(new)[0], len(new)))
    shared = count > 1
    keep = np.repeat(shared, count)
    owner = owner[keep]
    column = np.repeat(np.arange(int(shared.sum()), dtype=np.int32), count[shared])
    common = np.zeros((m, m), dtype=np.float64)
    for low in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        part = np.zeros((m, 2048), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1.0
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    # the smallest gap between fractions of sets is far above the rounding of a division
    out = common >= (threshold - 1e-12) * union
    np.fill_diagonal(out, False)
    return out


def _links(held: list[tuple], threshold: float) -> list[tuple[int, int, int]]:
    if len(held) < 2:
        return []
    held.sort(key=lambda x: x[0])
    node, blk, copies = (np.array([x[k] for x in held], dtype=np.int64) for k in range(3))
    pair = linked([x[3] for x in held], threshold)
    if not held[0][4]:
        pair &= blk[:, None] != blk[None, :]
    n = pair @ copies
    root = np.arange(len(held))
    while True:  # smallest index reachable; sets are in the order of their ids
        low = np.minimum(root, np.where(pair, root[None, :], len(held)).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [(int(node[k]), int(n[k]), int(node[root[k]])) for k in np.nonzero(n)[0]]


def ngram_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    width: int = SHINGLE_WORDS,
    trees: int = TREES,
    depth: int = DEPTH,
    target_recall: float = TARGET_RECALL,
    crowd: int = CROWD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, copy_id, class_id, n_copies, n_links, text_hash, class_key.

    Documents with the same set of ``width``-word shingles are one set (copy_id: the smallest
    id of them, n_copies: how many). Sets whose exact Jaccard similarity is ``threshold`` or
    more are linked; class_id is the smallest id of the connected sets, n_links the number of
    other documents that are linked or equal. class_key names a class whatever the ids are.

    Sets that share a label prefix in any tree of the forest are compared. The prefix starts as
    the whole label and is shortened until a pair at the threshold has ``target_recall``, in
    every node alike, however many sets are in it. Every pair within a component of such candidates is verified, in blocks, so
    groups of any size are complete.

    A text under ``width`` words is one shingle. Texts without words (null, empty) are linked
    to nothing: copy_id and class_id are their own id, class_key is null. Rows are told apart by
    their texts: an id that names several texts names no set or class that has another id, and
    rows with a null doc_id are linked like others (ids null where no linked row has one).
    Repeated rows are copies of one another. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    prefix = prefix_depth(threshold, trees, depth, target_recall)
    signed, signed_path = written(signatures(rows, trees, depth, width), "signatures")
    named = signed.where("set_key IS NOT NULL")
    # ids of several sets are rare; the table's size is known, so Spark broadcasts it below its threshold
    several = named.where("doc_id IS NOT NULL").withColumn("s", F.xxhash64("set_key")).groupBy("doc_id").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    several, several_path = written(several.where("a <> b").select("doc_id", F.lit(True).alias("several")), "shared-ids")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    reps = named.join(several, "doc_id", "left").groupBy("set_key").agg(
        F.min(F.when(F.col("several").isNull(), F.col("doc_id"))).alias("own"), F.min("doc_id").alias("any"), F.count(F.lit(1)).alias("copies"),
        F.max("chars").alias("chars"), F.min(first).alias("first"), F.first("labels").alias("labels"),
    )
    reps, reps_path = written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")  # written, so nodes keep their numbers
    slim, slim_path = written(signed.select("doc_id", "text_hash", "set_key"), "set-keys")
    dropped(spark, signed_path, several_path)
    edges, forest_path = forest_edges(reps, trees, depth, prefix, crowd)
    nodes, nodes_path = components(edges)
    dropped(spark, forest_path)
    # blocks by the number and length of a component's sets, before any text moves
    of = nodes.select("node", F.col("root").alias("comp")).join(reps.select("node", "copies", "chars", "first"), "node")
    sized = of.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("chars").alias("chars"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_DOCS, F.col("chars") / BLOCK_CHARS)).cast("int")
    sized = sized.where("m > 1").select("comp", F.greatest(blocks, F.lit(1)).alias("blocks"))
    placed = of.join(sized, "comp").select("node", "comp", "copies", "blocks", F.col("first.doc_id").alias("of_id"), F.col("first.text_hash").alias("of_text"))
    placed, placed_path = written(placed, "blocks")
    # the shingles of the sets in components, then each block of a component meets every other
    keyed = placed.withColumn("row", F.xxhash64("of_id", "of_text"))
    # a bitmap of fixed size lets few other texts through, so about as much moves as is needed; the hint keeps the plan alike at every size
    held = rows.withColumn("row", F.xxhash64("doc_id", "text_hash")).withColumn("place", F.expr(PLACE)).join(F.broadcast(bitmap(keyed)), "place").where(HOLDS)
    members = held.drop("place", "bits").join(keyed.hint("merge"), "row")
    members = shingled(members.where("text_hash = of_text AND doc_id <=> of_id").dropDuplicates(["node"]), width)
    members = members.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("comp", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node", "copies", "hashes")
    links, links_path = written(verified_links(members, threshold), "links")
    dropped(spark, nodes_path, placed_path)
    classes, classes_path = components(links.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")))
    counted = links.groupBy("node").agg(F.sum("n_links").alias("n"))
    table = reps.select("set_key", "own", "any", "copies", "node").join(counted, "node", "left").join(classes, "node", "left")
    table = table.select("set_key", "own", "any", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    table, table_path = written(table, "sets")
    # a class is named by its smallest id; an id of several texts names it only if it has no other
    names = table.groupBy("root").agg(F.coalesce(F.min("own"), F.min("any")).alias("class_id"), F.min(F.hex("set_key")).alias("class_key"))
    table, sets_path = written(table.join(names, "root").select("set_key", F.coalesce("own", "any").alias("rep"), "copies", "n", "class_id", "class_key"), "set-classes")
    dropped(spark, links_path, classes_path, reps_path, table_path)
    left(slim_path, sets_path)
    out = slim.join(table, "set_key", "left")
    alone = F.col("set_key").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("copy_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
        "class_key",
    )
