"""Hard negatives by exact inner products, multiplied tile by tile with Strassen's recursion.

Rows are packed where they lie into blocks of candidates and blocks of anchors. Blocks
are dealt to a grid of cells by a hash of the block, so no row's key decides its place:
a cell holds about ANCHORS anchors and CANDIDATES candidates, its number follows the
table, and every anchor meets every candidate in one cell. A cell multiplies tiles and
keeps, for each anchor, a heap of its best rows; heaps of cells merge by rank. Two passes
are made: the first fills the positive heaps, the second the heaps of the score windows
that the positives set. Scores are never stored.

The recursion works on int64 with zero padding up to the split sizes. Additions wrap
alike on both sides, so intermediate sums can't spoil a product that fits 64 bits.

Cases: rows with a null identifier or label, or a vector that is null or has a null or
non-finite component, take no part; rows equal in identifier, label and vector count
once; other rows that share an identifier are rows of their own, ties among them by
vector; shorter vectors count as padded with zeros; components beyond 2^18 count as
2^18 (2^26 scaled); an anchor without positives or negatives gives no rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wakeline.llm.common import durable
from wakeline.llm.vectors import matrix, vector_rows

ANCHOR_STEP, SHIFT_STEP, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # window of a negative's score, in percent of the positive's
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS  # rows of a block
ANCHORS, CANDIDATES = 1 << 14, 1 << 13  # of a cell, about
TILE = (512, 1024)
LEAF = 16  # side at which the recursion ends


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for int64 matrices, by seven products of halves."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    depth = 0
    while min(n, k, m) >> depth > LEAF:
        depth += 1
    step = 1 << depth
    pad = lambda x: np.pad(x, [(0, -s % step) for s in x.shape])
    # The right side lies column by column: the leaves read it along the inner dimension.
    return _halves(pad(a), pad(b.T).T, depth)[:n, :m]


def _halves(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if depth == 0:
        return a @ b
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = _halves(a11 + a22, b11 + b22, depth - 1)
    p2 = _halves(a21 + a22, b11, depth - 1)
    p3 = _halves(a11, b12 - b22, depth - 1)
    p4 = _halves(a22, b21 - b11, depth - 1)
    p5 = _halves(a11 + a12, b22, depth - 1)
    p6 = _halves(a21 - a11, b11 + b12, depth - 1)
    p7 = _halves(a12 - a22, b21 + b22, depth - 1)
    c = np.empty((2 * i, 2 * l), np.int64)
    c[:i, :l] = p1 + p4 - p5 + p7
    c[:i, l:] = p3 + p5
    c[i:, :l] = p2 + p4
    c[i:, l:] = p1 - p2 + p3 + p6
    return c


@dataclass
class Heap:
    """The best ``size`` entries of each slot, by larger score, then smaller order; mergeable."""

    slots: int
    size: int
    slot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bar: np.ndarray | None = None  # score of the last entry of a full slot

    def __post_init__(self):
        self.bar = np.full(self.slots, np.iinfo(np.int64).min)

    def merge(self, slot: np.ndarray, score: np.ndarray, order: np.ndarray) -> None:
        slot, score, order = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.order, order)))
        ranked = np.lexsort((order, -score, slot))
        slot, score, order = slot[ranked], score[ranked], order[ranked]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else slot
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        kept = rank < self.size
        self.slot, self.score, self.order = slot[kept], score[kept], order[kept]
        last = rank == self.size - 1
        self.bar[slot[last]] = score[last]


@dataclass
class Rows:
    """Rows of some blocks: identifier, place in the packed table, label and vector."""

    ids: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> "Rows":
        read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
        width = max(table["width"].to_pylist())
        parts = []
        for n, w, flat in zip(table["n"].to_pylist(), table["width"].to_pylist(), read("vectors", "<i4")):
            parts.append(np.pad(flat.reshape(n, w), [(0, 0), (0, width - w)]).astype(np.int64))
        ids, keys, labels = (np.concatenate(read(c, "<i8")) for c in ("ids", "keys", "labels"))
        return Rows(ids, keys, labels, np.concatenate(parts))

    def take(self, at) -> "Rows":
        return Rows(self.ids[at], self.keys[at], self.labels[at], self.vectors[at])


def _pack(anchor_step: int):
    schema = [("block", pa.int64()), ("anchors", pa.bool_()), ("n", pa.int32()), ("width", pa.int32()),
              ("ids", pa.binary()), ("keys", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())]

    def emit(block: int, anchors: bool, rows: Rows):
        row = (block, anchors, len(rows.ids), rows.vectors.shape[1], rows.ids.astype("<i8").tobytes(),
               rows.keys.astype("<i8").tobytes(), rows.labels.astype("<i8").tobytes(), rows.vectors.astype("<i4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, schema)], [n for n, _ in schema])

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 28
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                n = part.num_rows
                rows = Rows(
                    part.column("vec_id").to_numpy(), (np.int64(block) << BLOCK_BITS) + np.arange(n),
                    part.column("label").to_numpy(), matrix(part.column("v")),
                )
                yield emit(block, False, rows)
                asks = np.flatnonzero(rows.ids % anchor_step == 0)
                if len(asks):
                    yield emit(block, True, rows.take(asks))
                block += 1

    return run, ", ".join(f"{n} {t}" for n, t in zip(
        [n for n, _ in schema], ["bigint", "boolean", "int", "int", "binary", "binary", "binary", "binary"]))


def _tiles(anchors: Rows, candidates: Rows):
    """(first anchor, first candidate, scores) of every tile."""
    width = max(anchors.vectors.shape[1], candidates.vectors.shape[1])
    left, right = (np.pad(x.vectors, [(0, 0), (0, width - x.vectors.shape[1])]) for x in (anchors, candidates))
    for i in range(0, len(left), TILE[0]):
        for j in range(0, len(right), TILE[1]):
            yield i, j, strassen(left[i : i + TILE[0]], right[j : j + TILE[1]].T)


def _by_id(rows: Rows) -> Rows:
    """Rows in the order that decides ties: identifier, then vector."""
    return rows.take(np.lexsort((*rows.vectors.T[::-1], rows.ids)) if rows.vectors.shape[1] else np.argsort(rows.ids, kind="stable"))


def _positives(size: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        anchors, rows = Rows.of(asked), _by_id(Rows.of(held))
        heap = Heap(len(anchors.ids), size)
        for i, j, scores in _tiles(anchors, rows):
            a, b = slice(i, i + scores.shape[0]), slice(j, j + scores.shape[1])
            fits = anchors.labels[a, None] == rows.labels[None, b]
            fits &= anchors.keys[a, None] != rows.keys[None, b]
            fits &= scores >= heap.bar[a, None]
            at, order = np.nonzero(fits)
            heap.merge(at + i, scores[at, order], order + j)
        return pa.table({
            "anchor_key": pa.array(anchors.keys[heap.slot]), "anchor_id": pa.array(anchors.ids[heap.slot]),
            "key": pa.array(rows.keys[heap.order]), "id": pa.array(rows.ids[heap.order]),
            "tie": pa.array([v.tolist() for v in rows.vectors[heap.order]], pa.list_(pa.int64())), "score": pa.array(heap.score),
        })

    return run


def _windows(low: int, high: int, size: int):
    """Bounds of a score x: low * p <= 100 * x <= high * p, without leaving 64 bits."""
    share = lambda p, q: p // 100 * q + p % 100 * q // 100  # noqa: E731  floor(p * q / 100)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        windowed = asked.filter(pa.array([x is not None for x in asked["slots"].to_pylist()], pa.bool_()))
        if not windowed.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (
                ("anchor_key", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("tie", pa.list_(pa.int64())), ("score", pa.int64()))})
        anchors, rows = Rows.of(windowed), _by_id(Rows.of(held))
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in windowed[name]])
        # Slots of an anchor: (place of the anchor, number, positive score).
        known = {k: n for n, k in enumerate(anchors.keys.tolist())}
        owner = np.array([known[k] for k in read("slot_keys", "<i8").tolist()], np.int64)
        number, positive = read("slots", "<i4"), read("slot_scores", "<i8")
        least, most = -share(-positive, low), share(positive, high)
        by_owner = np.argsort(owner, kind="stable")
        heap = Heap(len(owner), size)
        for i, j, scores in _tiles(anchors, rows):
            b = slice(j, j + scores.shape[1])
            inside = by_owner[np.searchsorted(owner[by_owner], i) : np.searchsorted(owner[by_owner], i + scores.shape[0])]
            other = anchors.labels[i : i + scores.shape[0], None] != rows.labels[None, b]
            for s in np.array_split(inside, max(1, len(inside) // TILE[0])):
                mine = scores[owner[s] - i]
                fits = other[owner[s] - i]
                fits &= (mine >= np.maximum(least[s], heap.bar[s])[:, None]) & (mine <= most[s][:, None])
                at, order = np.nonzero(fits)
                heap.merge(s[at], mine[at, order], order + j)
        return pa.table({
            "anchor_key": pa.array(anchors.keys[owner[heap.slot]]), "slot": pa.array(number[heap.slot].astype(np.int32)),
            "id": pa.array(rows.ids[heap.order]),
            "tie": pa.array([v.tolist() for v in rows.vectors[heap.order]], pa.list_(pa.int64())), "score": pa.array(heap.score),
        })

    return run


def _pack_slots(table: pa.Table) -> pa.Table:
    """The positives' scores of one anchor block as a row: at most its rows times the heap's size."""
    column = lambda name, kind: pa.array([table[name].to_numpy().astype(kind).tobytes()], pa.binary())
    return pa.table({"block": table["block"].slice(0, 1), "slot_keys": column("anchor_key", "<i8"),
                     "slots": column("slot", "<i4"), "slot_scores": column("score", "<i8")})


def _best(table: DataFrame, keys: list[str], size: int, rank: str) -> DataFrame:
    """Merged heaps: the first ``size`` rows of each group, cut before and after the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "tie")
    return table.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= size)


def hard_negatives(
    table: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label",
    anchor_step: int = ANCHOR_STEP, shift_step: int = SHIFT_STEP, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    number, kind = F.col(key).cast("bigint"), F.col(label).cast("bigint")
    moved = F.when(number % shift_step == 0, (kind + 1) % LABELS).otherwise(kind)
    rows = vector_rows(
        table, vector, number.isNotNull() & kind.isNotNull(), number.alias("vec_id"), moved.alias("label")
    ).dropDuplicates(["vec_id", "label", "v"])
    pack, kinds = _pack(anchor_step)
    blocks = durable(rows.mapInArrow(pack, kinds))
    size = blocks.agg(
        F.sum(F.when(F.col("anchors"), F.col("n"))).alias("a"), F.sum(F.when(~F.col("anchors"), F.col("n"))).alias("c")
    ).first()
    high_cells, wide = -(-(size["a"] or 1) // ANCHORS), -(-(size["c"] or 1) // CANDIDATES)
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    held = blocks.filter(~F.col("anchors")).withColumn("x", place(wide)).withColumn("y", every(high_cells))

    def cells(asked: DataFrame, work, schema: str) -> DataFrame:
        spread = asked.withColumn("y", place(high_cells)).withColumn("x", every(wide))
        return spread.groupBy("x", "y").cogroup(held.groupBy("x", "y")).applyInArrow(_both(work, schema), schema)

    # New column names apart from the candidates': both sides come from one stored table.
    asked = blocks.filter("anchors").select(*[F.col(c).alias(c) for c in blocks.columns])
    found = cells(asked, _positives(n_positives),
                  "anchor_key bigint, anchor_id bigint, key bigint, id bigint, tie array<bigint>, score bigint")
    positives = durable(_best(found, ["anchor_key"], n_positives, "slot").drop("tie"))
    slots = positives.select(F.shiftright("anchor_key", BLOCK_BITS).alias("block"), "anchor_key", "slot", "score").groupBy(
        "block").applyInArrow(_pack_slots, "block bigint, slot_keys binary, slots binary, slot_scores binary")
    negatives = _best(
        cells(asked.join(slots, "block", "left"), _windows(low, high, n_negatives),
              "anchor_key bigint, slot int, id bigint, tie array<bigint>, score bigint"),
        ["anchor_key", "slot"], n_negatives, "rank",
    )
    return positives.select(
        "anchor_key", "slot", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    ).join(negatives.select(
        "anchor_key", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    ), ["anchor_key", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _both(work, schema: str):
    """``work`` where a cell holds anchors and candidates; else no rows."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
    empty = pa.table({n: pa.array([], kinds[t]) for n, t in (x.split() for x in schema.split(", "))})

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        return work(asked, held) if asked.num_rows and held.num_rows else empty

    return run
