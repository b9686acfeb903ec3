"""Near duplicates by banded MinHash signatures, sequential Bayesian pruning and exact checks.

Documents of equal shingle sets form a class; all further work is on classes.

1. *Signatures.* A class gets 128 minima of 16 bits each and 32 bands of four. Two sets
   of similarity 0.85 share no band with a chance of 6e-11.
2. *Buckets.* (band key, class) rows are range-partitioned by sampled splitters, the
   class last, so a bucket of any size is cut into several ranges; what is alone in
   its bucket ends here.
3. *Hubs.* A class is compared with the least class of each of its buckets, batch of
   minima by batch: a pair goes as soon as the posterior chance (uniform prior) that its
   similarity reaches the threshold is at most MISS. The most alike hub that survives is
   verified on whole sets; links join classes into components.
4. *The rest, exactly.* Only a bucket that holds several components is looked at again:
   its classes outside its largest component are queries against all its classes, in
   blocks. A pair belongs to the first band that both share and is pruned from
   signatures as above. A task names the classes that still have a partner, never
   pairs; whole sets are brought to those alone and compared inside the same blocks,
   one link for each two components being returned. So every pair that shares a band
   and isn't pruned is verified, unless its components are already one.

Blocks are cut by the counted number of classes, and those of whole sets by their tokens
too; rows are sorted and read as a stream, so a task holds one unit at a time.

Cases: a null or empty text has an empty set, no link and itself as component; with
fewer words than a shingle the sequence is the one shingle; repeated rows are one class;
a null identifier gets its component's least identifier and is kept only if that is
null too; an empty table gives an empty result; other columns are not read. Sets are
named by 125 bits and shingles by 64, so different ones count as equal only by a clash.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wakeline.llm.common import durable, id_text, parallel_parts, text_batches
from wakeline.llm.components import components
from wakeline.llm.hashing import mix, windows, words

SHINGLE, PERCENT = 3, 85  # of op13
HASHES, BAND = 128, 4  # minima of a signature, and of a band
BATCH = 32  # minima compared at a time
MISS = 1e-9  # posterior chance of similarity below which a pair is given up
BLOCK = 512  # classes of a block
BLOCK_TOKENS = 4_000_000  # of the whole sets of a block, about
BROADCAST_ROWS = 1_000_000  # classes whose identifiers may be broadcast; beyond, a shuffled join

_RANDOM = np.random.RandomState(13)
_FACTORS = _RANDOM.randint(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.randint(0, 1 << 63, HASHES, np.uint64)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, offsets, _ = words(texts)
    runs = windows(hashes, size)
    found = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= size:
            found.append(np.unique(runs[a : b - size + 1]))
        else:
            found.append(windows(hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The low 16 bits of each of the HASHES minima, a row for each (non-empty) set."""
    tokens = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), "<u2")
    for k in range(HASHES):
        least = np.minimum.reduceat(tokens * _FACTORS[k] + _SHIFTS[k], starts)
        out[:, k] = mix(least) & np.uint64(0xFFFF)
    return out


def names(sets: list[np.ndarray]) -> pa.Array:
    """A 125-bit name of each set as decimal(38,0); the empty set is 0."""
    out = np.zeros((len(sets), 2), np.uint64)
    for row, tokens in enumerate(sets):
        if len(tokens):
            n = np.uint64(len(tokens))
            out[row, 0] = mix(mix(tokens ^ np.uint64(77)).sum(dtype=np.uint64, keepdims=True) + n)[0]
            out[row, 1] = mix(mix(tokens ^ np.uint64(7919)).sum(dtype=np.uint64, keepdims=True) ^ n)[0] >> np.uint64(3)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(sets), [None, pa.py_buffer(out.tobytes())])


def band_keys(signed: np.ndarray) -> np.ndarray:
    """The key of each band of each row; keys of different bands differ."""
    bands = np.ascontiguousarray(signed).view("<u8")
    return mix(bands ^ mix(np.arange(1, bands.shape[1] + 1, dtype=np.uint64)))


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[tuple[int, int]]:
    """(minima compared so far, matches that a pair needs to go on).

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1);
    its chance to reach the threshold t is the chance of at most m successes out of
    n + 1 with success t.
    """
    t = percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance <= miss and m < n:
            m += 1
            log = lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * np.log(t) + (n + 1 - m) * np.log(1 - t)
            chance += float(np.exp(log))
        out.append((n, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (row of left, row of right): the places of those never given up, and their matches."""
    at, matches, start = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, need in steps:
        matches = matches + (left[at, start:n] == right[at, start:n]).sum(1)
        good = matches >= need
        at, matches, start = at[good], matches[good], n
    return at, matches


def _bytes(t) -> bytes:
    return t.as_buffer().to_pybytes()


def _sign(size: int):
    def run(batches):
        for ids, texts in text_batches(batches):
            sets = shingle_sets([_bytes(t) for t in texts], size)
            full = [k for k, s in enumerate(sets) if len(s)]
            signed = iter(signatures([sets[k] for k in full])) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), names(sets),
                 pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "name", "signature"],
            )

    return run


def _read(column, kind, width: int) -> np.ndarray:
    """Rows of fixed-size binary values."""
    return np.frombuffer(b"".join(_bytes(x) for x in column), kind).reshape(-1, width)


def _bands(batches):
    for batch in batches:
        keys = band_keys(_read(batch.column("signature"), "<u2", HASHES))
        classes = np.repeat(batch.column("class").to_numpy(), keys.shape[1])
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel().view(np.int64)), "class": pa.array(classes)})


def _shared(batches):
    """Of rows sorted by key: those that aren't alone, and those of the first and last key of the range."""
    held, first, known = None, None, False  # the last row so far, the first key, whether the row before had the last one's
    for batch in batches:
        keys, classes = batch.column("key").to_numpy(), batch.column("class").to_numpy()
        if not len(keys):
            continue
        first = keys[0] if first is None else first
        if held is not None:
            keys, classes = np.concatenate([held[0], keys]), np.concatenate([held[1], classes])
        same = keys[1:] == keys[:-1]
        keep = np.r_[known, same] | np.r_[same, False] | (keys == first)
        tail = len(keys) - 1  # its key may go on in the next batch, or in the next range
        known, keep[tail] = bool(same[-1]) if tail else known, False
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys[keep]), "class": pa.array(classes[keep])})
        held = keys[tail:], classes[tail:]
    if held is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array(held[0]), "class": pa.array(held[1])})


def _alike(steps):
    def run(batches):
        for batch in batches:
            left, right = (_read(batch.column(c), "<u2", HASHES) for c in ("signature_u", "signature_v"))
            at, matches = survivors(left, right, steps)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("u").take(at), batch.column("v").take(at), pa.array(matches.astype(np.int64))], ["u", "v", "matches"]
            )

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("tokens_u"), batch.column("tokens_v")):
                x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(size: int):
    """Whole sets of the classes' documents; a row whose text is another one is skipped."""

    def run(batches):
        for batch in batches:
            at = 0
            for _, texts in text_batches([batch]):
                part = batch.slice(at, len(texts))
                at += len(texts)
                sets = shingle_sets([_bytes(t) for t in texts], size)
                good = pc.equal(names(sets), part.column("name"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["class", "tokens"]
                ).filter(good)

    return run


def _units(batches, columns: list[str]):
    """(key, q, m) and the rows of each unit, from rows sorted by unit; holds one unit at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "q", "m")], 1)
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(marks)]):
            mark = tuple(marks[a].tolist())
            if last is not None and mark != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.select(columns).slice(a, b - a))
            last = mark
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def _pairs(table: pa.Table, step: int):
    """Lots of (query row, member row) pairs of a unit whose components differ.

    A member outside the main component is a query elsewhere: of such a pair the lesser class asks.
    """
    asks = table["is_query"].to_numpy()
    classes, parts, main = (table[c].to_numpy() for c in ("class", "part", "in_main"))
    queries, members = np.flatnonzero(asks), np.flatnonzero(~asks)
    for start in range(0, len(queries), step):
        q = queries[start : start + step]
        fits = parts[q, None] != parts[None, members]
        fits &= main[None, members] | (classes[q, None] < classes[None, members])
        a, b = np.nonzero(fits)
        yield q[a], members[b]


def _involved(steps):
    """Rows of a unit that have a partner left after pruning by signatures."""
    kept = ["class", "part", "is_query", "in_main"]

    def run(batches):
        for (key, q, m), table in _units(batches, [*kept, "signature"]):
            signed = _read(table["signature"], "<u2", HASHES)
            found = np.zeros(len(signed), bool)
            for a, b in _pairs(table, 128):
                for s in range(0, len(a), 1 << 16):
                    x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                    at, _ = survivors(signed[x], signed[y], steps)
                    x, y = x[at], y[at]
                    bands = (signed[x].view("<u8") == signed[y].view("<u8")).argmax(1) if len(x) else x
                    own = band_keys(signed[x])[np.arange(len(x)), bands].view(np.int64) == key  # the first band that both share
                    found[x[own]] = found[y[own]] = True
            if found.any():
                out = table.select(kept).filter(pa.array(found))
                n = out.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * n, t) for v, t in ((key, pa.int64()), (q, pa.int32()), (m, pa.int32()))]
                    + [c.combine_chunks() for c in out.columns], ["key", "q", "m", *kept])

    return run


class Postings:
    """Sets of one block, looked up by token."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """Common tokens with each set."""
        low, high = np.searchsorted(self.tokens, tokens), np.searchsorted(self.tokens, tokens, "right")
        size = high - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def _block_links(percent: int):
    """One link for each two components with a link in a unit."""

    def run(batches):
        for _, table in _units(batches, ["class", "part", "is_query", "in_main", "tokens"]):
            asks = table["is_query"].to_numpy()
            queries, members = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(queries) or not len(members):
                continue
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table["tokens"]]
            classes, parts, main = (table[c].to_numpy() for c in ("class", "part", "in_main"))
            block = Postings([sets[k] for k in members])
            found: dict[tuple[int, int], tuple[int, int]] = {}
            for q in queries:
                both = block.overlaps(sets[q])
                fits = 100 * both >= percent * (block.sizes + len(sets[q]) - both)
                fits &= (parts[members] != parts[q]) & (main[members] | (classes[q] < classes[members]))
                for k in members[fits]:
                    found.setdefault((min(parts[q], parts[k]), max(parts[q], parts[k])), (classes[q], classes[k]))
            if found:
                u, v = zip(*found.values())
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _streamed(rows: DataFrame, work, schema: str) -> DataFrame:
    unit = ["key", "q", "m"]
    return rows.repartition(parallel_parts(rows.sparkSession), *unit).sortWithinPartitions(*unit).mapInArrow(work, schema)


def links_between(shared: DataFrame, joined: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of classes in one bucket whose components differ: at least one for any two components that have one."""
    sizes = sets.select("class", (F.length("tokens") / 8).alias("tokens"))
    rows = shared.join(joined, "class", "left").select("key", "class", F.coalesce("part", "class").alias("part")).join(sizes, "class")
    mixed = rows.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("key")
    rows = durable(rows.join(mixed, "key"))
    per = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    whole = per.groupBy("key").agg(
        F.max_by("part", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.ceil(F.col("t") * n / F.col("n") / BLOCK_TOKENS)).cast("int")
    whole = whole.select("key", "main", blocks(F.col("n") - F.col("most")).alias("qs"), blocks(F.col("n")).alias("ms"))
    rows = rows.join(whole, "key").withColumn("h", F.xxhash64("class")).withColumn("in_main", F.col("part") == F.col("main"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kept = ["key", "q", "m", "class", "part", "is_query", "in_main"]
    asked = rows.filter("not in_main").withColumn("q", F.pmod("h", "qs").cast("int")).withColumn("m", every(F.col("ms")))
    held = rows.withColumn("m", F.pmod("h", "ms").cast("int")).withColumn("q", every(F.col("qs")))
    units = asked.withColumn("is_query", F.lit(True)).select(kept).unionByName(held.withColumn("is_query", F.lit(False)).select(kept))
    schema = "key bigint, q int, m int, class bigint, part bigint, is_query boolean, in_main boolean"
    signed = units.join(classes.select("class", "signature"), "class")
    involved = durable(_streamed(signed, _involved(least_matches(percent)), schema))
    return _streamed(involved.join(sets, "class"), _block_links(percent), "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    rows = id_text(docs)
    signed = durable(rows.mapInArrow(_sign(shingle), "doc_id bigint, n_shingles bigint, name decimal(38,0), signature binary"))
    classes = durable(signed.filter("n_shingles > 0").groupBy("name").agg(
        F.min("doc_id").alias("doc_id"), F.min("signature").alias("signature")
    ).withColumn("class", F.monotonically_increasing_id()))

    bands = classes.mapInArrow(_bands, "key bigint, class bigint")
    ranged = bands.repartitionByRange(parallel_parts(spark), "key", "class").sortWithinPartitions("key", "class")
    shared = durable(ranged.mapInArrow(_shared, "key bigint, class bigint"))
    hubs = shared.groupBy("key").agg(F.min("class").alias("hub"), F.max("class").alias("last")).filter("hub <> last")
    shared = durable(shared.join(hubs.select("key", "hub"), "key"))

    # Whole sets of the classes that share a bucket.
    chosen = shared.select("class").distinct().join(classes.select("class", "name", "doc_id"), "class")
    chosen = durable(chosen.select(F.col("doc_id").alias("id"), "class", "name"))
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    texts = rows.join(few, F.col("id").eqNullSafe(F.col("doc_id"))).select("doc_id", "text", "class", "name")
    sets = durable(texts.mapInArrow(_sets(shingle), "class bigint, tokens binary").dropDuplicates(["class"]))

    side = lambda table, name, value: table.select(F.col("class").alias(name), F.col(value).alias(f"{value}_{name}"))
    pairs = shared.filter("class <> hub").select(F.col("class").alias("u"), F.col("hub").alias("v")).distinct()
    pairs = pairs.join(side(classes, "u", "signature"), "u").join(side(classes, "v", "signature"), "v")
    alike = pairs.mapInArrow(_alike(least_matches(percent)), "u bigint, v bigint, matches bigint")
    best = alike.groupBy("u").agg(F.max_by("v", "matches").alias("v"))
    best = best.join(side(sets, "u", "tokens"), "u").join(side(sets, "v", "tokens"), "v")
    links = durable(best.mapInArrow(_verify(percent), "u bigint, v bigint"))
    joined = durable(components(links).select(F.col("node").alias("class"), F.col("component").alias("part")))

    more = durable(links_between(shared.select("key", "class"), joined, classes, sets, percent))
    final = durable(components(links.unionByName(more))).select(F.col("node").alias("class"), F.col("component").alias("whole"))
    tied = final.join(classes.select("class", "name", "doc_id"), "class")
    least = tied.groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    tied = tied.join(least, "whole").select("name", "component_id")
    out = signed.select("doc_id", "n_shingles", "name").join(
        classes.select("name", F.col("doc_id").alias("least")), "name", "left").join(tied, "name", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
