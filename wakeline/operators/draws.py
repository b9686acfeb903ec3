"""Score-ordered metrics of many resamples at once.

A row is a distinct (model, score), or (model, score, vessel); its weights in all draws
are a vector that a task makes when it reads the row. Rows are shuffled once, into even
ranges of (model, score), sorted and stored as packed arrays, whatever the number of
draws; each block of draws reads those. A first pass sums each range,
offsets follow from those sums, and a second pass runs down the scores with element-wise
running sums, over scores that add a term; others are summed into the next one. The driver
sees one vector for each (range, model) and draw block.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.functions.columns import md5_integers
from wakeline.operators.prefix import hash_rank
from wakeline.operators.ranges import RANGE, placed, with_range
from wakeline.params import MMSI, Params
from wakeline.session import durable

VALUES = 2_000_000  # weights of a range, about: with 1,000 draws a range has some 2,000 rows
CHUNK = 1_000_000  # weights made at once
TIMES_BYTES = 64_000_000  # of the vessels' weights that are broadcast; more draws are done in blocks
PACKED = {"score": "<f8", "pos": "<i8", "neg": "<i8", "unit": "<i8"}


def _ap(pos, neg, tp, fp):
    seen = tp + fp
    return pos * np.divide(tp, seen, out=np.zeros_like(seen), where=seen > 0)


def _auc(pos, neg, tp, fp):
    return neg * (tp - pos / 2.0)


# name -> (term of one score, divisor from the totals, rows without which a score adds no term; None: all scores add one)
METRICS = {
    "average_precision": (_ap, lambda n_pos, n_neg: n_pos, "pos"),
    "roc_auc": (_auc, lambda n_pos, n_neg: n_pos * n_neg, None),
}


@dataclass
class Rows:
    score: np.ndarray
    pos: np.ndarray
    neg: np.ndarray
    unit: np.ndarray


class PoissonWeights:
    """Row bootstrap: n equal rows weigh Poisson(n) in a draw; seeded by the score, so a retry repeats it."""

    def __init__(self, seed: int, draws: int):
        self.seed, self.draws = seed, draws

    def __call__(self, rows: Rows, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of positives and negatives, summed over the stretches of rows that begin at ``starts``."""
        scores = rows.score.view(np.uint64)
        out = []
        for kind, n in enumerate((rows.pos.astype(np.float64), rows.neg.astype(np.float64))):
            drawn = np.zeros((len(n), self.draws))
            for k in np.flatnonzero(n):
                key = np.array([scores[k], 2 * self.seed + kind], np.uint64)
                drawn[k] = np.random.Generator(np.random.Philox(key=key)).poisson(n[k], self.draws)
            out.append(_stretches(drawn, starts))
        return out[0], out[1]


class VesselWeights:
    """Vessel bootstrap: a row weighs as often as its vessel was drawn."""

    def __init__(self, times, most: int):
        self.times, self.most = times, most  # broadcast matrix, vessel number by draw, and its largest value

    def _sums(self, rows: Rows, at: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
        # single precision is exact for whole numbers up to 2^24
        kind = np.float32 if float(n.sum()) * self.most < 1 << 24 else np.float64
        weights = self.times.value.take(rows.unit[at], 0).astype(kind)
        if (n != 1).any():
            weights *= n.astype(kind)[:, None]
        return _stretches(weights, starts)

    def __call__(self, rows: Rows, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = self._sums(rows, np.arange(len(rows.pos)), rows.pos + rows.neg, starts)
        pos, at = np.zeros_like(every), np.flatnonzero(rows.pos)
        if len(at):
            where = np.searchsorted(starts, at, side="right") - 1
            first = np.flatnonzero(np.diff(where, prepend=-1))
            pos[where[first]] = self._sums(rows, at, rows.pos[at], first)
        return pos, every - pos


def _stretches(weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of each stretch, in double precision."""
    out = np.empty((len(starts), weights.shape[1]))
    ones = np.ones(len(weights), weights.dtype)
    for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(weights)])):
        out[k] = weights[a] if b == a + 1 else ones[: b - a] @ weights[a:b]
    return out


def _pack(batches):
    """Sorted rows as arrays, one record for each stretch of a batch within one range and model."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, models = batch.column(RANGE).to_numpy(), batch.column("model").dictionary_encode()
        code = models.indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (code[1:] != code[:-1])])
        values = {c: batch.column(c).to_numpy().astype(kind) for c, kind in PACKED.items()}
        ends = [*cuts[1:].tolist(), len(parts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts[cuts], pa.int32()), models.dictionary.take(models.indices.take(pa.array(cuts))),
             *[pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for v in values.values()]],
            ["range", "model", *PACKED])


def arranged(counts: DataFrame, draws: int, p: Params) -> DataFrame:
    """Rows in ranges of (model, score), scores falling, stored as packed arrays. counts: model, score, pos, neg, unit."""
    cut, parts = with_range(counts, ["model", "score"], replace(p, range_rows=max(1, VALUES // draws)))
    rows = placed(cut, parts) if parts > 1 else cut.coalesce(1)
    falling = rows.select(RANGE, "model", *PACKED).sortWithinPartitions(RANGE, "model", F.desc("score"))
    kinds = ", ".join(f"{c} binary" for c in PACKED)
    return durable(falling.mapInArrow(_pack, f"range int, model string, {kinds}"))


def _chunks(batches, draws: int):
    """((range, model), rows) of bounded size."""
    step = max(1, CHUNK // draws)
    for batch in batches:
        for r in batch.to_pylist():
            held = {c: np.frombuffer(r[c], kind) for c, kind in PACKED.items()}
            for a in range(0, len(held["score"]), step):
                yield (r["range"], r["model"]), Rows(**{c: v[a : a + step] for c, v in held.items()})


def _emit(part: int, model: str, *vectors) -> pa.RecordBatch:
    names = ["range", "model", *[f"v{k}" for k in range(len(vectors))]]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([model]), *[pa.array([v.astype("<f8").tobytes()], pa.binary()) for v in vectors]], names)


def _range_sums(weigh, draws: int):
    def run(batches):
        sums: dict[tuple[int, str], list[np.ndarray]] = {}
        for key, rows in _chunks(batches, draws):
            total = sums.setdefault(key, [np.zeros(draws), np.zeros(draws)])
            for t, w in zip(total, weigh(rows, np.zeros(1, np.int64))):
                t += w[0]
        for (part, model), total in sums.items():
            yield _emit(part, model, *total)

    return run


def _terms(weigh, draws: int, term, marks: str | None, above):
    """Sum of the metric's terms over each (range, model); rows come by range and model, scores falling."""

    def run(batches):
        key = score = marked = tp = fp = total = None
        held = None  # sums of the last scores, which the next chunk may go on with

        def close(pos, neg):
            nonlocal tp, fp, total
            up, down = tp + np.cumsum(pos, axis=0), fp + np.cumsum(neg, axis=0)
            total = total + term(pos, neg, up, down).sum(axis=0)
            tp, fp = up[-1], down[-1]

        for here, rows in _chunks(batches, draws):
            if here != key and key is not None:
                close(*held)
                yield _emit(*key, total)
            if here != key:
                key, held, total = here, None, np.zeros(draws)
                tp, fp = above.value[here]
            groups = np.flatnonzero(np.r_[True, rows.score[1:] != rows.score[:-1]])
            adds = np.ones(len(groups), bool) if marks is None else np.logical_or.reduceat(getattr(rows, marks) != 0, groups)
            if held is not None and rows.score[0] == score:
                adds[0] |= marked
            elif held is not None and marked:
                close(*held)
                held = None
            # a stretch ends with a score that adds a term
            pos, neg = weigh(rows, groups[np.r_[True, adds[:-1]]])
            if held is not None:
                pos[0] += held[0][0]
                neg[0] += held[1][0]
            if len(pos) > 1:
                close(pos[:-1], neg[:-1])
            held, score, marked = (pos[-1:].copy(), neg[-1:].copy()), rows.score[-1], adds[-1]
        if key is not None:
            close(*held)
            yield _emit(*key, total)

    return run


def _collected(df: DataFrame) -> dict:
    """{(range, model): vectors}: as many rows as ranges and models."""
    out = {}
    for r in df.collect():
        out[r["range"], r["model"]] = [np.frombuffer(v, "<f8") for v in r[2:]]
    return out


def resampled_metrics(rows: DataFrame, weigh, draws: int, metric: str) -> dict[str, np.ndarray]:
    """{model: value in each draw}, NaN where a draw lacks a class, of rows as arranged()."""
    term, divisor, marks = METRICS[metric]
    context = rows.sparkSession.sparkContext
    sums = _collected(rows.mapInArrow(_range_sums(weigh, draws), "range int, model string, v0 binary, v1 binary"))
    above, whole = {}, {}
    for part, model in sorted(sums, reverse=True):
        held = whole.setdefault(model, [np.zeros(draws), np.zeros(draws)])
        above[part, model] = tuple(held)
        whole[model] = [h + s for h, s in zip(held, sums[part, model])]
    shared = context.broadcast(above)
    terms = _collected(rows.mapInArrow(_terms(weigh, draws, term, marks, shared), "range int, model string, v0 binary"))
    shared.unpersist()
    out = {}
    for model, (n_pos, n_neg) in whole.items():
        total = sum(v[0] for (_, m), v in sorted(terms.items()) if m == model)
        both = (n_pos > 0) & (n_neg > 0)
        out[model] = np.where(both, total / np.where(both, divisor(n_pos, n_neg), 1.0), np.nan)
    return out


def vessel_times(spark: SparkSession, n: int, seed: int, first: int, draws: int) -> np.ndarray:
    """(vessel number, draw): how often each vessel is drawn in draws first, first + 1, ...

    A draw takes n vessels with replacement; pick i of draw d is vessel number
    md5(seed, d, i) mod n. A task counts the picks of whole draws; nothing is shuffled.
    """
    def count(batches):
        for batch in batches:
            for d in batch.column("id").to_pylist():
                times = np.zeros(n, np.int64)
                for a in range(0, n, 1 << 20):
                    np.add.at(times, md5_integers(f"{seed}-{d}-", a, min(n, a + (1 << 20))) % n, 1)
                kept = times.astype(np.min_scalar_type(times.max()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int64()), pa.array([kept.dtype.str]), pa.array([kept.tobytes()], pa.binary())], ["d", "kind", "v"])

    tasks = min(draws, 4 * spark.sparkContext.defaultParallelism)
    out = np.zeros((draws, n), np.uint8)
    for r in spark.range(first, first + draws, 1, tasks).mapInArrow(count, "d bigint, kind string, v binary").toLocalIterator():
        times = np.frombuffer(r["v"], r["kind"])
        out = out.astype(np.promote_types(out.dtype, times.dtype), copy=False)
        out[r["d"] - first] = times
    return np.ascontiguousarray(out.T)


def vessel_metrics(counts: DataFrame, p: Params, n_draws: int, metric: str) -> dict[str, np.ndarray]:
    """Metrics of a bootstrap over whole vessels; all models share every draw. counts: MMSI, model, score, pos, neg.

    Draws are done in blocks whose vessel weights, a byte each, fit TIMES_BYTES.
    """
    spark = counts.sparkSession
    counts = durable(counts)
    ranked = durable(hash_rank(counts.select(MMSI), MMSI, p.seed, rank="_rank", n="_n").select(
        MMSI, (F.col("_rank") - 1).alias("_i")))
    n = ranked.count()
    if n == 0:
        return {}
    few = F.broadcast(ranked) if n <= p.broadcast_rows else ranked.hint("merge")
    block = max(1, min(n_draws, TIMES_BYTES // n))
    rows = durable(counts.join(few, MMSI).select("model", F.col("score").cast("double").alias("score"), "pos", "neg", F.col("_i").alias("unit")))
    rows = arranged(rows, block, p)
    found: dict[str, list[np.ndarray]] = {}
    for first in range(0, n_draws, block):
        size = min(block, n_draws - first)
        matrix = vessel_times(spark, n, p.seed, first, size)
        times = spark.sparkContext.broadcast(matrix)
        for model, values in resampled_metrics(rows, VesselWeights(times, int(matrix.max())), size, metric).items():
            found.setdefault(model, []).append(values)
        times.unpersist()
    return {model: np.concatenate(values) for model, values in found.items()}


def row_metrics(counts: DataFrame, p: Params, n_draws: int, metric: str) -> np.ndarray:
    """Metric in each draw of a bootstrap over rows. counts: score, pos, neg."""
    rows = durable(counts.select(
        F.lit("all").alias("model"), F.col("score").cast("double").alias("score"), "pos", "neg", F.lit(0).alias("unit")))
    found = resampled_metrics(arranged(rows, n_draws, p), PoissonWeights(p.seed, n_draws), n_draws, metric)
    return found.get("all", np.full(n_draws, np.nan))
