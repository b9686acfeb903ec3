"""Forward filter of a two-state chain over a score, per vessel.

One step is linear in (s, 1 - s) before it is normalised, so a stretch of rows
folds into a 2x2 matrix and matrices compose. A vessel may be cut by the range
splitters: fold each of its ranges, run over the few matrices, then replay every
range from its own start state. Inside a task, whole Arrow batches are scanned:
a null score is the identity and a vessel's first score a constant map, so no
step loops over rows. The start of a vessel is its first non-null score; a null
score keeps the state and stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wakeline.operators.ranges import RANGE, SPANS, placed, with_carry
from wakeline.operators.slices import TIE, US, timed, track_ranges
from wakeline.params import MMSI, REGIME, REGIME_MARKOV, REGIME_SMOOTHED, Params

# Fixed value: guard of the normalising division.
DENOMINATOR_GUARD = 1e-12
LOT = 100_000  # rows that a task scans at once


def _replay(scores: list, state: float | None, p00: float, p11: float) -> list:
    out = []
    for q in scores:
        if q is None or q != q:
            out.append(None)
            continue
        if state is None:
            state = q
        else:
            up = q * (state * p00 + (1 - state) * (1 - p11))
            down = (1 - q) * (state * (1 - p00) + (1 - state) * p11)
            state = up / (up + down + DENOMINATOR_GUARD)
        out.append(state)
    return out


def _stochastic(p00: float, p11: float) -> bool:
    """Whether both weights of a step stay above zero, so that matrices compose without loss."""
    return 0.0 < p00 < 1.0 and 0.0 < p11 < 1.0


def _steps(q, reset, p00: float, p11: float):
    """The entries a, b, c, d of each row's matrix (a b / c d); a row without a score changes nothing.

    ``reset`` holds the state that a row starts with, or NaN: its matrix gives that state
    whatever came before, so vessels need no marks of their own.
    """
    idle, fresh = np.isnan(q), ~np.isnan(reset)
    out = []
    for entry, hold, start in (
        (q * p00, 1.0, reset), (q * (1 - p11), 0.0, reset), ((1 - q) * (1 - p00), 0.0, 1 - reset), ((1 - q) * p11, 1.0, 1 - reset),
    ):
        entry = np.where(idle, hold, entry)
        out.append(np.where(fresh, start, entry))
    return out


def _folded(steps) -> tuple[float, float, float, float]:
    """Product of all matrices, the last on the left, by halves; scaled to a largest entry of one."""
    a, b, c, d = steps
    while len(a) > 1:
        if len(a) % 2:  # an identity makes the number even
            a, b, c, d = (np.append(x, e) for x, e in zip((a, b, c, d), (1.0, 0.0, 0.0, 1.0)))
        (a0, b0, c0, d0), (a1, b1, c1, d1) = ([x[k::2] for x in (a, b, c, d)] for k in (0, 1))
        a, b, c, d = a1 * a0 + b1 * c0, a1 * b0 + b1 * d0, c1 * a0 + d1 * c0, c1 * b0 + d1 * d0
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        top[top == 0] = 1.0
        a, b, c, d = a / top, b / top, c / top, d / top
    return (float(a[0]), float(b[0]), float(c[0]), float(d[0])) if len(a) else (1.0, 0.0, 0.0, 1.0)


def _moved(state: float, m) -> float:
    a, b, c, d = m
    up, down = a * state + b * (1 - state), c * state + d * (1 - state)
    return up / (up + down) if up + down else 0.0


def _scan(q, reset, state: float, p00: float, p11: float):
    """The state after every row, from the state before the first (NaN where there is none).

    Rows are laid out as about sqrt(n) stretches of equal length. Matrices of all stretches
    are composed side by side, the stretches' first states follow from one short walk,
    and the filter's own step then runs over all stretches side by side.
    """
    n = len(q)
    long = max(1, int(np.ceil(np.sqrt(n))))
    wide = -(-n // long)
    lay = lambda x: np.append(x, np.full(wide * long - n, np.nan)).reshape(wide, long).T.copy()
    q, reset = lay(q), lay(reset)
    a, b, c, d = _steps(q, reset, p00, p11)
    total = [np.ones(wide), np.zeros(wide), np.zeros(wide), np.ones(wide)]
    for t in range(long):
        ta, tb, tc, td = total
        total = [a[t] * ta + b[t] * tc, a[t] * tb + b[t] * td, c[t] * ta + d[t] * tc, c[t] * tb + d[t] * td]
        if t % 16 == 15:  # far from underflow
            top = np.maximum(np.maximum(total[0], total[1]), np.maximum(total[2], total[3]))
            total = [x / np.where(top > 0, top, 1.0) for x in total]
    begun = np.logical_or.accumulate(~np.isnan(reset).all(0))
    first = np.empty(wide)
    for k in range(wide):
        first[k] = state
        if not np.isnan(state) or begun[k]:
            state = _moved(0.5 if np.isnan(state) else state, [x[k] for x in total])
    out, s = np.empty((long, wide)), first
    for t in range(long):
        up = q[t] * (s * p00 + (1 - s) * (1 - p11))
        down = (1 - q[t]) * (s * (1 - p00) + (1 - s) * p11)
        s = np.where(np.isnan(q[t]), s, up / (up + down + DENOMINATOR_GUARD))
        s = np.where(np.isnan(reset[t]), s, reset[t])
        out[t] = s
    return out.T.ravel()[:n]


def _filtered(q, vessel, carry, last, p00: float, p11: float):
    """(state after every row, last vessel and its state) of rows sorted by vessel and time.

    ``carry`` holds a vessel's state before its first row here, or NaN; ``last`` is what
    the rows before this lot ended with.
    """
    n = len(q)
    change = np.r_[last[0] != vessel[0], vessel[1:] != vessel[:-1]]
    group = np.cumsum(change)  # 0 for rows of the vessel that goes on
    scored = np.flatnonzero(~np.isnan(q))
    heads, at = np.unique(group[scored], return_index=True)
    at = scored[at]  # first score of each vessel here
    known = last[1] if not change[0] else np.nan
    reset = np.full(n, np.nan)
    begin = at[(heads > 0) | np.isnan(known)]
    before = np.where(group[begin] > 0, carry[begin], np.nan)
    up = q[begin] * (before * p00 + (1 - before) * (1 - p11))
    down = (1 - q[begin]) * (before * (1 - p00) + (1 - before) * p11)
    reset[begin] = np.where(np.isnan(before), q[begin], up / (up + down + DENOMINATOR_GUARD))
    if _stochastic(p00, p11):
        state = _scan(q, reset, known, p00, p11)
    else:  # a chain that cannot move: the guard decides, step by step
        state, s = np.empty(n), known
        for k in range(n):
            if not np.isnan(reset[k]):
                s = reset[k]
            elif not np.isnan(q[k]):
                s = _replay([q[k]], s, p00, p11)[0]
            state[k] = s
    # a vessel whose rows here have no score yet passes its carry on
    tail = np.searchsorted(group, group[-1])
    none = not (~np.isnan(q[tail:])).any()
    end = (carry[-1] if group[-1] > 0 else known) if none else state[-1]
    return np.where(np.isnan(q), np.nan, state), (vessel[-1], end)


def _columns(batch, score: str):
    q = batch[score].to_numpy(zero_copy_only=False).astype(np.float64)
    return q, batch[MMSI].to_numpy(zero_copy_only=False)


def _piece_states(cut: DataFrame, parts: int, score: str, p00: float, p11: float) -> DataFrame:
    """(MMSI, range, _state): the state before the first row of each range of a cut vessel.

    A range is read twice only where a splitter cuts its vessel; it sends one row: its
    first score and the product of the matrices behind that score.
    """
    fold_schema = f"{MMSI} long, {RANGE} int, q double, a double, b double, c double, d double"
    state_schema = f"{MMSI} long, {RANGE} int, _state double"

    def fold(batches):
        key, first, m = None, None, (1.0, 0.0, 0.0, 1.0)
        for batch in batches:
            q, vessel = _columns(batch, score)
            part = batch[RANGE].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (vessel[1:] != vessel[:-1]) | (part[1:] != part[:-1])]) if len(q) else []
            for i, j in zip(cuts, [*cuts[1:], len(q)]):
                here, scores = (int(vessel[i]), int(part[i])), q[i:j]
                if here != key:
                    if key is not None:
                        yield _batch([(*key, first, *m)], fold_schema)
                    key, first, m = here, None, (1.0, 0.0, 0.0, 1.0)
                scores = scores[~np.isnan(scores)]
                if first is None and len(scores):
                    first, scores = float(scores[0]), scores[1:]
                steps = _steps(scores, np.full(len(scores), np.nan), p00, p11)
                m = _folded([np.array([x, y]) for x, y in zip(m, _folded(steps))])
        if key is not None:
            yield _batch([(*key, first, *m)], fold_schema)

    def run(batches):
        """The state before each range of a vessel, range by range: at most as many as there are ranges."""
        vessel, state = None, None
        for batch in batches:
            out = []
            for v, part, q, *m in zip(*[batch[i].to_pylist() for i in range(7)]):
                if v != vessel:
                    vessel, state = v, None
                out.append((v, part, state))
                if q is not None:
                    state = _moved(_replay([q], state, p00, p11)[0], m)
            if out:
                yield _batch(out, state_schema)

    order = [RANGE, MMSI, US, TIE]
    rows = placed(cut.filter(SPANS).select(*order, score), parts).sortWithinPartitions(*order)
    folded = rows.mapInArrow(fold, fold_schema)
    return folded.repartition(MMSI).sortWithinPartitions(MMSI, RANGE).mapInArrow(run, state_schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    names, types = zip(*[(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))


def _lots(batches, rows: int):
    """Arrow batches joined to lots of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def markov_filter(
    df: DataFrame, p: Params, score: str = REGIME, out: str = REGIME_MARKOV,
    p_00: float | None = None, p_11: float | None = None, bounded: bool = False,
) -> DataFrame:
    p00 = p.p_00 if p_00 is None else p_00
    p11 = p.p_11 if p_11 is None else p_11
    base = df.drop(out).withColumn(score, F.col(score).cast("double"))
    kept = [c for c in df.columns if c != out]
    if bounded:
        work = timed(base, p).withColumn("_state", F.lit(None).cast("double"))
        order = [MMSI, US, TIE]
        work = work.repartition(MMSI).sortWithinPartitions(*order)
    else:
        cut, parts = track_ranges(base, p)
        order = [RANGE, MMSI, US, TIE]
        work = placed(cut, parts) if parts > 1 else cut.repartition(MMSI)
        if parts > 1:
            work = with_carry(work, _piece_states(cut, parts, score, p00, p11), [MMSI])
        else:
            work = work.withColumn("_state", F.lit(None).cast("double"))
        work = work.sortWithinPartitions(*order)

    def replay(batches):
        last = (None, np.nan)
        for batch in _lots(batches, LOT):
            q, vessel = _columns(batch, score)
            carry = batch["_state"].to_numpy(zero_copy_only=False).astype(np.float64)
            values, last = _filtered(q, vessel, carry, last, p00, p11)
            arrays = [batch[c] for c in kept] + [pa.array(values, pa.float64(), mask=np.isnan(values))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, out])

    schema = T.StructType([work.schema[c] for c in kept] + [T.StructField(out, T.DoubleType())])
    return work.select(*dict.fromkeys([*kept, *order, "_state"])).mapInArrow(replay, schema)


def markov_sym(
    df: DataFrame, p: Params, p_stay: float, score: str = REGIME, out: str = REGIME_SMOOTHED,
    bounded: bool = False,
) -> DataFrame:
    """The same filter with one probability of staying in either state."""
    return markov_filter(df, p, score, out, p_stay, p_stay, bounded)
