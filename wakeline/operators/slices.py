"""Ordered operators over vessel tracks that survive a hot vessel.

A window over the vessel key alone puts one vessel into one task. On raw pings
a single identifier may hold a third of all rows, even all in one hour, so the
operators here cut the whole table into even ranges of (vessel, time, input order)
with sampled splitters. Rows are shuffled once, each range into a task of its
own; a vessel that a splitter cuts has one carry row for each of its ranges, and
those rows, at most two for each range, are broadcast.

A table that was downsampled first holds at most span / bin width rows for each
vessel. For such tables ``bounded=True`` picks the plain vessel window, which
needs one shuffle and no carry.

A table that ``by_track`` has placed keeps its layout through these operators, so
several of them share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions.columns import micros, row_order
from wakeline.operators.ranges import RANGE, SPANS, placed, with_carry, with_range
from wakeline.params import MMSI, TIMESTAMP, Params

US, TIE = "_us", "_tie"
LAYOUT = (US, TIE, RANGE, SPANS)


def timed(df: DataFrame, p: Params) -> DataFrame:
    """Add the time in microseconds and what orders rows of one time: the input order, or a hash of the row."""
    tie = F.col(p.seq_col).cast("bigint") if p.seq_col in df.columns else F.xxhash64(*df.columns)
    return df.withColumn(US, micros(TIMESTAMP)).withColumn(TIE, tie)


def track_ranges(df: DataFrame, p: Params) -> tuple[DataFrame, int]:
    """Rows with their range, not shuffled yet, and the number of ranges."""
    return with_range(timed(df, p), [MMSI, US, TIE], p, groups=1)


def by_track(df: DataFrame, p: Params) -> DataFrame:
    """Rows in the partition of their range, with the columns of the layout."""
    return placed(*track_ranges(df, p))


def without_layout(df: DataFrame) -> DataFrame:
    return df.drop(*LAYOUT)


def _rows_window(bounded: bool):
    return Window.partitionBy(*([MMSI] if bounded else [RANGE, MMSI])).orderBy(US, TIE)


def _layout(df: DataFrame, p: Params, bounded: bool) -> tuple[DataFrame, DataFrame, bool, bool]:
    """(rows in their partitions, the same rows to take carries from, whether the layout was there, whether
    the plain vessel window does: for bounded vessels, and for a table of one range)."""
    if bounded:
        return timed(df, p), df, False, True
    if RANGE in df.columns:
        return df, df, True, False
    cut, parts = track_ranges(df, p)
    return placed(cut, parts), cut, False, parts == 1


def _kept(df: DataFrame, leave: set, laid: bool) -> list[str]:
    return [c for c in df.columns if c not in leave and (laid or c not in LAYOUT)]


def _pack(names) -> Column:
    return F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])


def _edge(pick, names, tag: str) -> list[Column]:
    """The named values of the first or last row of a vessel's range, one hash aggregate each."""
    return [pick(c, row_order(US, TIE)).alias(f"_{tag}{i}") for i, c in enumerate(names)]


def _edge_pack(names, tag: str) -> Column:
    return F.struct(*[F.col(f"_{tag}{i}").alias(f"v{i}") for i, _ in enumerate(names)])


def _across():
    return Window.partitionBy(MMSI).orderBy(RANGE)


def join_vessels(df: DataFrame, per_vessel: DataFrame, p: Params, how: str = "inner") -> DataFrame:
    """Join vessel-level values to rows on (vessel, salt).

    The vessel list is repeated ``salts`` times, which is small next to the
    rows, and a vessel with a third of all rows is spread over as many tasks.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(TIMESTAMP), F.lit(p.salts)).cast("int"))
    spread = per_vessel.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    return salted.join(spread, [MMSI, "_salt"], how).drop("_salt")


def neighbours(
    df: DataFrame, p: Params, prev: dict | None = None, nxt: dict | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add values of the vessel's previous and next row: {new name: source column}."""
    prev, nxt = prev or {}, nxt or {}
    work, source, laid, bounded = _layout(df, p, bounded)
    rows = _rows_window(bounded)
    if prev:
        work = work.withColumn("_before", F.lag(_pack(prev.values())).over(rows))
    if nxt:
        work = work.withColumn("_after", F.lead(_pack(nxt.values())).over(rows))
    if not bounded:
        carried, cols = [], []
        if prev:
            carried += _edge(F.max_by, prev.values(), "tail")
            cols.append(F.lag(_edge_pack(prev, "tail")).over(_across()).alias("_carry_before"))
        if nxt:
            carried += _edge(F.min_by, nxt.values(), "head")
            cols.append(F.lead(_edge_pack(nxt, "head")).over(_across()).alias("_carry_after"))
        edges = source.filter(SPANS).groupBy(MMSI, RANGE).agg(*carried).select(MMSI, RANGE, *cols)
        work = with_carry(work, edges, [MMSI])
        if prev:
            work = work.withColumn("_before", F.coalesce("_before", "_carry_before"))
        if nxt:
            work = work.withColumn("_after", F.coalesce("_after", "_carry_after"))
    added = [F.col(f"_before.v{i}").alias(n) for i, n in enumerate(prev)]
    added += [F.col(f"_after.v{i}").alias(n) for i, n in enumerate(nxt)]
    return work.select(*_kept(df, {*prev, *nxt}, laid), *added)


def positions(
    df: DataFrame, p: Params, rn: str = "rn", n: str = "n", bounded: bool = False
) -> DataFrame:
    """Add the row number inside the vessel (from 1) and the vessel's row count."""
    work, source, laid, bounded = _layout(df, p, bounded)
    group = Window.partitionBy(*([MMSI] if bounded else [RANGE, MMSI]))
    work = work.withColumn(rn, F.row_number().over(_rows_window(bounded)).cast("bigint"))
    work = work.withColumn(n, F.count(F.lit(1)).over(group))
    if not bounded:
        edges = source.filter(SPANS).groupBy(MMSI, RANGE).agg(F.count(F.lit(1)).alias("_size")).select(
            MMSI, RANGE,
            F.coalesce(
                F.sum("_size").over(_across().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
            F.sum("_size").over(Window.partitionBy(MMSI)).alias("_whole"),
        )
        work = with_carry(work, edges, [MMSI]).withColumn(rn, F.col(rn) + F.coalesce("_offset", F.lit(0)))
        work = work.withColumn(n, F.coalesce("_whole", n))
    return work.select(*_kept(df, {rn, n}, laid), rn, n)


def next_time(
    df: DataFrame, p: Params, condition: Column, name: str, bounded: bool = False
) -> DataFrame:
    """Add the time (microseconds) of the first later row meeting the condition.

    "Later" is strict. The frame runs over descending time, so it grows by one
    row at a time instead of being rebuilt for each row.
    """
    work, source, laid, bounded = _layout(df, p, bounded)
    event = F.when(condition, F.col(US))
    keys = [MMSI] if bounded else [RANGE, MMSI]
    later = Window.partitionBy(*keys).orderBy("_down").rangeBetween(Window.unboundedPreceding, -1)
    work = work.withColumn("_event", event).withColumn("_down", -F.col(US))
    work = work.withColumn("_next", F.min("_event").over(later))
    if not bounded:
        edges = _later_events(source.withColumn("_event", event))
        work = with_carry(work, edges, [MMSI])
        # rows of a range's last time may have rows of the same time in the next range
        beyond = F.when(F.col(US) < F.col("_end"), F.col("_any")).otherwise(F.col("_strict"))
        work = work.withColumn("_next", F.coalesce("_next", beyond))
    return work.select(*_kept(df, {name}, laid), F.col("_next").alias(name))


def _later_events(events: DataFrame) -> DataFrame:
    """For each range of a cut vessel: its last time, the first event of later ranges, and the first after that time.

    Only rows of one time can lie on both sides of a splitter, so among later ranges
    those that begin with the last time matter: there the first event after their first
    time counts, elsewhere any event.
    """
    rows = events.filter(SPANS)
    pieces = rows.groupBy(MMSI, RANGE).agg(
        F.min(US).alias("_begin"), F.max(US).alias("_end"), F.min("_event").alias("_first"),
    )
    # the first event after the range's first time
    starts = with_carry(rows, pieces.select(MMSI, RANGE, "_begin"), [MMSI])
    after = starts.filter(F.col(US) > F.col("_begin")).groupBy(MMSI, RANGE).agg(F.min("_event").alias("_inner"))
    pieces = pieces.join(after, [MMSI, RANGE], "left")
    onward = _across().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    alike = Window.partitionBy(MMSI, "_begin").orderBy(RANGE).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    beyond = Window.partitionBy(MMSI).orderBy("_begin").rangeBetween(1, Window.unboundedFollowing)
    pieces = pieces.select(
        "*", F.min("_first").over(onward).alias("_from"),
        F.least(F.min("_inner").over(alike), F.min("_first").over(beyond)).alias("_past"),
    )
    ahead = lambda c: F.lead(c).over(_across())
    return pieces.select(
        MMSI, RANGE, "_end", ahead("_from").alias("_any"),
        F.when(ahead("_begin") > F.col("_end"), ahead("_from")).otherwise(ahead("_past")).alias("_strict"),
    )
