"""Total orders cut into even ranges by sampled splitters.

``with_range`` numbers every row with its range in the order of some key columns. The
splitters come from a sample drawn by a hash of the keys, at a rate that follows the row
count, so they are the same in every branch of a plan and after a retry. A row finds
its range by binary search in the array of splitters, a constant. ``placed`` then
sends each range to a partition of its own: windows over (range, group) need no further
shuffle, no two ranges share a task, and a group of any size is cut like any other
stretch of rows.

A group (the first key columns) that a splitter cuts is marked ``_spans``. Each splitter
cuts one group at most, so (group, range) pairs of cut groups number at most twice the
ranges; what such pairs carry to each other fits a broadcast of that proven size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wakeline.functions.columns import hash_uniform
from wakeline.params import Params

RANGE, SPANS = "_range", "_spans"
SAMPLE = 100  # rows of the sample for each range
SEED = 71


def range_count(df: DataFrame) -> int:
    """Ranges are at most the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _splitters(df: DataFrame, keys: Sequence[str], p: Params) -> tuple[Column, int]:
    """(array of structs of the keys in order, ranges): one splitter less than min(n, rows / range_rows) ranges.

    They are found while the plan is built, by one job that counts and one that reads the
    keys, as Spark's own range partitioner samples before a shuffle, and enter the plan
    as one constant.
    """
    narrow = df.select(*keys)
    rows = narrow.count()
    parts = max(1, min(range_count(df), -(-rows // p.range_rows)))
    kind = T.ArrayType(narrow.select(F.struct(*keys).alias("k")).schema["k"].dataType)
    if parts == 1:
        return F.from_json(F.lit("[]"), kind), 1
    sample = narrow.filter(hash_uniform(SEED, *keys) < parts * SAMPLE / rows).select(F.struct(*keys).alias("k"))
    ordered = sample.agg(F.sort_array(F.collect_list("k")).alias("s"))  # about parts * SAMPLE keys
    picked = F.transform(
        F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / parts).cast("int")))
    cuts = F.array_distinct(F.filter(picked, lambda c: c.isNotNull()))
    return F.from_json(F.lit(ordered.select(F.to_json(cuts)).first()[0]), kind), parts


def with_range(df: DataFrame, keys: Sequence[str], p: Params, groups: int = 0) -> tuple[DataFrame, int]:
    """(rows with their range and whether their group, the first ``groups`` keys, is cut; number of ranges).

    A table of at most ``range_rows`` rows is one range.
    """
    cuts, parts = _splitters(df, keys, p)
    if parts == 1:
        return df.withColumns({RANGE: F.lit(0), SPANS: F.lit(False)}), 1
    key = F.struct(*keys)
    # how many splitters are at most the key: halving steps, past the end there is none
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length()))])
    below = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= key, at + step).otherwise(at))
    # one element exploded keeps the search from being repeated where the range is used
    work = df.withColumn(RANGE, F.explode(F.array(below)))
    spans = F.lit(False)
    for place in (F.col(RANGE) - 1, F.col(RANGE)) if groups else ():
        cut = F.get(cuts, place)
        same = cut.isNotNull()
        for k in keys[:groups]:
            same = same & cut[k].eqNullSafe(F.col(k))
        spans = spans | same
    return work.withColumn(SPANS, spans), parts


def placed(cut: DataFrame, parts: int) -> DataFrame:
    """Every range in its own partition; one range is left to the shuffle by group that a window asks for."""
    return cut if parts == 1 else cut.repartitionById(parts, F.col(RANGE))


def with_carry(rows: DataFrame, carry: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join what (group, range) pairs of cut groups carry; at most twice the ranges' rows are broadcast.

    Groups meet by null-safe equality; rows of other groups get nulls.
    """
    renamed = carry.select(
        *[F.col(g).alias(f"_c_{g}") for g in groups], F.col(RANGE).alias("_c_range"),
        *[c for c in carry.columns if c not in (*groups, RANGE)],
    )
    same = F.col(RANGE) == F.col("_c_range")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    return rows.join(F.broadcast(renamed), same, "left").drop("_c_range", *[f"_c_{g}" for g in groups])
