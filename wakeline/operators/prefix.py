"""Distributed prefix sums, exact quantiles and ranks over a total order.

Values are first reduced to one row for each distinct value, then cut into even
ranges of (key, value) by sampled splitters; sums inside a range are completed by
offsets, which only the groups that a splitter cuts need: at most two rows for
each range, summed apart and broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wakeline.functions.columns import hash_order
from wakeline.operators.ranges import RANGE, SPANS, placed, with_carry, with_range
from wakeline.params import Params
from wakeline.session import durable


def cumulative(
    table: DataFrame, value: str, measures: Sequence[str], p: Params,
    keys: Sequence[str] = (), descending: bool = False,
) -> DataFrame:
    """Add cum_<m> (inclusive) and total_<m> per key in the order of ``value``.

    ``table`` holds one row for each distinct (keys, value). Ranges are cut over (keys,
    value), so every key gets its share of them and a key of any size is split. The table
    is stored first: it is counted, sampled and read twice.
    """
    keys, table = list(keys), durable(table)
    groups = keys or ["_all"]
    work = table if keys else table.withColumn("_all", F.lit(0))
    cut, parts = with_range(work, [*groups, value], p, len(groups))
    inside = Window.partitionBy(RANGE, *groups)
    past = inside.orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = placed(cut, parts)
    for m in measures:
        out = out.withColumns({f"cum_{m}": F.sum(m).over(past), f"total_{m}": F.sum(m).over(inside)})
    group = Window.partitionBy(*groups)
    before = group.orderBy(F.desc(RANGE) if descending else F.asc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.filter(SPANS).groupBy(*groups, RANGE).agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    offsets = sums.select(
        *groups, RANGE,
        *[F.sum(f"_s_{m}").over(before).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(group).alias(f"_whole_{m}") for m in measures],
    )
    out = with_carry(out, offsets, groups)
    for m in measures:
        out = out.withColumns({
            f"cum_{m}": F.col(f"cum_{m}") + F.coalesce(f"_off_{m}", F.lit(0)),
            f"total_{m}": F.coalesce(f"_whole_{m}", f"total_{m}"),
        })
    return out.select(*table.columns, *[f"cum_{m}" for m in measures], *[f"total_{m}" for m in measures])


def quantiles(
    df: DataFrame, value: str, levels: Sequence[float], p: Params, keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linear quantiles: one row for each (keys, level) as (level, quantile).

    ``percentile`` would build a map of all distinct values in one task.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    ranked = cumulative(counts, value, ["cnt"], p, keys)
    level = F.explode(F.array(*[F.lit(float(q)) for q in levels])).alias("level")
    ranked = ranked.select("*", level).withColumn(
        "_at", (F.col("total_cnt") - 1) * F.col("level")
    )
    low, high = F.floor("_at"), F.ceil("_at")
    start = F.col("cum_cnt") - F.col("cnt")
    holds = lambda r: (start <= r) & (r < F.col("cum_cnt"))
    return (
        ranked.filter(holds(low) | holds(high))
        .groupBy(*keys, "level")
        .agg(
            F.min(F.when(holds(low), F.col(value))).alias("_lo"),
            F.max(F.when(holds(high), F.col(value))).alias("_hi"),
            F.first("_at").alias("_at"),
        )
        .select(
            *keys, "level",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at")))
            .alias("quantile"),
        )
    )


def order_statistics(
    df: DataFrame, value: str, levels: Sequence[float], p: Params, keys: Sequence[str], name: str
) -> DataFrame:
    """For each key the array of its values at rank ceil(level * n): values of the data, exact at any size."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    ranked = cumulative(counts, value, ["cnt"], p, keys)
    at = [F.min(F.when(F.col("cum_cnt") >= F.greatest(F.ceil(F.col("total_cnt") * q), F.lit(1)), F.col(value))) for q in levels]
    return ranked.groupBy(*keys).agg(F.array(*at).alias(name))


def hash_rank(ids: DataFrame, id_col: str, seed: int, rank: str = "rank", n: str = "n") -> DataFrame:
    """Rank distinct ids from 1 in md5 order, spread over 4096 even hash buckets."""
    keyed = ids.select(id_col).distinct().withColumn("_h", hash_order(seed, id_col)).withColumn(
        "_hb", F.substring("_h", 1, 3)
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("_hb").agg(F.count(F.lit(1)).alias("_size")).select(
        "_hb",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"),
        F.sum("_size").over(Window.partitionBy(F.lit(0))).alias(n),
    )
    inside = Window.partitionBy("_hb").orderBy("_h", id_col)
    return (
        keyed.withColumn(rank, F.row_number().over(inside))
        .join(F.broadcast(offsets), "_hb")  # at most 4096 rows
        .select(id_col, (F.col(rank) + F.col("_off")).cast("bigint").alias(rank), n)
    )


def global_row_index(
    df: DataFrame, us: str, ties: Sequence[str], p: Params, name: str = "row_index"
) -> DataFrame:
    """Number rows from 0 in the order of (us, ties) over the whole table.

    Ranges are cut over (us, ties, a hash of the row), so rows of one time are split
    like any others; a range's first number is the count of the ranges before it.
    """
    keys = [us, *ties, "_tie"]
    cut, parts = with_range(df.withColumn("_tie", F.xxhash64(*df.columns)), keys, p)
    past = Window.partitionBy(F.lit(0)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    offsets = cut.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_size")).select(
        RANGE, F.coalesce(F.sum("_size").over(past), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(RANGE).orderBy(*keys)
    numbered = with_carry(placed(cut, parts).withColumn("_rn", F.row_number().over(inside)), offsets, [])
    return numbered.withColumn(name, (F.col("_rn") - 1 + F.col("_off")).cast("bigint")).select(*df.columns, name)
