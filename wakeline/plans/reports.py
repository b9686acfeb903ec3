"""The label diagnostic report: six phases over one scan of the pings."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from wakeline.operators import clean, labels, series
from wakeline.params import Params


def target_report(pings: DataFrame, p: Params) -> DataFrame:
    """One row: inventory, gaps, identifier, box impact, labels, verdict as structs."""
    impact = series.geo_filter_impact(pings, p)
    gaps = series.gap_events(pings, p)
    n_gaps = gaps.select("n_gaps_ge_threshold").scalar()
    sanity = labels.label_sanity(labels.label_sliding(pings, p), n_gaps, p)
    verdict = labels.target_verdict(sanity, impact.select("n_gaps_after").scalar())

    def one(df: DataFrame, name: str):
        return df.select(F.struct("*").alias(name)).scalar().alias(name)

    histogram = series.gap_histogram(pings, p).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n_gaps")))).alias("h")
    ).scalar().alias("gap_histogram")
    top = series.top_gap_vessels(pings, p).agg(
        F.collect_list(F.struct("MMSI", "n_gaps")).alias("t")
    ).scalar().alias("top_gap_vessels")
    return pings.sparkSession.range(1).select(
        one(series.inventory_stats(pings), "inventory"), one(gaps, "gaps"), histogram, top,
        one(clean.id_type_check(pings), "identifier"), one(impact, "box"), one(sanity, "labels"),
        one(verdict, "verdict"),
    )


def target_report_cached(pings: DataFrame, p: Params) -> DataFrame:
    """The same report with the pings kept in executor storage while it runs."""
    kept = pings.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = target_report(kept, p)
        return pings.sparkSession.createDataFrame(rows.collect(), rows.schema)  # one row
    finally:
        kept.unpersist()
