"""Phase 1: cleaned, downsampled, featured and labelled pings as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wakeline.operators import clean, labels, series
from wakeline.params import Params


def downsampled_table(pings: DataFrame, p: Params) -> DataFrame:
    """Box, range rules and downsampling in one pass over the raw rows.

    Both filters drop null, NaN and infinite measures, so every surviving row
    is complete and the duplicate rule can ride inside the downsampling
    aggregate. Raw rows are therefore never shuffled: only partial bins are.
    """
    kept = clean.range_filter(clean.bbox_filter(clean.normalise_mmsi(pings), p), p)
    return series.downsample_last(kept, p, first_of_equal=True)


def feature_table(pings: DataFrame, p: Params) -> DataFrame:
    """Downsampled rows with kinematics.

    From here on a vessel holds at most span / bin rows, so every later window
    uses the vessel key and shares one shuffle.
    """
    return series.kinematic_features(downsampled_table(pings, p), p, bounded=True)


def labelled_table(pings: DataFrame, p: Params) -> DataFrame:
    return labels.label(feature_table(pings, p), p, bounded=True)
