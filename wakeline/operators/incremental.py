"""Which vessels must be scored again?"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.params import MMSI

CHUNKS = 4


def config_digest(config: dict) -> str:
    """Key order does not matter."""
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def _row_digest(cols: Sequence[str]) -> Column:
    """md5 of the row's values; null and the empty string differ."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def vessel_fingerprint(df: DataFrame, config: dict, cols: Sequence[str]) -> DataFrame:
    """(MMSI, n_rows, fingerprint): content hash of a vessel's rows and the configuration.

    Row digests are added up in four 32-bit pieces, so row order does not matter
    and only sums are shuffled; no vessel is gathered to be hashed.
    """
    digest = _row_digest(cols)
    pieces = [
        F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"_s{i}")
        for i in range(CHUNKS)
    ]
    summed = df.withColumn("_d", digest).groupBy(MMSI).agg(F.count(F.lit(1)).alias("n_rows"), *pieces)
    text = F.concat_ws(
        "|", F.col(MMSI).cast("string"), F.col("n_rows").cast("string"),
        *[F.col(f"_s{i}").cast("string") for i in range(CHUNKS)], F.lit(config_digest(config)),
    )
    return summed.select(MMSI, "n_rows", F.md5(text).alias("fingerprint"))


def stale_vessels(current: DataFrame, stored: DataFrame, now_us: int, ttl_hours: float) -> DataFrame:
    """Vessels without a stored result of the same fingerprint younger than the limit.

    ``stored`` has (MMSI, fingerprint, stored_us).
    """
    oldest = now_us - int(ttl_hours * 3_600_000_000)
    fresh = stored.filter(F.col("stored_us") >= oldest).select(MMSI, "fingerprint")
    return current.join(fresh, [MMSI, "fingerprint"], "left_anti")
