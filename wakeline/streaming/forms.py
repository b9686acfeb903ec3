"""Streaming forms of the batch operators; each gives the rows of its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.functions.columns import micros
from wakeline.operators.markov import _replay
from wakeline.operators.series import ACC_LIMIT, TURN_LIMIT
from wakeline.params import KINEMATICS, MEASURES, MMSI, TIMESTAMP, Params


def dedup_stream(pings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row for each (vessel, time) among rows that arrive within the delay."""
    return pings.withWatermark(TIMESTAMP, delay).dropDuplicatesWithinWatermark([MMSI, TIMESTAMP])


def downsample_stream(pings: DataFrame, p: Params, delay: str = "1 hour") -> DataFrame:
    """Last value of every column for each vessel and bin, emitted when the bin closes."""
    bins = F.window(TIMESTAMP, f"{p.bin_minutes} minutes")
    order = micros()
    return (
        pings.withWatermark(TIMESTAMP, delay)
        .groupBy(bins.alias("_w"), MMSI)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in MEASURES])
        .dropna(subset=list(MEASURES))
        .select(MMSI, F.col("_w.start").alias(TIMESTAMP), *MEASURES)
    )


FEATURE_SCHEMA = (
    f"{MMSI} long, us long, SOG double, COG double, "
    + ", ".join(f"{c} double" for c in KINEMATICS) + ", filtered double, late boolean"
)


def features_stream(pings: DataFrame, p: Params, score: str = "score", p_stay: float = 0.85) -> DataFrame:
    """Kinematic features and the chain filter with the vessel's last row as state.

    Rows of a vessel must arrive in time order across batches, as they do behind
    ``downsample_stream``; a row not newer than the state is emitted with ``late`` set,
    its own values and null features, and doesn't change the state.
    """
    names = [c.split()[0] for c in FEATURE_SCHEMA.split(", ")]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("us", kind="stable")
        last = state.get if state.exists else (None, None, None, None)
        if last[0] is not None:
            behind = rows["us"] <= last[0]
            if behind.any():
                out = rows.loc[behind, ["us", "SOG", "COG"]].assign(**{MMSI: key[0], "late": True})
                yield out.reindex(columns=names).astype({c: float for c in (*KINEMATICS, "filtered")})
            rows = rows[~behind]
        if rows.empty:
            return
        us = pd.concat([pd.Series([last[0]], dtype="Int64"), rows["us"].astype("Int64")])
        dt = (us.diff().iloc[1:].astype("Float64") / 3_600_000_000.0).to_numpy(dtype=float, na_value=float("nan"))
        speed = pd.concat([pd.Series([last[1]], dtype=float), rows["SOG"]]).diff().iloc[1:].to_numpy()
        course = pd.concat([pd.Series([last[2]], dtype=float), rows["COG"]]).diff().iloc[1:].to_numpy()
        course = (course + 180.0) % 360.0 - 180.0
        ok = dt > 0
        safe = dt.copy()
        safe[~ok] = float("nan")
        out = pd.DataFrame({
            MMSI: key[0], "us": rows["us"].to_numpy(), "SOG": rows["SOG"].to_numpy(), "COG": rows["COG"].to_numpy(),
            "dt_prev_hours": dt, "delta_SOG": speed, "delta_COG": course,
            "speed_acc": (pd.Series(speed) / safe).clip(-ACC_LIMIT, ACC_LIMIT),
            "turn_rate": (pd.Series(course) / safe).clip(-TURN_LIMIT, TURN_LIMIT),
        })
        out[list(KINEMATICS)] = out[list(KINEMATICS)].fillna(0.0)
        out["filtered"] = pd.Series(_replay(rows[score].tolist(), last[3], p_stay, p_stay), dtype=float)
        kept = [v for v in out["filtered"] if v == v]
        state.update((
            int(rows["us"].iloc[-1]), float(rows["SOG"].iloc[-1]), float(rows["COG"].iloc[-1]),
            float(kept[-1]) if kept else last[3],
        ))
        out["late"] = False
        yield out

    narrow = pings.select(MMSI, micros().alias("us"), "SOG", "COG", score)
    return narrow.groupBy(MMSI).applyInPandasWithState(
        step, FEATURE_SCHEMA, "us long, sog double, cog double, filtered double", "append",
        GroupStateTimeout.NoTimeout,
    )


def gap_alerts(pings: DataFrame, p: Params, delay: str = "1 hour") -> DataFrame:
    """(MMSI, last_us): a last ping before a gap, as soon as the silence reaches the threshold.

    An event-time timer runs from each vessel's last ping. A gap that a late
    ping has already closed is reported when that ping arrives.
    """
    threshold = int(p.gap_hours * 3_600_000_000)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            # the alert is out; the vessel stays known so that its return adds none
            state.update((last, True))
            yield pd.DataFrame({MMSI: [key[0]], "last_us": [last]})
            return
        times = sorted(pd.concat(list(frames))["us"].tolist())
        last, told = state.get if state.exists else (None, False)
        found = []
        for t in times:
            if last is not None and t - last >= threshold and not told:
                found.append(last)
            if last is None or t > last:
                last, told = t, False
        state.update((last, told))
        wake = (last + threshold) // 1000
        if wake > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(wake)
        elif not told:
            found.append(last)
            state.update((last, True))
        if found:
            yield pd.DataFrame({MMSI: key[0], "last_us": found})

    marked = pings.withWatermark(TIMESTAMP, delay).select(MMSI, TIMESTAMP, micros().alias("us"))
    return marked.groupBy(MMSI).applyInPandasWithState(
        step, f"{MMSI} long, last_us long", "last_us long, told boolean", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
