"""One immutable object holds every tunable of the engine."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# Column names of the ping, feature, label and score tables.
MMSI = "MMSI"
TIMESTAMP = "Timestamp"
MEASURES = ("Lat", "Lon", "SOG", "COG")
KINEMATICS = ("dt_prev_hours", "delta_SOG", "delta_COG", "speed_acc", "turn_rate")
TARGET = "target_dark_fleet"
REGIME = "prob_regime_sospetto"
REGIME_VAR = "incertezza_regime"
REGIME_MARKOV = "prob_regime_markov"
REGIME_SMOOTHED = "prob_regime_sospetto_markov"

# Feature lists of the classifiers.
FEATURES_BASELINE = (
    "SOG", "COG", "delta_SOG", "delta_COG", "speed_acc", "turn_rate", "dt_prev_hours",
)
FEATURES_FULL = FEATURES_BASELINE + (REGIME,)
FEATURES_MOTION = ("delta_SOG", "delta_COG", "speed_acc", "turn_rate", "dt_prev_hours")


@dataclass(frozen=True)
class Params:
    # cleaning
    min_lat: float = 35.0
    max_lat: float = 38.0
    min_lon: float = 11.0
    max_lon: float = 15.5
    min_sog: float = 0.0
    max_sog: float = 50.0
    # downsampling; the width must divide one day
    bin_minutes: int = 10
    bin_label: str = "start"
    # labels
    gap_hours: float = 12.0
    horizon_hours: float = 24.0
    label_horizon_minutes: float = 120.0
    labeling: str = "sliding_window"
    # regime scoring
    window: int = 36
    update_freq: int = 20
    adaptive_threshold: float | None = 1.5
    max_fits: int | None = None  # an emergency limit on fits per vessel
    sigma_speed: float = 1.0
    sigma_turn: float = 2.0
    p_00: float = 0.85
    p_11: float = 0.85
    em_iterations: int = 25
    em_checkpoint_every: int = 5
    # prior studies
    min_vessel_rows: int = 100
    min_fit_rows: int = 30
    n_pilot_vessels: int | None = None  # all eligible vessels, unless a sample is asked for
    n_draws: int = 100
    robust_rho: float = 0.85
    # folds
    n_splits: int = 3
    fold_gap_hours: float = 24.0
    fold_horizon_hours: float = 24.0
    holdout_ratio: float = 0.2
    train_ratio: float = 0.8
    seed: int = 42
    # audit
    n_controls: int = 5
    # physical layout
    range_rows: int = 250_000  # a table is cut into ranges of about so many rows, or as many as shuffle partitions
    salts: int = 16
    path_points: int = 10_000
    broadcast_rows: int = 200_000
    group_rows: int = 200_000
    seq_col: str = "ping_seq"
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        if self.bin_minutes <= 0 or 1440 % self.bin_minutes:
            raise ValueError("bin_minutes must be a positive divisor of 1440")
        if self.bin_label not in ("start", "end"):
            raise ValueError("bin_label must be 'start' or 'end'")
        if self.range_rows <= 0:
            raise ValueError("range_rows must be positive")

    @property
    def bin_us(self) -> int:
        return self.bin_minutes * 60_000_000

    def as_dict(self) -> dict:
        return asdict(self)
