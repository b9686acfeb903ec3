"""Density expressions of the two-component regime model.

Component 0 is the suspicious regime, component 1 is transit. Parameters are
columns named mu_sospetto, gap, sigma_speed_0/1, sigma_turn_0/1, theta_0/1.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wakeline.functions.columns import col

PARAMETERS = (
    "mu_sospetto", "gap", "sigma_speed_0", "sigma_speed_1",
    "sigma_turn_0", "sigma_turn_1", "theta_0", "theta_1",
)

# Floors on scales and weights of the posterior score.
SIGMA_FLOOR = 1e-3
WEIGHT_FLOOR = 1e-12
DENOMINATOR_FLOOR = 1e-12


def _log_kernel(x, mu, sigma) -> Column:
    z = (x - mu) / sigma
    return -0.5 * z * z - F.log(sigma)


def _floor(name: str, low: float) -> Column:
    return F.greatest(F.col(name), F.lit(low))


def log_joint(speed="speed_std", turn="turn_std") -> tuple[Column, Column]:
    """Log weight plus both log kernels, per component."""
    speed, turn = col(speed), col(turn)
    centres = (F.col("mu_sospetto"), F.col("mu_sospetto") + F.col("gap"))
    return tuple(
        F.log(_floor(f"theta_{k}", WEIGHT_FLOOR))
        + _log_kernel(speed, centres[k], _floor(f"sigma_speed_{k}", SIGMA_FLOOR))
        + _log_kernel(turn, F.lit(0.0), _floor(f"sigma_turn_{k}", SIGMA_FLOOR))
        for k in (0, 1)
    )


def regime_probability(speed="speed_std", turn="turn_std") -> Column:
    """Posterior of component 0. A value that is not finite stops the job."""
    l0, l1 = log_joint(speed, turn)
    top = F.greatest(l0, l1)
    e0, e1 = F.exp(l0 - top), F.exp(l1 - top)
    p = F.try_divide(e0, e0 + e1)
    bad = l0.isNotNull() & l1.isNotNull() & (p.isNull() | F.isnan(p))
    return F.when(bad, F.raise_error(F.lit("regime probability is not finite"))).otherwise(p)


def responsibility(speed="speed_std", turn="turn_std", get=F.col) -> Column:
    """Component-0 share on densities, with a small constant in the denominator.

    ``get`` gives the column of a parameter's name.
    """
    speed, turn = col(speed), col(turn)
    centres = (get("mu_sospetto"), get("mu_sospetto") + get("gap"))

    def density(x, mu, sigma):
        z = (x - mu) / sigma
        return F.exp(-0.5 * z * z) / (sigma * 2.5066282746310002)

    w = [
        get(f"theta_{k}")
        * density(speed, centres[k], get(f"sigma_speed_{k}"))
        * density(turn, F.lit(0.0), get(f"sigma_turn_{k}"))
        for k in (0, 1)
    ]
    return w[0] / (w[0] + w[1] + DENOMINATOR_FLOOR)
