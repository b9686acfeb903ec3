"""MAP-EM for the two-regime mixture.

Speed and turn are two separate mixtures that share the weights, so every
observation has two responsibilities. ``step`` is one M-step on sums; it only
uses arithmetic, ``where`` and ``sqrt``, so the same formulas serve numpy
arrays (many short windows in one Arrow batch) and Spark columns (one aggregate
for each iteration over whole vessels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Priors of the rolling model.
CAUSAL_WEIGHTS = (1.0, 4.0)
CAUSAL_MU, CAUSAL_MU_SD = -0.06, 0.2
CAUSAL_GAP, CAUSAL_GAP_SD = 2.5, 0.1
CAUSAL_SPEED_CAP, CAUSAL_TURN_CAP = 1.0, 1.5

# Start and floor of the scales.
START_SIGMA, START_TAU = 0.7, (1.2, 0.5)
SIGMA_FLOOR = 1e-3
THETA_FLOOR = 1e-6


@dataclass(frozen=True)
class Prior:
    """Dirichlet weights, centre and spread of mu_0 and gap, scales of the half-normals."""

    a0: float
    a1: float
    m: float
    s_m: float
    c: float
    s_g: float
    s_speed: float
    s_turn: float


def causal_prior(sigma_speed: float, sigma_turn: float) -> Prior:
    return Prior(
        *CAUSAL_WEIGHTS, CAUSAL_MU, CAUSAL_MU_SD, CAUSAL_GAP, CAUSAL_GAP_SD,
        min(sigma_speed, CAUSAL_SPEED_CAP), min(sigma_turn, CAUSAL_TURN_CAP),
    )


def pilot_prior(sigma_speed: float, sigma_turn: float) -> Prior:
    return Prior(1.0, 1.0, 0.0, sigma_speed, 0.0, sigma_speed, sigma_speed, sigma_turn)


def scale(n, s, prior_scale, sqrt):
    """Mode of a scale under a half-normal prior, given the weight n and square sum s."""
    v = prior_scale * prior_scale
    return sqrt(v * (sqrt(n * n + 4.0 * s / v) - n) / 2.0)


def centres(n0, n1, a0, a1, sd0, sd1, m, s_m, c, s_g, where):
    """Mode of (mu_0, gap) with gap >= 0: a 2x2 linear system."""
    w0, w1 = n0 / (sd0 * sd0), n1 / (sd1 * sd1)
    b0, b1 = a0 / (sd0 * sd0), a1 / (sd1 * sd1)
    pm, pg = 1.0 / (s_m * s_m), 1.0 / (s_g * s_g)
    top, right = w0 + w1 + pm, b0 + b1 + pm * m
    det = top * (w1 + pg) - w1 * w1
    gap = (top * (b1 + pg * c) - w1 * right) / det
    mu = ((w1 + pg) * right - w1 * (b1 + pg * c)) / det
    return where(gap < 0, right / top, mu), where(gap < 0, gap * 0.0, gap)


def quartile_start(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres at the lower and upper quartile of each row (values of the data)."""
    ordered = np.sort(x, axis=1)
    low, high = (ordered[:, max(0, int(np.ceil(q * x.shape[1])) - 1)] for q in (0.25, 0.75))
    return low, high - low


def fit_windows(
    x: np.ndarray, y: np.ndarray, prior: Prior, iterations: int,
    w: np.ndarray | None = None, start: tuple[np.ndarray, np.ndarray] | None = None,
) -> np.ndarray:
    """Fit one mixture for each row of the (windows, observations) arrays.

    Returns columns mu_0, gap, sigma_0, sigma_1, tau_0, tau_1, theta_0, theta_1.
    """
    k = x.shape[0]
    w = np.ones_like(x) if w is None else w
    theta = np.full(k, prior.a0 / (prior.a0 + prior.a1))
    mu, gap = (np.full(k, prior.m), np.full(k, prior.c)) if start is None else start
    sd = np.full((2, k), START_SIGMA)
    tau = np.repeat(np.array(START_TAU)[:, None], k, axis=1)
    total = 2.0 * w.sum(axis=1) + prior.a0 + prior.a1 - 2.0

    def share(a, b):
        top = np.maximum(a, b)
        ea, eb = np.exp(a - top), np.exp(b - top)
        return ea / (ea + eb)

    for _ in range(iterations):
        log_weight = np.log(theta), np.log1p(-theta)
        centre = mu, mu + gap
        lx = [log_weight[j][:, None] - 0.5 * ((x - centre[j][:, None]) / sd[j][:, None]) ** 2
              - np.log(sd[j])[:, None] for j in (0, 1)]
        ly = [log_weight[j][:, None] - 0.5 * (y / tau[j][:, None]) ** 2 - np.log(tau[j])[:, None]
              for j in (0, 1)]
        sx, sy = share(*lx), share(*ly)
        rx, ry = (w * sx, w * (1.0 - sx)), (w * sy, w * (1.0 - sy))
        n = [r.sum(axis=1) for r in rx]
        a = [(r * x).sum(axis=1) for r in rx]
        q = [(r * x * x).sum(axis=1) for r in rx]
        u = [r.sum(axis=1) for r in ry]
        v = [(r * y * y).sum(axis=1) for r in ry]
        theta = np.clip((n[0] + u[0] + prior.a0 - 1.0) / total, THETA_FLOOR, 1 - THETA_FLOOR)
        mu, gap = centres(n[0], n[1], a[0], a[1], sd[0], sd[1],
                          prior.m, prior.s_m, prior.c, prior.s_g, np.where)
        for j, cj in enumerate((mu, mu + gap)):
            spread = np.maximum(q[j] - 2 * cj * a[j] + cj * cj * n[j], 0.0)
            sd[j] = np.maximum(scale(n[j], spread, prior.s_speed, np.sqrt), SIGMA_FLOOR)
            tau[j] = np.maximum(scale(u[j], v[j], prior.s_turn, np.sqrt), SIGMA_FLOOR)
    return np.column_stack([mu, gap, sd[0], sd[1], tau[0], tau[1], theta, 1.0 - theta])
