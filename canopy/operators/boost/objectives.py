"""Objectives: link, initial score, gradient, hessian, stopping loss.

NumPy functions for the per-partition histogram pass (M5).
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

import numpy as np

# Fixed value: the Poisson objective's hessian offset (its max_delta_step).
POISSON_MAX_DELTA_STEP = 0.7
MARGIN_CLIP = 50.0


@dataclass(frozen=True)
class Objective:
    name: str
    log_link: bool
    grad_hess: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    loss: Callable[[np.ndarray, np.ndarray], np.ndarray]   # per-row stopping loss (lower is better)

    def base_margin(self, mean_y: float) -> float:
        if self.log_link:
            return float(np.log(max(mean_y, 1e-16)))
        return float(mean_y)

    def bounds(self, margin: float, low: float, high: float) -> tuple[float, float]:
        """Largest gradient and hessian of labels in low..high at one margin."""
        g, h = self.grad_hess(np.full(2, margin), np.array([low, high]))
        return float(np.abs(g).max()), float(h.max())

    def bounds_after(self, top: tuple[float, float], high: float, least: float, most: float) -> tuple[float, float]:
        """Bounds of gradient and hessian after a tree with values in least..most is added to margins whose
        bounds are ``top``; ``high`` is the largest label."""
        g, h = top
        if not self.log_link:
            return g + max(abs(least), abs(most)), h
        if self.name == "count:poisson":
            mean = h * np.exp(max(most, 0.0) - POISSON_MAX_DELTA_STEP)
            return float(max(mean, high)), float(h * np.exp(max(most, 0.0)))
        ratio = float(h * np.exp(max(-least, 0.0)))
        return max(1.0, ratio), ratio

    def predict(self, margin: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(margin, -MARGIN_CLIP, MARGIN_CLIP)) if self.log_link else margin


def _sq_gh(m, y):
    return m - y, np.ones_like(m)


def _sq_loss(m, y):
    return (m - y) ** 2


def _pois_gh(m, y):
    mc = np.clip(m, -MARGIN_CLIP, MARGIN_CLIP)
    return np.exp(mc) - y, np.exp(mc + POISSON_MAX_DELTA_STEP)


def _pois_loss(m, y):
    mc = np.clip(m, -MARGIN_CLIP, MARGIN_CLIP)
    return np.exp(mc) - y * mc


def _gamma_gh(m, y):
    e = y * np.exp(-np.clip(m, -MARGIN_CLIP, MARGIN_CLIP))
    return 1.0 - e, e


def _gamma_loss(m, y):
    mc = np.clip(m, -MARGIN_CLIP, MARGIN_CLIP)
    return y * np.exp(-mc) + mc


OBJECTIVES = {
    "reg:squarederror": Objective("reg:squarederror", False, _sq_gh, _sq_loss),
    "count:poisson": Objective("count:poisson", True, _pois_gh, _pois_loss),
    "reg:gamma": Objective("reg:gamma", True, _gamma_gh, _gamma_loss),
}


def get(name: str) -> Objective:
    try:
        return OBJECTIVES[name]
    except KeyError:
        raise ValueError(f"unknown objective {name!r}; known: {sorted(OBJECTIVES)}") from None
