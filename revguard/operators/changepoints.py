"""Piecewise-linear trend with sparse slope changes, and how far it may turn in the future.

The trend over scaled time u in [0, 1] is ``a + b u + sum_j d_j max(0, u - c_j)`` with candidate change points ``c_j`` spread
evenly over the first ``RANGE`` of the history.  Intercept and slope are free; the slope changes have a Laplace prior with
scale ``tau``, so with noise ``sigma`` the fit minimises ``|y - trend|^2 / 2 + sigma^2 / tau * sum |d_j|``.  Intercept and
slope are projected out, what is left is solved by coordinate descent with soft thresholds, and sigma and the changes are
found in turn.

For the future the prior's rate goes on: as many changes per unit of time as there are candidates, with the mean absolute
size of the fitted ones.  A change of Laplace scale m at time s moves the trend at distance h by d (h - s), so its variance
there is ``rate * 2 m^2 * h^3 / 3``: the band widens with the horizon, the more so the more the past has turned.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Share of the history that candidates are spread over.
RANGE = 0.8
#: Steps of coordinate descent at most, and the change that counts as none.
SWEEPS, STILL = 500, 1e-10
#: Times that noise and changes are fitted in turn.
TURNS = 4


class Trend(NamedTuple):
    start: float
    span: float
    at: np.ndarray       # change points in scaled time
    level: float
    slope: float
    change: np.ndarray
    sigma: float

    def value(self, t: np.ndarray) -> np.ndarray:
        u = (t - self.start) / self.span
        return self.level + self.slope * u + np.maximum(0., u[:, None] - self.at) @ self.change

    def future_sd(self, t: np.ndarray) -> np.ndarray:
        """Standard deviation of the trend from changes after the history; 0 within it."""
        ahead = np.maximum(0., (t - self.start) / self.span - 1.)
        size = np.abs(self.change).mean() if len(self.change) else 0.
        return np.sqrt(len(self.at) * 2. * size ** 2 * ahead ** 3 / 3.)


def soft(x: float, by: float) -> float:
    return float(np.sign(x) * max(abs(x) - by, 0.))


def descend(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """argmin |y - x d|^2 / 2 + penalty * sum |d|, one coordinate at a time."""
    d, norm = start.copy(), (x * x).sum(axis=0)
    rest = y - x @ d
    for _ in range(SWEEPS):
        moved = 0.
        for j in np.flatnonzero(norm > 1e-12):
            new = soft(float(x[:, j] @ rest) + norm[j] * d[j], penalty) / norm[j]
            if new != d[j]:
                rest -= x[:, j] * (new - d[j])
                moved = max(moved, abs(new - d[j]))
                d[j] = new
        if moved < STILL:
            break
    return d


def fit(t: np.ndarray, y: np.ndarray, n_changes: int = 12, tau: float = 0.05) -> Trend:
    """The trend of a series; one that is too short for candidates is a line, one point is a level."""
    start, span = float(t[0]), max(float(t[-1] - t[0]), 1.)
    u = (t - start) / span
    n_changes = max(0, min(n_changes, len(t) - 3))
    at = RANGE * np.arange(1, n_changes + 1) / (n_changes + 1)
    free = np.column_stack([np.ones_like(u), u]) if len(t) > 1 else np.ones((len(t), 1))
    hinges = np.maximum(0., u[:, None] - at)
    basis, _ = np.linalg.qr(free)
    left_x, left_y = hinges - basis @ (basis.T @ hinges), y - basis @ (basis.T @ y)
    # noise from neighbours first: a turning trend does not count as noise
    sigma = float(np.std(np.diff(y, n=2)) / np.sqrt(6.)) if len(y) > 3 else 0.
    change = np.zeros(n_changes)
    for _ in range(TURNS):
        change = descend(left_x, left_y, sigma ** 2 / tau, change)
        rest = left_y - left_x @ change
        used = free.shape[1] + int((change != 0).sum())
        sigma = float(np.sqrt((rest @ rest) / max(len(y) - used, 1)))
    line, *_ = np.linalg.lstsq(free, y - hinges @ change, rcond=None)
    return Trend(start, span, at, float(line[0]), float(line[1]) if len(line) > 1 else 0., change, sigma)
