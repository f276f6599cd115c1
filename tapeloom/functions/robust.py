"""Robust statistics for kernels that run in Python workers (NumPy only)."""

import numpy as np


def row_median(x: np.ndarray) -> np.ndarray:
    """The median of each row without its NaNs; NaN where a row has none."""
    ordered = np.sort(x, axis=1)  # NaN sorts last
    n = np.sum(~np.isnan(x), axis=1)
    rows = np.arange(len(x))
    low, high = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, x.shape[1] - 1)
    return np.where(n > 0, 0.5 * (ordered[rows, low] + ordered[rows, high]), np.nan)


def spread(x: np.ndarray, floor: float) -> float:
    """1.4826 times the median absolute deviation from zero, ``floor`` at least."""
    x = x[np.isfinite(x)]
    return max(floor, 1.4826 * float(np.median(np.abs(x)))) if len(x) else floor


def rolling_median(x: np.ndarray, half: int) -> np.ndarray:
    """Centred median over ``2 * half + 1`` positions without NaNs; the window is cut at both ends."""
    padded = np.concatenate([np.full(half, np.nan), x, np.full(half, np.nan)])
    return row_median(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1))


def robust_components(m: np.ndarray, rank: int, cut: np.ndarray, iterations: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Robust principal components: ``m`` as a low-rank part plus a sparse one, by alternating projections.

    ``m`` has a row per observation; NaN is an entry that was not observed. An entry belongs to the sparse part
    as long as it is more than its column's ``cut`` away from the low-rank part. Each step fits the ``rank``
    leading components to what the sparse part leaves, through the small Gram matrix of the columns, and
    thresholds what remains; entries not observed, and those in the sparse part, are filled from the low-rank
    part of the step before. It ends when the sparse support no longer changes.
    """
    lost = np.isnan(m)
    low, support = np.zeros_like(m), np.abs(m) > cut
    rest = np.where(lost, 0.0, m)
    for _ in range(iterations):
        clean = np.where(lost | support, low, m)
        _, axes = np.linalg.eigh(clean.T @ clean)
        axes = axes[:, -rank:]
        low = (clean @ axes) @ axes.T
        rest = np.where(lost, 0.0, m - low)
        fresh = np.abs(rest) > cut
        if np.array_equal(fresh, support):
            break
        support = fresh
    return low, np.where(support, rest, 0.0)
