"""The same arithmetic as expressions, over numpy arrays, for tasks that read files themselves."""

from __future__ import annotations

import numpy as np

from ..constants import SPECTRUM_BIN_DA, SPECTRUM_BINS, SPECTRUM_MIN_DA


def mass_bins(mass: np.ndarray) -> np.ndarray:
    """Spectrum bins of finite masses."""
    places = np.floor((mass.astype(np.float64) - SPECTRUM_MIN_DA) / SPECTRUM_BIN_DA)
    return np.clip(places, 0, SPECTRUM_BINS - 1).astype(np.int64)


def ranks_in(bins: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The rank of each point in its bin, where seen[b] points of bin b came before; seen is moved on."""
    order = np.argsort(bins, kind="stable")
    counts = np.bincount(bins, minlength=len(seen))
    ranks = np.empty(len(bins), np.int64)
    ranks[order] = np.arange(len(bins)) - np.repeat(np.cumsum(counts) - counts, counts)
    ranks += seen[bins]
    seen += counts
    return ranks


def midpoints(k: np.ndarray, count: np.ndarray, take: np.ndarray) -> np.ndarray:
    return np.floor((k.astype(np.float64) + 0.5) * count / take).astype(np.int64)


def pick_numbers(rank: np.ndarray, count: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Which pick each rank is, or -1. Picks are count / take apart, so one of three can have a rank."""
    out = np.full(len(rank), -1, np.int64)
    some = np.flatnonzero(take > 0)
    rank, count, take = rank[some], count[some], take[some]
    near = np.floor(rank.astype(np.float64) * take / count).astype(np.int64)
    for k in (near + 1, near, near - 1):
        hit = (k >= 0) & (k < take) & (midpoints(k, count, take) == rank)
        out[some[hit]] = k[hit]
    return out
