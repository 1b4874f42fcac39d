"""Vectors in tasks: columns to matrices, distances to pivots."""

from __future__ import annotations

import numpy as np
import pandas as pd

BLOCK_ROWS = 2048


def matrix(column: pd.Series) -> np.ndarray:
    """Array column to a float matrix; missing entries become NaN."""
    return np.array(column.tolist(), dtype=float)


def no_rows(*cols: str) -> pd.DataFrame:
    """A frame without rows that fits any column types: empty lists would make numbers,
    which are refused where the IDs are texts."""
    return pd.DataFrame(columns=cols, dtype=object)


def together(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """The parts one below the other.  Texts are held as Python objects: a text column of
    pandas' own is one chunk per part, and Arrow refuses chunks in what a task returns."""
    out = pd.concat(parts)
    own = [c for c, kind in out.dtypes.items() if isinstance(kind, pd.api.extensions.ExtensionDtype)]
    return out.astype(dict.fromkeys(own, object))


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances over the entries present in each row of ``x``."""
    centre = pivots.mean(0)  # keeps the products below small
    x, pivots = x - centre, pivots - centre
    seen = ~np.isnan(x)
    x0 = np.where(seen, x, 0.0)
    d2 = (x0**2).sum(1)[:, None] - 2 * x0 @ pivots.T + seen.astype(float) @ (pivots**2).T
    return np.maximum(d2, 0.0)
