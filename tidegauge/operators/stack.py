"""Padding of ragged arrays, so that many keys share one numpy call."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

# keys solved together: temporary arrays stay within the processor's cache
STACK = 64


def stacked(batch: pd.Series, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stacks of tables (keys, rows, width) and the mask of their real rows (keys, rows).

    Each item of ``batch`` is one key's table, flattened row by row.
    """
    for start in range(0, len(batch), STACK):
        tables = [np.asarray(t, float).reshape(-1, width) for t in batch.iloc[start : start + STACK]]
        values = np.zeros((len(tables), max(1, *map(len, tables)), width))
        present = np.zeros(values.shape[:2], bool)
        for i, t in enumerate(tables):
            values[i, : len(t)], present[i, : len(t)] = t, True
        yield values, present
