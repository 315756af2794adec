"""Weighted means and centred second moments per key, merged without cancellation.

Each task reduces its rows to one block a key: count, weight, means and centred products.
Blocks are merged by the distances of their means, so a series with a large mean and a small
spread loses no digits, as it would if products of means were subtracted from raw sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD_KEYS = 2_000  # keys whose blocks a task holds
BLOCKS = "blocks"


def width_of(k: int) -> int:
    """Length of a block over ``k`` columns."""
    return 2 + k + k * (k + 1) // 2


def batch_blocks(values: np.ndarray, weight: np.ndarray, code: np.ndarray, keys: int) -> np.ndarray:
    """One block for each of the ``keys`` numbered groups of rows; shape (keys, width)."""
    k = values.shape[1]
    upper = np.triu_indices(k)
    total = np.bincount(code, weight, keys)
    safe = np.where(total > 0, total, 1.0)
    mean = np.stack([np.bincount(code, weight * v, keys) for v in values.T], axis=1) / safe[:, None]
    away = values - mean[code]
    # what rounding left of the mean
    rest = np.stack([np.bincount(code, weight * v, keys) for v in away.T], axis=1) / safe[:, None]
    scaled = away * weight[:, None]
    products = np.stack([np.bincount(code, scaled[:, i] * away[:, j], keys) for i, j in zip(*upper)], axis=1)
    products -= total[:, None] * rest[:, upper[0]] * rest[:, upper[1]]
    return np.concatenate([np.bincount(code, minlength=keys)[:, None], total[:, None], mean + rest, products], axis=1)


def merged(blocks: np.ndarray, k: int) -> np.ndarray:
    """One block of several blocks of the same key."""
    if len(blocks) == 1:
        return blocks[0]
    upper = np.triu_indices(k)
    weight, means = blocks[:, 1], blocks[:, 2 : 2 + k]
    total = weight.sum()
    mean = means[0] + (weight[:, None] * (means - means[0])).sum(axis=0) / (total if total > 0 else 1.0)
    away = means - mean
    products = blocks[:, 2 + k :].sum(axis=0) + ((weight[:, None] * away).T @ away)[upper]
    return np.concatenate([[blocks[:, 0].sum(), total], mean, products])


def full_matrix(blocks: np.ndarray, k: int) -> np.ndarray:
    """The centred products of stacked blocks as symmetric matrices (keys, k, k)."""
    out = np.zeros((len(blocks), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = out[:, j, i] = blocks[:, 2 + k :]
    return out


def moments(rows: DataFrame, by: Sequence[str], columns: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Key columns and ``blocks``, every task's block of that key laid end to end.

    ``merged`` over ``blocks`` reshaped to ``width_of(len(columns))`` gives the key's one
    block. Rows with a null or NaN in ``columns`` are left out. A key's rows are not
    gathered: it has about one block a task, whatever its length.
    """
    by, k = list(by), len(columns)

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}

        def handed_on() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=by, dtype=object)
            out[BLOCKS] = [merged(np.stack(b), k) for b in held.values()]
            return out

        for frame in frames:
            if not len(frame):
                continue
            code, first = _codes(frame[by])
            values = np.stack(frame["_v"].to_numpy())
            made = batch_blocks(values, frame["_w"].to_numpy(float), code, len(first))
            for key, block in zip(frame[by].iloc[first].itertuples(index=False, name=None), made):
                mine = held.setdefault(tuple(None if pd.isna(x) else x for x in key), [])
                mine.append(block)
                if len(mine) == 16:
                    mine[:] = [merged(np.stack(mine), k)]
            if len(held) > HELD_KEYS:
                yield handed_on()
                held = {}
        if held:
            yield handed_on()

    used = rows.dropna(subset=list(columns)).select(
        *by,
        F.array(*[F.col(c).cast("double") for c in columns]).alias("_v"),
        (F.lit(1.0) if weight is None else weight).cast("double").alias("_w"),
    )
    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField(BLOCKS, T.ArrayType(T.DoubleType()))])
    parts = used.mapInPandas(reduce, schema)
    return parts.groupBy(*by).agg(F.flatten(F.collect_list(BLOCKS)).alias(BLOCKS))


def _codes(keys: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row, and the first row of each group."""
    code = keys.groupby(list(keys.columns), sort=False, dropna=False).ngroup().to_numpy()
    first = np.unique(code, return_index=True)[1]
    return code, first
