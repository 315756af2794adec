"""Power transform of many series at once: search, apply, invert.

The exponent maximises the normal log-likelihood. Each key's values are gathered into one
array and searched in a vectorised helper: one shuffle, where scoring every exponent by an
aggregate took far longer. Input rows are unique per (key, month), so an
array is as long as the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.power import yeo_johnson, yeo_johnson_inverse
from tidegauge.operators.spread import spread
from tidegauge.operators.stack import stacked

# Search plan: half-width of the first grid around 0, points each side, rounds. The first grid
# moves on while its best exponent is on an edge; every further round is POINTS times finer
# and centred on the best exponent so far.
FIRST_HALF_WIDTH = 5.0
POINTS = 10
ROUNDS = 4


def _moments(v: np.ndarray, present: np.ndarray, lam: np.ndarray):
    """Mean and variance of the transform: (keys, exponents) from (keys, values)."""
    size = np.log1p(np.abs(v))[:, None, :]
    up, keep = (v >= 0)[:, None, :], present[:, None, :]
    power = np.where(up, lam[:, :, None], 2 - lam[:, :, None])
    flat = power == 0
    # the power as exp of a log: exp runs vectorised, pow does not
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.where(flat, size, (np.exp(power * size) - 1) / np.where(flat, 1.0, power))
        out = np.where(up, out, -out) * keep
        n = present.sum(axis=1)[:, None]
        mean = out.sum(axis=2) / n
        gap = (out - mean[:, :, None]) * keep
        return mean, np.einsum("kgn,kgn->kg", gap, gap) / n


def search_exponents(v: np.ndarray, present: np.ndarray, rounds: int) -> np.ndarray:
    """Best exponent of each key, with the mean and deviation of its transformed values."""
    n = present.sum(axis=1)[:, None]
    jacobian = (np.sign(v) * np.log1p(np.abs(v)) * present).sum(axis=1)[:, None]
    step = FIRST_HALF_WIDTH / POINTS
    # a constant series has no likelihood: it keeps the identity and is only centred
    low, high = np.where(present, v, np.inf).min(axis=1), np.where(present, v, -np.inf).max(axis=1)
    known = low < high
    best = np.where(known, 0.0, 1.0)[:, None]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for turn in range(rounds):
            todo = np.flatnonzero(known)
            while len(todo):
                grid = best[todo] + step * np.arange(-POINTS, POINTS + 1)
                var = _moments(v[todo], present[todo], grid)[1]
                score = -n[todo] / 2 * np.log(var) + (grid - 1) * jacobian[todo]
                # no variance or overflow: not a candidate
                score = np.where(np.isfinite(score), score, -np.inf)
                pick = score.argmax(axis=1)
                valid = score.max(axis=1) > -np.inf
                known[todo] = valid
                best[todo] = np.where(
                    valid[:, None], np.take_along_axis(grid, pick[:, None], axis=1), 1.0
                )
                # the first grid follows a best exponent that lies on its edge
                edge = valid & ((pick == 0) | (pick == 2 * POINTS))
                todo = todo[edge] if turn == 0 else todo[:0]
            step /= POINTS
        mean, var = _moments(v, present, best)
        sd = np.sqrt(var)
    return np.hstack([best, mean, np.where(known[:, None] & (sd > 0), sd, 1.0)])


def _search_udf(rounds: int):
    @F.pandas_udf("lam double, mu double, sd double")
    def search(values: pd.Series) -> pd.DataFrame:
        found = [search_exponents(v[:, :, 0], there, rounds) for v, there in stacked(values, 1)]
        return pd.DataFrame(np.vstack(found), columns=["lam", "mu", "sd"])

    return search


def power_params(
    df: DataFrame, keys: Sequence[str], value: str = "value", rounds: int = ROUNDS
) -> DataFrame:
    """Key columns, ``lam``, and the mean ``mu`` and deviation ``sd`` of the transform.

    Null values are ignored.
    """
    rows = spread(df.select(*keys, value).filter(F.col(value).isNotNull()), keys)
    gathered = rows.groupBy(*keys).agg(F.collect_list(value).alias("_v"))
    return gathered.select(*keys, _search_udf(rounds)("_v").alias("_p")).select(*keys, "_p.*")


def power_apply(value: Column, lam: Column, mu: Column, sd: Column) -> Column:
    return (yeo_johnson(value, lam) - mu) / sd


def power_invert(z: Column, lam: Column, mu: Column, sd: Column) -> Column:
    return yeo_johnson_inverse(z * sd + mu, lam)


def frame_params(
    frame: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    flags: Sequence[str] = (),
    rounds: int = ROUNDS,
) -> DataFrame:
    """Parameters of every column of a wide frame: one row per key, one shuffle.

    Gives ``<col>_lam``, ``<col>_mu``, ``<col>_sd`` for ``columns``. A two-valued column
    (``flags``) is mapped affinely by any exponent, so it needs its mean and deviation only.
    """
    stats = [F.collect_list(c).alias(c) for c in columns]
    for c in flags:
        dev = F.stddev_pop(c)
        stats += [F.avg(c).alias(f"{c}_mu"), F.when(dev > 0, dev).otherwise(1.0).alias(f"{c}_sd")]
    gathered = spread(frame.select(*by, *columns, *flags), by).groupBy(*by).agg(*stats)
    search = _search_udf(rounds)
    found = gathered.withColumns({c: search(c) for c in columns})
    cells = [F.col(f"{c}.{p}").alias(f"{c}_{p}") for c in columns for p in ("lam", "mu", "sd")]
    return found.select(*by, *cells, *[f"{c}_{p}" for c in flags for p in ("mu", "sd")])


def frame_apply(
    frame: DataFrame,
    params: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    flags: Sequence[str] = (),
) -> DataFrame:
    """Replace the columns by their standardised transforms."""
    joined = frame.join(params, list(by))
    changed = {
        c: power_apply(F.col(c), F.col(f"{c}_lam"), F.col(f"{c}_mu"), F.col(f"{c}_sd"))
        for c in columns
    }
    changed.update({c: (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd") for c in flags})
    return joined.withColumns(changed).select(*frame.columns)
