"""Recursive forecasts and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.models import COEF, INTERCEPT, dot
from tidegauge.operators.power import power_invert
from tidegauge.operators.spread import spread
from tidegauge.schema import FORECAST, no_nan

# Horizon, bootstrap size, seed and interval.
HORIZON = 12
N_BOOT = 5000
SEED = 1984
INTERVAL = (0.05, 0.95)

# Fixed values of the draw: a prime modulus, and multipliers and offsets that mix its state.
MODULUS = 2147483647
SEED_STRIDE = 1000003


def step_inputs(
    scenario: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """One row per key: lag weight ``phi`` and ``drive``, the ordered rest of each step.

    ``scenario`` has ``step`` (1..h), ``data`` and the regressors on the model's scale.
    ``features`` excludes the lag, which is the model's first coefficient.
    """
    joined = scenario.join(models.select(*by, INTERCEPT, COEF), list(by))
    rest = F.slice(COEF, 2, len(features))
    drive = F.col(INTERCEPT) + dot(rest, [F.col(c) for c in features])
    # h rows per key
    ordered = F.sort_array(F.collect_list(F.struct("step", "data", drive.alias("drive"))))
    grouped = joined.groupBy(*by).agg(F.max(F.col(COEF)[0]).alias("phi"), ordered.alias("_steps"))
    return grouped.select(
        *by, "phi", F.col("_steps.data").alias("days"), F.col("_steps.drive").alias("drive")
    )


def recursive_path(start: Column, phi: Column, drive: Column) -> Column:
    """``y[t+1] = drive[t+1] + phi * y[t]`` as an array of h values."""
    empty = F.array().cast("array<double>")
    return F.aggregate(
        drive,
        F.struct(start.cast("double").alias("y"), empty.alias("path")),
        lambda acc, d: F.struct(
            (d + phi * acc["y"]).alias("y"),
            F.concat(acc["path"], F.array(d + phi * acc["y"])).alias("path"),
        ),
        lambda acc: acc["path"],
    )


def draw_base(n_boot: int, h: int, seed: int) -> np.ndarray:
    """Integer draws, one per (path, step); ``% n`` picks a residual.

    Pure integer arithmetic: the same on any partitioning, and in SQL.
    """
    return draw_range(0, n_boot, h, seed)


def draw_range(first: int, end: int, h: int, seed: int) -> np.ndarray:
    """The draws of the paths from ``first`` up to but not including ``end``."""
    cell = np.arange(first, end, dtype=np.int64)[:, None] * h + np.arange(h, dtype=np.int64)[None, :]
    x = (cell + 1 + seed * SEED_STRIDE) % MODULUS
    x = x * 48271 % MODULUS
    x = (x * x + 12345) % MODULUS
    x = x * 69621 % MODULUS
    x = (x * x + 777) % MODULUS
    return x * 48271 % MODULUS


def _invert(z: np.ndarray, lam: float, mu: float, sd: float) -> np.ndarray:
    """The power transform's inverse; NaN where it has none, whatever the exponent."""
    v = z * sd + mu
    above, below = lam * v + 1, 1 - (2 - lam) * v
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        up = np.expm1(v) if lam == 0 else np.power(above, 1 / lam) - 1
        down = -np.expm1(-v) if lam == 2 else 1 - np.power(below, 1 / (2 - lam))
    return np.where(np.where(v >= 0, above, below) > 0, np.where(v >= 0, up, down), np.nan)


def _bounds(paths: np.ndarray, levels: Sequence[float], lam: float, mu: float, sd: float):
    """Quantiles per step on the original scale.

    The inverse is increasing, so the order statistics can be picked first and only they
    inverted. Where some path leaves the inverse's domain, all are inverted; those that have
    no value are left out.
    """
    lowest, highest = paths.min() * sd + mu, paths.max() * sd + mu
    if (highest > 0 and lam * highest + 1 <= 0) or (lowest < 0 and 1 - (2 - lam) * lowest <= 0):
        return np.nanquantile(_invert(paths, lam, mu, sd), levels, axis=0)
    rank = np.asarray(levels) * (len(paths) - 1)
    low = np.floor(rank).astype(int)
    high = np.minimum(low + 1, len(paths) - 1)
    ordered = np.partition(paths, np.unique(np.concatenate([low, high])), axis=0)
    a, b = (_invert(ordered[i], lam, mu, sd) for i in (low, high))
    with np.errstate(invalid="ignore"):
        return a + (b - a) * (rank - low)[:, None]


def _interval_udf(n_boot: int, seed: int, levels: tuple[float, float]):
    @F.pandas_udf("lower array<double>, upper array<double>")
    def interval(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        drawn, pick = None, None
        for batch in batches:
            out = []
            for start, phi, drive, resid, lam, mu, sd in zip(*batch):
                # keys mostly share the length of their sample: draw again only if not
                if drawn != (len(drive), len(resid)):
                    drawn = (len(drive), len(resid))
                    pick = draw_base(n_boot, len(drive), seed) % len(resid)
                shocks = np.asarray(resid)[pick]
                y = np.full(n_boot, start)
                for t, d in enumerate(drive):
                    y = d + phi * y + shocks[:, t]
                    shocks[:, t] = y
                out.append(tuple(_bounds(shocks, levels, lam, mu, sd)))
            yield pd.DataFrame(out, columns=["lower", "upper"])

    return interval


def residual_lists(resid: DataFrame, by: Sequence[str]) -> DataFrame:
    """Residuals of a key in date order (one per month of the sample)."""
    ordered = F.sort_array(F.collect_list(F.struct("data", "resid")))
    return resid.groupBy(*by).agg(ordered.alias("_r")).select(*by, F.col("_r.resid").alias("resid"))


def forecast_rows(inputs: DataFrame, by: Sequence[str], interval: Sequence[Column] = ()) -> DataFrame:
    """Explode the paths to one row per key and step.

    ``inputs`` has ``start``, ``phi``, ``drive``, ``days``, ``lam``, ``mu``, ``sd``.
    """
    path = recursive_path(F.col("start"), F.col("phi"), F.col("drive"))
    zipped = F.arrays_zip(F.col("days").alias("data"), path.alias("z"), *interval)
    rows = inputs.select(*by, "lam", "mu", "sd", F.posexplode(zipped).alias("step", "_s"))
    point = power_invert(F.col("_s.z"), F.col("lam"), F.col("mu"), F.col("sd"))
    return rows.select(*by, F.col("step") + 1, "_s.*", point.alias("valor"))


def forecast_point(inputs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Point forecasts: key columns, ``step``, ``data``, ``valor``."""
    rows = forecast_rows(inputs, by)
    return rows.toDF(*by, "step", "data", "z", "valor").drop("z")


def forecast_interval(
    inputs: DataFrame,
    by: Sequence[str],
    n_boot: int = N_BOOT,
    seed: int = SEED,
    levels: tuple[float, float] = INTERVAL,
) -> DataFrame:
    """Point forecasts with bootstrap bounds; ``inputs`` also has the list ``resid``.

    A key's paths live in one Arrow row: memory is ``n_boot * h`` numbers, and nothing is
    exploded or shuffled. Work is spread over keys.
    """
    bounds = _interval_udf(n_boot, seed, levels)(
        "start", "phi", "drive", "resid", "lam", "mu", "sd"
    )
    ready = spread(inputs, by).withColumn("_b", bounds)
    rows = forecast_rows(ready, by, [F.col("_b.lower"), F.col("_b.upper")])
    named = rows.toDF(*by, "step", "data", "z", "ic_inferior", "ic_superior", "valor").drop("z")
    return named.withColumns({c: no_nan(F.col(c)) for c in ("ic_inferior", "ic_superior", "valor")})


def forecast_table(rows: DataFrame, variavel: Column, tipo: Column, run: Column | None = None):
    """Forecast rows in the published layout, with the run stamp when given."""
    named = rows.withColumns({"variavel": variavel, "tipo": tipo})
    columns = list(FORECAST.fieldNames())
    if run is not None:
        named = named.withColumn("previsao", run)
        columns.append("previsao")
    return named.select(*columns)
