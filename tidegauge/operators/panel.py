"""From an aligned panel to a model-ready frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import month_dummies
from tidegauge.functions.dates import DUMMIES
from tidegauge.operators.grid import fill_both
from tidegauge.operators.transforms import transform_by_catalog

# First month of the training sample, and the null share that drops a series.
SAMPLE_START = "2004-01-01"
MAX_NULL_SHARE = 0.2

LAG = "lag_1"


def target_bounds(y: DataFrame, by: Sequence[str], start: str = SAMPLE_START) -> DataFrame:
    """Rows used and last date of each target (key columns, ``n_y``, ``last``)."""
    used = y.filter(F.col("value").isNotNull() & (F.col("data") >= F.lit(start).cast("date")))
    return used.groupBy(*by).agg(F.count(F.lit(1)).alias("n_y"), F.max("data").alias("last"))


def _with_bounds(x: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return x.join(bounds.select(*by, "n_y", "last"), list(by))
    return x.withColumns({c: bounds.select(c).scalar() for c in ("n_y", "last")})


def sample(
    x: DataFrame, bounds: DataFrame, by: Sequence[str], start: str = SAMPLE_START
) -> DataFrame:
    """Rows from ``start`` to the target's last date; keeps ``n_y``."""
    inside = F.col("data").between(F.lit(start).cast("date"), F.col("last"))
    return _with_bounds(x, bounds, by).filter(inside).drop("last")


def null_share(x: DataFrame, keys: Sequence[str], n_target: Column) -> DataFrame:
    """Share of null months per series, relative to the target's row count."""
    return x.groupBy(*keys).agg(
        (F.count_if(F.col("value").isNull()) / F.max(n_target)).alias("null_share")
    )


def drop_sparse(
    x: DataFrame, keys: Sequence[str], n_target: Column, limit: float = MAX_NULL_SHARE
) -> DataFrame:
    """Rows of the series whose null share is below ``limit``.

    Counted over the key's window, so the fill that follows reuses the shuffle.
    """
    missing = F.count_if(F.col("value").isNull()).over(W.partitionBy(*keys))
    return x.withColumn("_share", missing / n_target).filter(F.col("_share") < limit).drop("_share")


def prepare_regressors(
    x: DataFrame,
    catalog: DataFrame,
    bounds: DataFrame,
    by: Sequence[str] = (),
    start: str = SAMPLE_START,
) -> DataFrame:
    """Transform, sample, drop sparse series, fill: in this order.

    ``x`` lies on the panel's month grid; transforms see the full history before the sample
    is cut.
    """
    keys = [*by, "series_id"]
    changed = transform_by_catalog(x, catalog, by=keys)
    cut = sample(changed, bounds, by, start)
    kept = drop_sparse(cut, keys, F.col("n_y"))
    return fill_both(kept.drop("n_y"), keys)


def add_dummies(df: DataFrame, order: str = "data") -> DataFrame:
    """Month dummies from the date itself; nothing is joined."""
    return df.select("*", *month_dummies(F.col(order)))


def features(exog: Sequence[str], dummies: bool = True) -> list[str]:
    """Column order of the design matrix."""
    return [LAG, *exog, *(DUMMIES if dummies else [])]


def add_lag(df: DataFrame, by: Sequence[str], target: str = "y") -> DataFrame:
    w = W.partitionBy(*by).orderBy("data")
    return df.withColumn(LAG, F.lag(target, 1).over(w))


def design_matrix(
    frame: DataFrame,
    by: Sequence[str],
    exog: Sequence[str],
    target: str = "y",
    dummies: bool = True,
) -> DataFrame:
    """Target, its lag, regressors and dummies; each key's first row is dropped."""
    base = add_dummies(frame) if dummies else frame
    rows = add_lag(base, by, target)
    return rows.select(*by, "data", target, *features(exog, dummies)).dropna(
        subset=[target, LAG, *exog]
    )
