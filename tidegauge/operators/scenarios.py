"""Twelve-month-ahead paths of the regressors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.align import to_wide
from tidegauge.operators.expectations import latest_complete
from tidegauge.operators.grid import asfreq_month
from tidegauge.operators.panel import add_dummies
from tidegauge.operators.relational import union_all
from tidegauge.operators.transforms import transform


def survey_path(
    survey: DataFrame, period: DataFrame, h: int, by: Sequence[str] = (), value: str = "median"
) -> DataFrame:
    """Medians of the latest survey that covers all ``h`` months."""
    rows = latest_complete(survey, period, h, by)
    return rows.select(*by, F.col("ref_date").alias("data"), F.col(value).alias("value"))


def survey_path_transformed(
    survey: DataFrame,
    period: DataFrame,
    last: DataFrame,
    h: int,
    code: str,
    by: Sequence[str] = (),
    value: str = "median",
) -> DataFrame:
    """As above, with the last observed month, transformed in date order.

    ``last`` holds that month as ``data``. It gives the first difference its base and drops
    out with the nulls.
    """
    rows = latest_complete(survey, period, h + 1, by, include=last)
    path = rows.select(*by, F.col("ref_date").alias("data"), F.col(value).alias("value"))
    return transform(path, code, by=by).dropna(subset=["value"])


def month_median(
    x: DataFrame, keys: Sequence[str], value: str = "value", start: str | None = None
) -> DataFrame:
    """Median per calendar month across years, nulls ignored."""
    rows = x.filter(F.col(value).isNotNull())
    if start is not None:
        rows = rows.filter(F.col("data") >= F.lit(start).cast("date"))
    return rows.groupBy(*keys, F.month("data").alias("month")).agg(F.median(value).alias(value))


def seasonal_path(
    x: DataFrame,
    period: DataFrame,
    by: Sequence[str] = (),
    value: str = "value",
    start: str | None = None,
) -> DataFrame:
    """Each month ahead takes its calendar month's median (full outer join on the month)."""
    medians = month_median(x, by, value, start)
    ahead = period.select(*by, "data", F.month("data").alias("month"))
    return medians.join(ahead, [*by, "month"], "full")


def assemble(paths: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One row per month ahead: every path as a column, plus the month dummies.

    Paths are unioned and widened in one aggregate, then put on the month grid.
    """
    rows = [
        p.filter(F.col("data").isNotNull()).select(
            *by, "data", F.lit(name).alias("series_id"), F.col("value").cast("double")
        )
        for name, p in paths.items()
    ]
    wide = to_wide(union_all(*rows), list(paths), by=by)
    scope = "series" if by else "panel"
    return add_dummies(asfreq_month(wide, by, list(paths), scope=scope))
