"""Stationarity transforms and rolling growth, all series in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import safe_ln


def _steps(value: Column, w) -> dict[int, Column]:
    """Differences of order 0, 1 and 2."""
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return {0: value, 1: value - one, 2: value - 2 * one + two}


def transform_code(
    value: Column, code: Column | str, by: Sequence[str], order: str = "data"
) -> Column:
    """The transform named by a catalog code, as one expression over the long table.

    Codes: 1 level, 2 difference, 3 second difference, 4 log, 5 log difference, 6 second
    log difference. Rows must lie on a gap-free grid. An unknown code fails the job.
    """
    w = W.partitionBy(*by).orderBy(order)
    raw, log = _steps(value, w), _steps(safe_ln(value), w)
    choices = {"1": raw[0], "2": raw[1], "3": raw[2], "4": log[0], "5": log[1], "6": log[2]}
    if isinstance(code, str):
        if code not in choices:
            raise ValueError(f"unknown transform code: {code}")
        return choices[code]
    picked = None
    for name, expr in choices.items():
        picked = F.when(code == name, expr) if picked is None else picked.when(code == name, expr)
    unknown = F.raise_error(F.concat(F.lit("unknown transform code: "), F.coalesce(code, F.lit("NULL"))))
    return picked.otherwise(unknown.cast("double"))


def transform(
    df: DataFrame, code: str, by: Sequence[str] = ("series_id",), value: str = "value"
) -> DataFrame:
    """Apply one transform to every series."""
    return df.withColumn(value, transform_code(F.col(value), code, by))


def transform_by_catalog(
    df: DataFrame, catalog: DataFrame, by: Sequence[str] = ("series_id",), value: str = "value"
) -> DataFrame:
    """Apply each series' own transform; a series absent from the catalog is an error."""
    codes = catalog.select("series_id", F.col("transform").alias("_code"))
    joined = df.join(codes, "series_id", "left")
    changed = joined.withColumn(value, transform_code(F.col(value), F.col("_code"), by))
    return changed.select(*df.columns)


def rolling_compound(
    df: DataFrame,
    by: Sequence[str],
    value: str = "value",
    name: str = "compound",
    rows: int = 12,
    order: str = "data",
) -> DataFrame:
    """Compounded percent growth over ``rows`` rows; null until all of them are present."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    grown = (F.product(F.col(value) / 100 + 1).over(w) - 1) * 100
    return df.withColumn(name, F.when(F.count(value).over(w) == rows, grown))
