"""Calendar grids: downsampling, reindexing, upsampling and fills.

Raw rows meet a partial aggregate first, so a hot series is reduced to at most one row per
day or month before any shuffle by series. Every window below therefore works on a group
whose size is the length of the calendar, not the number of raw rows.

Gaps are opened from each row to the next (``lead`` then ``sequence``): one shuffle by the
key serves the grid and every later window on that key. No calendar is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions import ceil_month, month_start

MONTH = "interval 1 month"


def _months(lo: Column, hi: Column) -> Column:
    """Month starts from ``lo`` to ``hi``; no rows when the range is empty."""
    return F.when(lo <= hi, F.sequence(lo, hi, F.expr(MONTH)))


def _open_gaps(
    df: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    first: Column,
    last: Column,
    carry: bool = False,
) -> DataFrame:
    """One row per key and month from ``first`` to ``last``.

    A row covers the months from its own slot (the first month start on or after its date)
    up to the next row's slot. Its value stays in its own month only, and only if its date
    is a month start; with ``carry`` it is repeated until the next row.
    """
    w = W.partitionBy(*by).orderBy("data")
    slot = ceil_month(F.col("data"))
    edges = df.select(
        *by,
        "data",
        *values,
        slot.alias("_slot"),
        F.lag("data").over(w).isNull().alias("_is_first"),
        F.lead(slot).over(w).alias("_next"),
        first.alias("_first"),
        last.alias("_last"),
    )
    lo = F.when(F.col("_is_first"), F.col("_first")).otherwise(F.col("_slot"))
    hi = F.least(F.coalesce(F.add_months("_next", -1), F.col("_last")), F.col("_last"))
    grid = edges.withColumn("_month", F.explode(_months(lo, hi)))
    own = F.col("_month") >= F.col("_slot") if carry else F.col("_month") == F.col("data")
    return grid.select(
        *by,
        F.col("_month").alias("data"),
        *[F.when(own, F.col(v)).alias(v) for v in values],
    )


def _extent(df: DataFrame, by: Sequence[str], scope: str) -> tuple[Column, Column]:
    """First and last date: of the key (``series``) or of the whole table (``panel``).

    The panel extent is a scalar subquery over the date column alone.
    """
    if scope == "panel":
        dates = df.agg(F.min("data").alias("lo"), F.max("data").alias("hi"))
        return dates.select("lo").scalar(), dates.select("hi").scalar()
    if scope != "series":
        raise ValueError(f"unknown scope: {scope}")
    w = W.partitionBy(*by)
    return F.min("data").over(w), F.max("data").over(w)


def asfreq_month(
    df: DataFrame, by: Sequence[str], values: Sequence[str] = ("value",), scope: str = "panel"
) -> DataFrame:
    """Conform to the month-start grid; rows not dated on the 1st are discarded.

    The grid runs from the first month start on or after the earliest date. ``scope`` says
    whether all keys share one span (``panel``) or each has its own (``series``). Keys must
    be unique per date.
    """
    lo, hi = _extent(df, by, scope)
    return _open_gaps(df, by, values, ceil_month(lo), month_start(hi))


def month_mean(
    df: DataFrame, by: Sequence[str], values: Sequence[str] = ("value",), scope: str = "series"
) -> DataFrame:
    """Mean per month, nulls skipped; empty months inside the span become null rows."""
    cells = df.groupBy(*by, month_start(F.col("data")).alias("data")).agg(
        *[F.avg(v).alias(v) for v in values]
    )
    lo, hi = _extent(cells, by, scope)
    return _open_gaps(cells, by, values, lo, hi)


def month_first(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """First row of each month, with its own date and value, null or not."""
    return df.groupBy(*by, month_start(F.col("data")).alias("_month")).agg(
        F.min("data").alias("data"),
        F.min_by(value, "data").alias(value),
    ).drop("_month")


def month_last(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Last non-null row of each month, re-dated to the 1st."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, month_start(F.col("data")).alias("_month"))
        .agg(F.max_by(value, "data").alias(value))
        .select(*by, F.col("_month").alias("data"), value)
    )


def upsample_ffill(
    df: DataFrame, by: Sequence[str], values: Sequence[str] = ("value",), extend: int = 0
) -> DataFrame:
    """Low-frequency rows to months, each repeated until the next row.

    Ends at the last row's month, or ``extend`` months later.
    """
    lo, hi = _extent(df, by, "series")
    return _open_gaps(
        df, by, values, month_start(lo), month_start(F.add_months(hi, extend)), carry=True
    )


def fill_both(
    df: DataFrame, by: Sequence[str], values: Sequence[str] = ("value",), order: str = "data"
) -> DataFrame:
    """Backward fill, then forward fill.

    The backward fill reads later months, so early rows see the future. It runs on the
    reversed order: a frame that grows costs one step per row, one that shrinks does not.
    """
    before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns(
        {
            v: F.coalesce(
                F.last(v, ignorenulls=True).over(after), F.last(v, ignorenulls=True).over(before)
            )
            for v in values
        }
    )


def fill_forward(
    df: DataFrame, by: Sequence[str], values: Sequence[str] = ("value",), order: str = "data"
) -> DataFrame:
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def forecast_period(last: DataFrame, by: Sequence[str], h: int) -> DataFrame:
    """The ``h`` months after each key's last date (column ``last``)."""
    months = F.sequence(
        F.add_months(month_start(F.col("last")), 1),
        F.add_months(month_start(F.col("last")), h),
        F.expr(MONTH),
    )
    return last.select(*by, F.posexplode(months).alias("step", "data")).withColumn(
        "step", F.col("step") + 1
    )
