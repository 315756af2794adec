"""Table writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.schema import TRACKING


def write_wide(df: DataFrame, path: str) -> None:
    """Replace a wide daily or monthly table, one row per date."""
    df.write.mode("overwrite").parquet(path)


def write_long(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("freq", "year")) -> None:
    """Replace the long table, in folders readers can prune.

    ``rebalance`` gathers rows by folder and lets AQE split a folder that is too large for
    one task, so a hot frequency or year does not end up in one file.
    """
    table = df.withColumn("year", F.year("data")) if "year" in partition_by else df
    table.hint("rebalance", *[F.col(c) for c in partition_by]).write.mode("overwrite").partitionBy(
        *partition_by
    ).parquet(path)


def write_forecast(df: DataFrame, path: str) -> None:
    """Replace the current forecast; the run stamp is kept in the log only."""
    df.drop("previsao").write.mode("overwrite").parquet(path)


def append_tracking(df: DataFrame, path: str) -> None:
    """Append to the headerless log; the order of columns is the layout."""
    names = TRACKING.fieldNames()
    df.select(*[F.col(n).cast("string") for n in names]).write.mode("append").csv(path)
