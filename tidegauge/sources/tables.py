"""Catalog, panel and tracking tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.schema import CATALOG_HEADER, TRACKING


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per series; every field stays text."""
    raw = spark.read.csv(path, header=True)
    return raw.select(
        *[F.col(f"`{old}`").cast("string").alias(new) for old, new in CATALOG_HEADER.items()]
    )


def read_panel(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; naming the columns keeps the scan to them."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """The forecast log, typed. Appended parts have no header; a header line is skipped."""
    names = TRACKING.fieldNames()
    raw = spark.read.schema(", ".join(f"{n} STRING" for n in names)).csv(path)
    rows = raw.filter(F.col("data") != "data")
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in TRACKING])


def route_by_freq(raw: DataFrame, catalog: DataFrame, source: str | None = None) -> DataFrame:
    """Attach each row's frequency and source from the catalog.

    No broadcast hint: Spark broadcasts the catalog by its size and joins by key beyond.
    """
    wanted = catalog.select("series_id", "source", "freq")
    if source is not None:
        wanted = wanted.filter(F.col("source") == source)
    return raw.join(wanted, "series_id")


def backfill_windows(spans: DataFrame, by: Sequence[str], years: int = 5) -> DataFrame:
    """Consecutive request windows ``[s, s + years - 1 day]`` from ``lo`` up to ``hi``.

    ``spans`` has the key columns and the dates ``lo`` and ``hi``.
    """
    step = F.make_ym_interval(F.lit(years), F.lit(0))
    # the next window starts only if it lies strictly before hi
    starts = F.when(
        F.col("lo") < F.col("hi"), F.sequence("lo", F.date_sub("hi", 1), step)
    )
    return spans.select(
        *by, F.posexplode(starts).alias("window_no", "window_start")
    ).withColumn("window_end", F.date_sub(F.add_months("window_start", 12 * years), 1))
