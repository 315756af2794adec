"""Landed rows kept by month, with a ledger of the files they were read from.

A refresh lists the landing folder, reads only files that the ledger does not know (by path,
size and time of change), and writes anew only the months these files touch, together with
months that held rows of files changed or removed since. One manifest then names the new
ledger and, for every month, the folder that holds it: a refresh that dies changes nothing,
and readers never see a month half written. The manifest grows with the calendar and the
ledger with the files, neither with the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.schema import LONG, require_unique
from tidegauge.session import settle
from tidegauge.sources import publish

Reader = Callable[..., DataFrame]
IDENTITY = ["file", "size", "changed"]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's files: ``path`` to open, and what identifies their content. None is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(
        "path",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("changed"),
    )


def _month(day: str) -> Column:
    """Months since year 0; rows without a date are kept together."""
    return F.coalesce(F.year(day) * 12 + F.month(day) - 1, F.lit(0))


def _months(rows: DataFrame) -> set[int]:
    """The months of some rows: as many as the calendar has."""
    return {r["month"] for r in rows.select("month").distinct().collect()}


def _stored(spark: SparkSession, store: str, months: dict[str, str]) -> DataFrame:
    """Rows of the given months, with their ``file``."""
    schema = LONG.simpleString()[len("struct<") : -1].replace(":", " ") + ", file string"
    if not months:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{store}/{folder}/rows/month={m}" for m, folder in months.items()])


def rows(spark: SparkSession, store: str) -> DataFrame:
    """The long rows as the last refresh left them."""
    _, state = publish.latest(spark, store)
    return _stored(spark, store, state.get("months", {})).select(*LONG.fieldNames())


def refresh(spark: SparkSession, folder: str, reader: Reader, store: str) -> DataFrame:
    """Bring ``store`` up to the files of ``folder``, and return all its rows.

    ``reader`` is one of ``payloads``' readers of long rows. Raises, with the store as it was,
    when a file cannot be read, when a series has two rows for a date, or when another
    refresh came first.
    """
    number, state = publish.latest(spark, store)
    found = settle(listing(spark, folder), "listing")
    if state:
        known = spark.read.parquet(f"{store}/{state['files']}")
        new, gone = found.join(known, IDENTITY, "left_anti"), known.join(found, IDENTITY, "left_anti")
    else:
        new, gone = found, found.limit(0)
    paths = [r["path"] for r in new.select("path").collect()]
    lost = settle(gone.select("file"), "gone")
    months = dict(state.get("months", {}))
    if state and not paths and lost.isEmpty():
        return rows(spark, store)

    run = f"{publish.RUNS}/{uuid.uuid4().hex}"
    stored = _stored(spark, store, months).withColumn("month", _month("data"))
    touched = set() if lost.isEmpty() else _months(stored.join(lost, "file", "left_semi"))
    fresh = _stored(spark, store, {})
    if paths:
        fresh = reader(spark, paths, base=folder).select(*LONG.fieldNames(), "file")
    fresh = settle(fresh.withColumn("month", _month("data")), "fresh")
    touched |= _months(fresh)
    older = _stored(spark, store, {m: f for m, f in months.items() if int(m) in touched})
    kept = older.join(lost, "file", "left_anti").withColumn("month", _month("data"))
    merged = settle(require_unique(kept.unionByName(fresh), ["series_id", "data"]), "merged")
    whole = merged.hint("rebalance", F.col("month"))
    whole.write.partitionBy("month").parquet(f"{store}/{run}/rows")
    found.drop("path").write.parquet(f"{store}/{run}/files")
    left = _months(merged)
    months = {m: f for m, f in months.items() if int(m) not in touched} | {str(m): run for m in left}
    if not publish.commit(spark, store, number + 1, {"files": f"{run}/files", "months": months}):
        raise RuntimeError(f"{store} was refreshed by another run")
    return rows(spark, store)
