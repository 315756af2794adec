"""Spreading CPU-heavy work over the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash rows by key over at least two tasks per core.

    AQE merges partitions by their bytes. Model fitting reads few bytes and computes for
    long, so merged partitions would leave the cluster idle. Partitions of a stated number
    are not merged, as long as it differs from the session's own (equal ones are dropped
    from the plan as redundant).
    """
    spark = df.sparkSession
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(own + 1, 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *[F.col(k) for k in keys])
