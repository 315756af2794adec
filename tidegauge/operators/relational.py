"""Column lists, predicates, unions and row picks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.session import settle


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strict column list: an absent column is an error."""
    return df.select(*columns)


def pick_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tolerant column list: absent names are skipped, the given order is kept."""
    return df.select(*[c for c in columns if c in df.columns])


def assign(df: DataFrame, **columns: Column) -> DataFrame:
    """Computed columns, left to right; a later one sees the earlier ones."""
    return reduce(lambda acc, item: acc.withColumn(*item), columns.items(), df)


def is_in(column: Column, values: Iterable) -> Column:
    return column.isin(*values)


def not_in(column: Column, values: Iterable) -> Column:
    """NOT IN that keeps NULL rows."""
    return F.coalesce(~column.isin(*values), F.lit(True))


def in_year(day: Column, year: int) -> Column:
    """Calendar-year test as a date range, so it reaches the Parquet scan."""
    lo, hi = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year + 1}-01-01").cast("date")
    return (day >= lo) & (day < hi)


def at_extreme(df: DataFrame, by: Sequence[str], column: str, largest: bool = True) -> DataFrame:
    """Rows whose ``column`` equals the key's extreme, ties included.

    The extreme is a partial aggregate, and the join back is on key *and* value: rows of
    one hot key are spread by their value instead of meeting in one task.
    """
    pick_one = F.max if largest else F.min
    edge = df.groupBy(*by).agg(pick_one(column).alias(column))
    return df.join(edge.filter(F.col(column).isNotNull()), [*by, column], "left_semi").select(
        *df.columns
    )


def at_extremes(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Rows at the key's first and last ``column``, ties included, labelled in ``edge``.

    One aggregate gives both. The edges, two rows a key, are stored, so their size is known:
    Spark broadcasts them while they are small, and the rows themselves are not shuffled.
    Runs one job; ``df`` is read twice.
    """
    ends = df.groupBy(*by).agg(F.min(column).alias("_first"), F.max(column).alias("_last"))
    pairs = F.array(
        *[F.struct(F.lit(n).alias("edge"), F.col(f"_{n}").alias(column)) for n in ("first", "last")]
    )
    edges = ends.select(*by, F.inline(pairs)).filter(F.col(column).isNotNull())
    return df.join(settle(edges, "edges"), [*by, column]).select(*df.columns, "edge")


def drop_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(subset) if subset else None)


def in_period(df: DataFrame, period: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``column`` is one of the period's months (``period.data``)."""
    months = period.select(*by, F.col("data").alias(column))
    return df.join(months, [*by, column], "left_semi").select(*df.columns)


def union_all(*frames: DataFrame, fill: bool = False) -> DataFrame:
    """UNION ALL by name; ``fill`` allows different columns and fills with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)


def last_n(df: DataFrame, by: Sequence[str], order: str | Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key; Spark prunes to ``n`` per task before the shuffle."""
    columns = [order] if isinstance(order, str) else order
    w = W.partitionBy(*by).orderBy(*[F.col(c).desc() for c in columns])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def distinct_list(df: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """Sorted list of a key's distinct labels."""
    labels = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    return labels.groupBy(*by).agg(F.sort_array(F.collect_set(column)).alias(name))
