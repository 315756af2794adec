"""Long to wide: the N-way joins by date.

Joining N series on their date is one aggregate over the union of their long rows. A hot
date or series is reduced by the partial aggregate, and there is one shuffle, not N.

A few series are spelled out, one conditional aggregate each. Thousands of them would be past
generated code, so each series gets a slot: the aggregate fills blocks of ``LANES`` slots,
whose code has one length for any number of series, and a second one puts a date's blocks in
line. A date's row holds one number per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 64  # slots of a block, and how many series are still spelled out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def to_wide(
    long: DataFrame,
    ids: Sequence[str],
    by: Sequence[str] = (),
    anchors: Sequence[str] | None = None,
    key: str = "series_id",
) -> DataFrame:
    """One row per date, one column per series.

    Without ``anchors`` this is the full outer join of all series. With them it is the left
    join onto the anchors: dates on which no anchor has a row are dropped, but an anchor row
    with a null value still counts. (key, date) must be unique. Above ``LANES`` series the
    values are doubles.
    """
    if len(ids) > LANES:
        slots = to_slots(long, ids, by, anchors, key)
        # as text: thousands of column objects take longer to make than the job to run
        named = [f"cells[{i}] AS {quoted(name)}" for i, name in enumerate(ids)]
        return slots.selectExpr(*map(quoted, by), "data", *named)
    cells = [F.max(F.when(F.col(key) == i, F.col("value"))).alias(i) for i in ids]
    wanted = long.filter(F.col(key).isin(*ids, *(anchors or ())))
    if anchors is None:
        return wanted.groupBy(*by, "data").agg(*cells)
    held = F.max(F.col(key).isin(*anchors)).alias("_held")
    return wanted.groupBy(*by, "data").agg(*cells, held).filter("_held").drop("_held")


def _numbered(long: DataFrame, ids: Sequence[str], anchors: Sequence[str] | None, key: str) -> DataFrame:
    """The rows of the wanted series with ``_slot`` and ``_held`` (an anchor's row)."""
    held = set(ids if anchors is None else anchors)
    slot_of = {name: i for i, name in enumerate(ids)}
    if len(slot_of) < len(ids):
        raise ValueError("a series is named twice")
    places = [(name, slot_of.get(name), name in held) for name in dict.fromkeys([*ids, *held])]
    # a stated list of names: Spark knows its size when it chooses the join
    named = long.sparkSession.createDataFrame(places, "_id string, _slot int, _held boolean")
    return long.join(named, F.col(key).cast("string") == F.col("_id")).drop("_id")


def _lanes(slot: Column, value: Column) -> list[Column]:
    lane = slot % LANES
    return [F.max(F.when(lane == j, value.cast("double"))).alias(f"_{j}") for j in range(LANES)]


def to_slots(
    long: DataFrame,
    ids: Sequence[str],
    by: Sequence[str] = (),
    anchors: Sequence[str] | None = None,
    key: str = "series_id",
) -> DataFrame:
    """One row per date with ``cells``: the values of ``ids``, in their order.

    The join of ``to_wide`` for any number of series: neither its plan nor its generated code
    grows with them. A date without a value of a series has a null there; ids without rows
    are null throughout. (key, date) must be unique.
    """
    wanted = _numbered(long, ids, anchors, key)
    block = F.floor(F.col("_slot") / LANES).cast("int").alias("_block")
    blocks = wanted.groupBy(*by, "data", block).agg(
        *_lanes(F.col("_slot"), F.col("value")), F.max("_held").alias("_held")
    )
    cells = F.array(*[F.col(f"_{j}") for j in range(LANES)])
    lines = blocks.groupBy(*by, "data").agg(
        # an anchor outside the ids has no block of its own: its key is null and it is left out
        F.collect_list(F.when(F.col("_block").isNotNull(), F.struct("_block", cells.alias("_cells")))).alias("_blocks"),
        F.max("_held").alias("_held"),
    )
    if anchors is not None:
        lines = lines.filter("_held")
    count = -(-len(ids) // LANES)
    found = F.map_from_entries("_blocks")
    gap = F.array_repeat(F.lit(None).cast("double"), LANES)
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.coalesce(F.element_at("_found", b), gap)
    )
    lined = lines.withColumn("_found", found).withColumn("cells", F.slice(F.flatten(dense), 1, len(ids)))
    return lined.select(*by, "data", "cells")


def keep_anchor_dates(
    long: DataFrame, anchors: Sequence[str], by: Sequence[str] = (), key: str = "series_id"
) -> DataFrame:
    """The left join in long form: rows on dates that some anchor series has."""
    dates = long.filter(F.col(key).isin(*anchors)).groupBy(*by, "data").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return long.join(dates, [*by, "data"], "left_semi").select(*long.columns)
