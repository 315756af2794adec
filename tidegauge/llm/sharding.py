"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by the hash of their text, so that equal texts lie together, then by id.
Splitters are found by probing: each round lays equally spaced candidate boundaries into
every interval that still holds a splitter and counts the exact bytes between them, summed
on each partition before they meet. An interval that holds one hash alone (a group of equal
texts) is probed by id instead. Rounds end when every splitter is within the tolerance, or
one row away; then the rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import text_or_empty
from tidegauge.session import settle

SHARDS = 40
OVERHEAD = 16  # bytes a row
TOLERANCE = 0.001  # of a shard's bytes
PROBES = 64  # candidate boundaries in an interval
SLICE = 200_000  # rows of a shard that one window numbers
KEY = ("k0", "k1", "k2")  # text hash, id, row


@dataclass
class Search:
    """Where a splitter may lie: key prefix, interval of the next part, bytes below it."""

    target: int
    prefix: tuple[int, ...] = ()
    low: int = 0
    high: int = 0
    below: int = 0
    found: tuple[int, ...] | None = None

    @property
    def place(self):
        return self.prefix, self.low, self.high


def key_table(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32`` and the key, written to the shared folder.

    Ids outside 0 .. 2**62 (and null ones) are ordered by row alone. Key parts are not
    negative, so that differences do not overflow.
    """
    text = text_or_empty()
    number = F.when(F.col("doc_id").between(0, (1 << 62) - 1), F.col("doc_id").cast("long")).otherwise(F.lit(0))
    return settle(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 2).alias("k0"),
            F.coalesce(number, F.lit(0)).cast("long").alias("k1"),
            F.monotonically_increasing_id().alias("k2"),
        ),
        "shard_keys",
    )


def _width(low: int, high: int) -> int:
    return max(1, -(-(high - low + 1) // PROBES))


def _count(keys: DataFrame, places) -> dict:
    """Bytes and key bounds between the probes of each place: at most ``PROBES`` rows a place."""
    where, bucket = None, None
    for i, (prefix, low, high) in enumerate(places):
        part = F.col(KEY[len(prefix)])
        inside = part.between(low, high)
        for name, value in zip(KEY, prefix):
            inside &= F.col(name) == value
        at = F.expr(f"({KEY[len(prefix)]} - {low}L) div {_width(low, high)}L")
        where = F.when(inside, F.lit(i)) if where is None else where.when(inside, F.lit(i))
        bucket = F.when(inside, at) if bucket is None else bucket.when(inside, at)
    bounds = [f(c).alias(f"{n}_{c}") for c in KEY for n, f in (("min", F.min), ("max", F.max))]
    rows = (
        keys.select("size", *KEY, where.alias("w"), bucket.alias("b"))
        .filter("w is not null")
        .groupBy("w", "b")
        .agg(F.sum("size").alias("bytes"), *bounds)
        .collect()
    )
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["w"], r["b"])):
        out.setdefault(places[r["w"]], []).append(r)
    return out


def find_splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """``shards - 1`` keys, ascending: shard ``i`` holds the keys from splitter ``i`` on.

    A splitter may be shorter than the key; it then stands before all keys that begin with
    it. An empty table has the splitters of nothing, all equal.
    """
    head = keys.agg(F.sum("size").alias("n"), F.min("k0").alias("low"), F.max("k0").alias("high")).head()
    total = head["n"] or 0
    if not total:
        return [(0,)] * (shards - 1)
    near = tolerance * total / shards
    searches = [Search(total * i // shards, (), head["low"], head["high"]) for i in range(1, shards)]
    while active := [s for s in searches if s.found is None]:
        counted = _count(keys, sorted({s.place for s in active}))
        for s in active:
            below, level = s.below, len(s.prefix)
            for r in counted[s.place]:
                if below + r["bytes"] > s.target:
                    break
                below += r["bytes"]
            first = s.low + r["b"] * _width(s.low, s.high)
            after = first + _width(s.low, s.high)
            under, over = s.target - below, below + r["bytes"] - s.target
            part = KEY[level]
            single = r[f"min_{part}"] == r[f"max_{part}"]
            last = single and level == len(KEY) - 1
            if min(under, over) <= near or last:
                s.found = (*s.prefix, first if under <= over else after)
            elif single:
                following = KEY[level + 1]
                s.prefix, s.below = (*s.prefix, r[f"min_{part}"]), below
                s.low, s.high = r[f"min_{following}"], r[f"max_{following}"]
            else:
                s.low, s.high, s.below = r[f"min_{part}"], r[f"max_{part}"], below
    return sorted(s.found for s in searches)


def _from(splitter: tuple[int, ...]) -> Column:
    """The key is not below the splitter."""
    out = F.col(KEY[len(splitter) - 1]) >= splitter[-1]
    for name, value in reversed(list(zip(KEY, splitter[:-1]))):
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out


def shard_of(splitters: list[tuple[int, ...]]) -> Column:
    """Number of splitters at or below the key, by bisection."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(_from(splitters[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(splitters))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``bytes``: shards' sizes are equal but for the tolerance and one row. Null
    texts are empty. Equal texts are neighbours, and only a group that reaches over a
    boundary is split. ``slot`` numbers a shard's rows from 0 without gaps. One row a row of
    ``docs``; other columns are not read.
    """
    keys = key_table(docs)
    splitters = find_splitters(keys, shards)
    slices = max(1, -(-keys.count() // (shards * SLICE)))
    placed = keys.select("*", shard_of(splitters).cast("int").alias("shard")).withColumn(
        "slice", F.pmod(F.xxhash64("k2"), F.lit(slices)).cast("int")
    )
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))  # shards * slices rows
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "slice").orderBy(*KEY)
    return (
        placed.withColumn("own", F.row_number().over(own) - 1)
        .join(base, ["shard", "slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("own")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
