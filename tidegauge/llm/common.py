"""Helpers the operators of this subpackage share.

Rows are told apart by ``(doc_id, text_key)``, the id and a hash of the text: repeated rows
then get the same answer, and rows that share an id but not a text keep their own.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 8 << 20  # of rows that a Python worker gets at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Its session hands rows to Python in batches of ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """64-bit hash of the text; a null text counts as empty."""
    return F.xxhash64(text_or_empty(name))


def keyed(docs: DataFrame) -> DataFrame:
    """Only ``doc_id``, ``text_key`` and ``text`` (null: empty) of the rows."""
    return docs.select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text"))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column of the table has it."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order given."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def chunks(texts, most_bytes: int = 2_000_000):
    """Slices of a list of texts that hold about ``most_bytes`` characters each, in order.

    Whole texts only: a longer text makes a slice of its own. Keeps numpy arrays small
    whatever the Arrow batch holds.
    """
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > most_bytes:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


_kept: dict[str, dict] = {}


def trim() -> None:
    """Give memory that Python and Arrow hold without need back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def worker_memory(owner: str) -> dict:
    """What one operator remembers in this Python worker from task to task.

    Workers serve one operator after the other; what the others remember is dropped.
    """
    others = [o for o in _kept if o != owner]
    for other in others:
        del _kept[other]
    if others:
        trim()
    return _kept.setdefault(owner, {})


def tidy(run):
    """A function of batches that begins without other operators' memory and leaves none."""

    @functools.wraps(run)
    def wrapped(batches):
        worker_memory("")
        yield from run(batches)
        trim()

    return wrapped


class Remembered(dict):
    """A dictionary of words that is emptied when its words exceed ``most_bytes``.

    The words met first, ``least_bytes`` of them (a quarter of all at most), stay: frequent
    words are met early.
    """

    def __init__(self, most_bytes: int = 40_000_000, each: int = 180, least_bytes: int = 0):
        super().__init__()
        self.most_bytes, self.each, self.held = most_bytes, each, 0
        self.least_bytes, self.first = min(least_bytes, most_bytes // 4), (0, 0)

    def keep(self, word, value, size: int = 0):
        """Remember the value, which is returned; an entry counts ``each`` bytes, its word's and ``size``."""
        cost = self.each + len(word) + size
        if self.held + cost > self.most_bytes:
            self.shrink()
        self.held += cost
        self[word] = value
        if self.held <= self.least_bytes:
            self.first = len(self), self.held
        return value

    def shrink(self):
        """Forget all but the words met first."""
        n, self.held = self.first
        stay = list(islice(self.items(), n))
        self.clear()
        self.update(stay)


class WordHashes(Remembered):
    """Word to its 64-bit hash."""

    def __missing__(self, word: str) -> int:
        return self.keep(word, xxhash.xxh64_intdigest(word))


def bits_of(hashes: DataFrame, column: str, log2_bits: int) -> bytes:
    """A bitmap of ``2 ** log2_bits`` bits with the top bits of each hash set.

    At most ``2 ** (log2_bits - 6)`` numbers reach the driver, however many rows there are.
    A hash is in the set only if its bit is set; the converse needs an exact check.
    """
    place = F.shiftrightunsigned(F.col(column), 64 - log2_bits)
    words = (
        hashes.select(place.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        .toPandas()
    )
    bitmap = np.zeros(1 << (log2_bits - 6), np.uint64)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return bitmap.tobytes()


def in_bits(keys: np.ndarray, bitmap: bytes, log2_bits: int) -> np.ndarray:
    """Whether each signed 64-bit key's bit is set in a bitmap made by ``bits_of``."""
    bits = np.frombuffer(bitmap, np.uint64)
    at = keys.view(np.uint64) >> np.uint64(64 - log2_bits)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_be_in(key: Column, bitmap: bytes, log2_bits: int) -> Column:
    """``in_bits`` of a column."""
    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bits(keys.to_numpy(np.int64), bitmap, log2_bits))

    return may(key)
