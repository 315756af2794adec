"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; the hash's top bits choose a bin and the bin keeps
its smallest hash. An empty bin takes the value of a full one that a fixed random order of
the bins, its own, names first (optimal densification). A fingerprint stores the low
``BITS`` bits of every bin, packed; equal bits by chance are taken out of the estimate. The
bits are taken after mixing in the bin's number, so that a value which densification has
copied to many bins agrees with another by chance in one bin of sixteen, not in all or none.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import WordHashes, text_key, text_or_empty, tidy

SHINGLE = 5
LOG2_BINS = 9
BINS = 1 << LOG2_BINS
BITS = 4
PART_BYTES = 64 << 20  # of text in a range of ids
ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@functools.cache
def probe_order() -> np.ndarray:
    """For each bin, all bins in a random order of its own; the same everywhere."""
    order = np.random.Generator(np.random.PCG64(7))
    return np.stack([order.permutation(BINS) for _ in range(BINS)]).astype(np.int16)


def shingle_hashes(text: str, known: WordHashes) -> np.ndarray:
    """Hashes of the word shingles; fewer words than a shingle make one, none make none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(" ".join(words), 1)], np.uint64)
    tokens = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(tokens) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += tokens[i : i + n] * ODD[i]
    total = (total ^ (total >> np.uint64(32))) * ODD[1]
    total = (total ^ (total >> np.uint64(29))) * ODD[2]
    return total ^ (total >> np.uint64(32))


def sketch(hashes: np.ndarray) -> np.ndarray | None:
    """``BITS`` bits of every bin, densified; None for no shingles."""
    if not len(hashes):
        return None
    ordered = np.sort(hashes)
    place = (ordered >> np.uint64(64 - LOG2_BINS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    full = np.zeros(BINS, bool)
    full[place[first]] = True
    value = np.zeros(BINS, np.uint64)
    value[place[first]] = ordered[first]
    empty = np.flatnonzero(~full)
    at, width = 0, 8
    order = probe_order()
    while empty.size:
        tries = order[empty, at : at + width]
        hit = full[tries]
        some = hit.any(axis=1)
        source = tries[np.arange(empty.size), hit.argmax(axis=1)]
        value[empty[some]] = value[source[some]]
        empty = empty[~some]
        at, width = at + width, width * 4
    value = (value ^ (np.arange(BINS, dtype=np.uint64) * ODD[0])) * ODD[3]
    return (value >> np.uint64(64 - BITS)).astype(np.uint8)


def packed(value: np.ndarray | None) -> str:
    """Two bins a byte, as hex; an empty text has the empty fingerprint."""
    return "" if value is None else (value[0::2] << 4 | value[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated share of common shingles, between 0 and 1; two empty texts are alike."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 1 / (1 << BITS)
    return float(np.clip(((a == b).mean() - chance) / (1 - chance), 0, 1))


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def ranges(docs: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """How many ranges of ids hold ``part_bytes`` of text each, the session's partitions at least."""
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_or_empty()).cast("long"))).head()[0] or 0
    return max(own, -(-size // part_bytes), 1)


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt to ranges of ``doc_id``, each followed by the first row of the next range.

    Sorted by ``part``, ``after`` (1 for the row of the next range) and id, null ids first.
    The rows are exchanged once. Range bounds and first rows are ``parts`` values at most.
    """
    rows = docs.select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text"))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts))).head()[0] or [])) if shares else []

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(bounds, np.int64), ids.fillna(-(1 << 63)).to_numpy(np.int64), side="left")
        return pd.Series(at.astype(np.int32))

    rows = rows.withColumn("part", part_of(F.col("doc_id")))
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text_key")
    firsts = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.min(key).alias("first")).collect())
    if not firsts:
        return rows.withColumn("after", F.lit(0))
    edges = [(f["doc_id"], f["text_key"], firsts[i - 1][0]) for i, (_, f) in enumerate(firsts)]
    edge = docs.sparkSession.createDataFrame(edges, "e_id long, e_key long, before int")
    dealt = F.array(F.struct("part", F.lit(0).alias("after")))
    joined = rows.join(F.broadcast(edge), F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("text_key") == F.col("e_key")), "left")
    both = F.when(F.col("before").isNull(), dealt).otherwise(
        F.concat(dealt, F.array(F.struct(F.col("before").alias("part"), F.lit(1).alias("after"))))
    )
    return (
        joined.select("doc_id", "text_key", "text", F.explode(both).alias("p"))
        .select("doc_id", "text_key", "text", "p.part", "p.after")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "after", "doc_id", "text_key")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, one row a row of ``docs``.

    The edited text replaces the last half of the characters by the beginning of the next
    document in order of ``doc_id`` (after the last comes the first; null ids come first;
    rows of one id are ordered by the hash of their text). Null texts are empty.
    """
    parts = ranges(docs)

    def walk(frames):
        known = WordHashes()
        held = None  # a row whose next one has not come yet
        out = []

        def finish(row, text, own):
            n = len(row[1])
            edited = row[1][: n - n // 2] + text[: n // 2]
            new = row[2] if edited == row[1] else sketch(shingle_hashes(edited, known))
            out.append(
                (
                    row[0], n, hashlib.sha256(edited.encode()).hexdigest(), packed(row[2]), packed(new),
                    likeness(row[2], new), likeness(row[2], own),
                )
            )

        for frame in frames:
            for doc, text, part, after in zip(frame["doc_id"].astype("Int64"), frame["text"], frame["part"], frame["after"]):
                if after and held is None:
                    continue  # a repeat of the next range's first row
                own = sketch(shingle_hashes(text, known))
                if held is not None:
                    finish(held[0], text, own)
                held = None if after else ((doc, text, own), part)
            if out:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    def _frame(rows):
        got = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
        got["doc_id"] = got["doc_id"].astype("Int64")
        return got

    return in_order(docs, parts).mapInPandas(tidy(walk), RESULT)
