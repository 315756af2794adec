"""SimHash near-duplicates, linked with pivot distance tables.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles. Two
fingerprints link when they differ in at most ``RADIUS`` bits.

Distances to fixed reference fingerprints (pivots) are computed once per fingerprint. By the
triangle inequality two fingerprints within the radius have distances to any pivot that
differ by the radius at most, so a pair whose largest coordinate difference is greater is
discarded without comparing it. To spread the tables over tasks without losing a pair, the
64 bits are cut into blocks: at most ``RADIUS`` of them can differ, so two linked
fingerprints agree in the rest, and each choice of agreeing blocks is one grouping key.
Inside a group the pivots discard and the survivors are verified. A group that is too large
for one task is cut into parts, and every pair of parts becomes a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import fresh, text_key, text_or_empty, tidy
from tidegauge.llm.components import components
from tidegauge.session import settle

SHINGLE = 4
RADIUS = 4
SEED = 42
PART = 8192  # fingerprints of one group that one task compares
SMALL = 16

# rows 1 to 16 of the Hadamard matrix of order 64: any two are 32 bits apart
PIVOTS = np.array(
    [sum(((i & j).bit_count() & 1) << j for j in range(64)) for i in range(1, 17)], np.uint64
)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the shingles' hashes, repeats included; 0 for a text without words.

    A-Z are lowered, words are split at ASCII white space; fewer words than a shingle make
    one shingle.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    @tidy
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_key`` and ``fp`` of each row, written to the shared folder."""
    return settle(
        docs.select("doc_id", text_key().alias("text_key"), fingerprint_column(text_or_empty(), shingle).alias("fp")),
        "fingerprints",
    )


def block_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Masks of which two fingerprints within the radius agree in one at least.

    More rows take more blocks, so that unrelated fingerprints seldom share a group: with
    radius 4 the keys have 20, 27 or 32 bits.
    """
    agree = 2 if rows < 1 << 22 else 3 if rows < 1 << 29 else 4
    parts = np.array_split(np.arange(64), radius + agree)
    blocks = [sum(1 << int(b) for b in part) for part in parts]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """The table of Hamming distances to the pivots, one row a fingerprint."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _close(fps, table, left, right, radius):
    """Which pairs pass the pivots and then the exact comparison."""
    keep = np.flatnonzero(np.abs(table[left] - table[right]).max(axis=1) <= radius)
    exact = np.bitwise_count(fps[left[keep]] ^ fps[right[keep]]) <= radius
    return left[keep[exact]], right[keep[exact]]


def forest(fps: np.ndarray, table: np.ndarray, radius: int = RADIUS):
    """Links that connect what is connected within one group: a tree for each component.

    The first pivot's distance orders the fingerprints, so only a window of it is looked at.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left = np.arange(len(fps))
    out = []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            first = table[left, 0]
            lo = np.searchsorted(first, table[x, 0] - radius)
            hi = np.searchsorted(first, table[x, 0] + radius, side="right")
            window = left[lo:hi]
            _, hit = _close(fps, table, np.full(window.size, x), window, radius)
            if hit.size:
                out.append(np.stack([np.full(hit.size, x), hit]))
                left = left[~np.isin(left, hit, assume_unique=True)]
                queue.extend(hit.tolist())
    pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return order[pairs[0]], order[pairs[1]]


def _group_links(keys: np.ndarray, fps: np.ndarray, radius: int):
    """Links within each run of equal keys."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(cuts)
    out = []
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    if few.any():
        f, k = fps[few], keys[few]
        table = pivot_distances(f)
        for step in range(1, SMALL):
            left = np.flatnonzero(k[step:] == k[:-step])
            if not left.size:
                break
            a, b = _close(f, table, left, left + step, radius)
            out.append((f[a], f[b]))
    for i in np.flatnonzero(sizes > SMALL):
        f = np.unique(fps[cuts[i] : cuts[i + 1]])
        a, b = forest(f, pivot_distances(f), radius)
        out.append((f[a], f[b]))
    return out


def links(prints: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints: every component stays connected."""
    distinct = settle(prints.select("fp").distinct(), "distinct")
    masks = block_masks(distinct.count(), radius)
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))
    each = distinct.select("fp", F.posexplode(keys).alias("t", "k"))
    large = each.groupBy("t", "k").count().filter(F.col("count") > part)
    parts = F.ceil(F.col("count") / part).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    others = F.when(
        F.col("count").isNotNull(),
        F.transform(
            F.sequence(F.lit(0), parts - 1),
            lambda j: F.least(own, j) * parts + F.greatest(own, j),
        ),
    ).otherwise(F.array(F.lit(0)))
    grouped = each.join(large, ["t", "k"], "left").select(
        "fp", "t", "k", F.explode(others).alias("p")
    ).select("fp", F.xxhash64("t", "k", "p").alias("g"))

    def compare(frames):
        rest_g, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for frame in frames:
            g = np.concatenate([rest_g, frame["g"].to_numpy(np.int64)])
            f = np.concatenate([rest_f, frame["fp"].to_numpy(np.int64).view(np.uint64)])
            cut = int(np.searchsorted(g, g[-1])) if g.size else 0
            rest_g, rest_f = g[cut:], f[cut:]
            for a, b in _group_links(g[:cut], f[:cut], radius):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        for a, b in _group_links(rest_g, rest_f, radius):
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return grouped.repartition("g").sortWithinPartitions("g").mapInPandas(tidy(compare), "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp`` and ``component_id``, the smallest ``doc_id`` that links reach from it."""
    firsts = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(prints, radius))
    rooted = firsts.join(roots, firsts["fp"] == roots["a"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, one row a row of ``docs``.

    A null text is empty; empty texts have the fingerprint zero and link like any other.
    ``component_id`` is null only where no row of a component has an id. Other columns of
    ``docs`` are not read.
    """
    prints = fingerprints(docs, shingle)
    return prints.join(classes(prints, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest ``doc_id``."""
    prints = fingerprints(docs, shingle)
    placed = settle(
        prints.join(classes(prints, radius), "fp").select(
            "doc_id", "text_key", "fp", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")
        ),
        "placed",
    )
    # of rows that share the smallest id, the one with the smallest text hash stays
    staying = placed.filter("stays").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(
        F.min("text_key").alias("_key"), F.count("*").alias("n")
    )
    one, none, key = on = fresh(docs.columns, "_id", "_none", "_key")
    keys = staying.select(
        F.coalesce("component_id", F.lit(0)).alias(one), F.col("component_id").isNull().alias(none), F.col("_key").alias(key)
    )
    tagged = docs.withColumns({one: F.coalesce("doc_id", F.lit(0)), none: F.col("doc_id").isNull(), key: text_key()})
    kept = tagged.join(keys, on, "left_semi")
    if staying.filter("n > 1").limit(1).count():
        kept = kept.dropDuplicates(on)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
