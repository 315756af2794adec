"""Benchmark decontamination with spaced seeds.

A spaced seed hashes the tokens at fixed places of a window and ignores the rest, so a
replaced token at an ignored place leaves the hash as it is. Hashes of the benchmark and of
every window of every document are joined; around each hit the two texts are compared token
by token along the hit's diagonal, and any stretch counts that is long enough and has at
least ``PER_OTHER`` equal tokens for each other one.

A phrase that many documents and items share makes every document that has it a hit of every
item. So both sides of the join carry 5 bits of each of the ``CONTEXT`` tokens on either side
of the window, and a pair is let through only if enough of these are equal (``needed``). That
drops no overlap, and pairs that are no overlap are dropped before any text is moved. What is
left of a hot hash is spread by Spark's own splitting of skewed joins.

The seeds of weight 5 hit every such stretch of 11 tokens or more. Whole items of 5 to 10
tokens need the seeds of weight 4, which are used only if the benchmark has such items. Of
fewer than five tokens all have to be equal, so those items are found by their whole hash.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import WordHashes, bits_of, chunks, fresh, text_key, text_or_empty, tidy
from tidegauge.session import settle

# places that count, five of each window; the first seed has no gaps
SEEDS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 1, 2, 5, 7), (0, 2, 3, 6, 7), (0, 3, 4, 5, 8))
# of items of 5 to 10 tokens: a window of five with any one token replaced
SHORT_SEEDS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
SHORT = 10
WHOLE = 5  # shorter items are looked for as they are
MIN_TOKENS = 13  # of an overlap; a shorter item has to match as a whole
PER_OTHER = 4  # equal tokens for one that is not: four fifths are equal
LOG2_BITS = 24

CONTEXT = 12  # tokens on each side of a window that the join looks at
CODE_BITS = 5
# codes of real tokens lie between these, so a place beyond a text equals none
BEFORE_DOC, BEYOND_ITEM = 0, 31
CODES = 30
COVERED = 11  # tokens from which on the seeds of weight 5 hit every stretch
LANES = sum(1 << (CODE_BITS * k) for k in range(CONTEXT))

# a row's id, zero if it has none, and whether it has none
ROW = "i long, no boolean, text_key long"
REGION = ["i", "no", "text_key", "start"]
HIT = ["h", "place", "left", "right"]
WORD = re.compile(r"\w+")
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
SHORT_ODD = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def seed_hashes(tokens: np.ndarray, seed: int, short: bool = False) -> np.ndarray:
    """Hash of every window of the token array under one seed."""
    places = (SHORT_SEEDS if short else SEEDS)[seed]
    n = len(tokens) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, (SHORT_ODD if short else ODD)[seed])
    for place, odd in zip(places, ODD):
        total += tokens[place : place + n] * odd
    return _mix(total)


def _all_hashes(tokens: np.ndarray, short: bool) -> list[np.ndarray]:
    """``seed_hashes`` of each seed, those for short items last."""
    made = [seed_hashes(tokens, s) for s in range(len(SEEDS))]
    return made + [seed_hashes(tokens, s, True) for s in range(len(SHORT_SEEDS))] if short else made


def contexts(tokens: np.ndarray, place, span, begin, end, absent: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens before and after windows at ``place``, the nearest in the lowest bits.

    A text takes the places from ``begin`` to ``end``; others have the code ``absent``.
    """
    sides = []
    for first, step in ((place - 1, -1), (place + span, 1)):
        packed = np.zeros(len(place), np.int64)
        for k in range(CONTEXT):
            at = first + step * k
            there = (at >= begin) & (at < end)
            token = tokens[np.where(there, at, 0)]
            code = (token >> np.uint64(40)) % np.uint64(CODES) + np.uint64(1)
            packed |= np.where(there, code.astype(np.int64), absent) << (CODE_BITS * k)
        sides.append(packed)
    return sides[0], sides[1]


def needed(size: int, span: int, min_tokens: int) -> int:
    """Equal tokens that an overlap with an item of ``size`` tokens has beside a window inside it.

    An overlap of 2m tokens or more is cut into parts of m to 2m - 1, of which one at least
    has four fifths equal, and a hit. Of that part's equal tokens some are in the window, and
    some may lie beyond the context. Zero where the seeds do not hit every part.
    """
    m = min(min_tokens, size)
    if m < min(COVERED, size):
        return 0
    return max(0, min(m - m // (PER_OTHER + 1) - span, CONTEXT - (2 * m - 1) // (PER_OTHER + 1)))


def tokens_of(text: str, hashes: WordHashes) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def benchmark_index(benchmark: DataFrame, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Items as token hashes, and their windows' hashes with item, place and context.

    Items of fewer than ``WHOLE`` tokens are among the items but have no window; those of
    none are left out.
    """

    def read(frames):
        known = WordHashes()
        for frame in frames:
            made = [tokens_of(t, known).view(np.int64) for t in frame["text"]]
            yield pd.DataFrame({"item_id": frame["item_id"], "tokens": pd.Series(made, dtype=object)})

    items = settle(
        benchmark.select("item_id", text_or_empty().alias("text"))
        .mapInPandas(tidy(read), "item_id long, tokens array<long>")
        .filter(F.size("tokens") > 0)
        .distinct(),
        "items",
    )

    def windows(frames):
        for frame in frames:
            for item, tokens in zip(frame["item_id"], frame["tokens"]):
                t = np.asarray(tokens, np.int64).view(np.uint64)
                for seed, h in zip(SEEDS + SHORT_SEEDS, _all_hashes(t, len(t) <= SHORT)):
                    place, span = np.arange(len(h)), seed[-1] + 1
                    left, right = contexts(t, place, span, 0, len(t), BEYOND_ITEM)
                    held = {"h": h.view(np.int64), "item_id": item, "item_place": place, "item_left": left, "item_right": right}
                    yield pd.DataFrame(held | {"need": needed(len(t), span, min_tokens)})

    long = items.dropna(subset=["item_id"]).filter(F.size("tokens") >= WHOLE)
    kept = "h long, item_id long, item_place int, item_left long, item_right long, need int"
    index = long.mapInPandas(tidy(windows), kept)
    return items, settle(index.dropDuplicates(), "index")


def regions(rows: DataFrame, bitmap: bytes, margin: int, short: bool, log2_bits: int = LOG2_BITS) -> DataFrame:
    """Stretches of ``rows`` (``ROW`` and ``text``) around windows whose hash may be in the benchmark.

    ``start`` and ``tokens`` of the stretch, and its hits with place and context. Two bits of a
    bitmap of fixed size are asked for each hash; the join that follows is exact. ``short``
    asks for the seeds of short items too.
    """

    def scan(frames):
        known = WordHashes()
        bits = np.frombuffer(bitmap, np.uint64)
        shift = np.uint64(64 - log2_bits)

        def maybe(h):
            at = h >> shift
            first = bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
            return first.astype(bool)

        for frame in frames:
            texts = frame["text"].tolist()
            for lo, hi in chunks(texts):
                lists = [tokens_of(t, known) for t in texts[lo:hi]]
                sizes = np.array([len(x) for x in lists])
                flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
                owner = np.repeat(np.arange(hi - lo), sizes)
                begin = np.cumsum(sizes) - sizes
                places, hashes, spans = [], [], []
                for seed, h in zip(SEEDS + SHORT_SEEDS, _all_hashes(flat, short)):
                    if not len(h):
                        continue
                    # the second bit is taken from the mixed hash
                    hit = np.flatnonzero(maybe(h))
                    hit = hit[maybe(_mix(h[hit] ^ ODD[0]))]
                    hit = hit[owner[hit] == owner[hit + seed[-1]]]
                    places.append(hit)
                    hashes.append(h[hit])
                    spans.append(np.full(len(hit), seed[-1] + 1))
                if not places:
                    continue
                place, h, span = np.concatenate(places), np.concatenate(hashes), np.concatenate(spans)
                order = np.argsort(place, kind="stable")
                place, h, span = place[order], h[order], span[order]
                if not place.size:
                    continue
                low = begin[owner[place]]
                sides = contexts(flat, place, span, low, low + sizes[owner[place]], BEFORE_DOC)
                table = np.stack([h.view(np.int64), place, *sides], axis=1)
                cut = np.flatnonzero((np.diff(place) > 2 * margin) | (np.diff(owner[place]) != 0)) + 1
                out = []
                for part in np.split(table, cut):
                    p = part[:, 1]
                    d = owner[p[0]]
                    a = max(int(p[0]) - margin, int(begin[d]))
                    b = min(int(p[-1]) + margin + 1, int(begin[d] + sizes[d]))
                    out.append(
                        (
                            frame["i"].iloc[lo + d],
                            frame["no"].iloc[lo + d],
                            frame["text_key"].iloc[lo + d],
                            a - int(begin[d]),
                            flat[a:b].view(np.int64),
                            [dict(zip(HIT, x)) for x in (part - np.array([0, a, 0, 0])).tolist()],
                        )
                    )
                yield pd.DataFrame(out, columns=["i", "no", "text_key", "start", "tokens", "hits"])

    hits = "array<struct<h long, place long, left long, right long>>"
    return rows.mapInPandas(tidy(scan), f"{ROW}, start int, tokens array<long>, hits {hits}")


def candidates(found: DataFrame, index: DataFrame) -> DataFrame:
    """Regions and items that share a hash and enough of its context, with the ``shift`` between them."""

    def unequal(one: str, other: str) -> Column:
        x = F.col(one).bitwiseXOR(F.col(other))
        folded = x
        for bit in range(1, CODE_BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, bit))
        return F.bit_count(folded.bitwiseAND(F.lit(LANES)))

    hits = found.select(*REGION, F.explode("hits").alias("x")).select(*REGION, *(F.col(f"x.{n}") for n in HIT))
    equal = 2 * CONTEXT - unequal("left", "item_left") - unequal("right", "item_right")
    joined = hits.join(index.withColumnRenamed("h", "item_h"), (F.col("h") == F.col("item_h")) & (equal >= F.col("need")))
    return joined.select(*REGION, "item_id", (F.col("place") - F.col("item_place")).cast("int").alias("shift")).distinct()


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` adjacent tokens."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size) * ODD[-1])
    for place in range(size):
        total += tokens[place : place + n] * ODD[place]
    return _mix(total)


def whole_items(rows: DataFrame, items: DataFrame, log2_bits: int = LOG2_BITS) -> DataFrame:
    """First place of each item of fewer than ``WHOLE`` tokens in each row: as ``overlaps``."""

    def hashed(frames):
        for frame in frames:
            made = [int(window_hashes(np.asarray(t, np.int64).view(np.uint64), len(t)).view(np.int64)[0]) for t in frame["tokens"]]
            yield pd.DataFrame({"item_id": frame["item_id"], "h": made, "length": [len(t) for t in frame["tokens"]]})

    wanted = settle(items.mapInPandas(tidy(hashed), "item_id long, h long, length int"), "whole")
    bitmap = bits_of(wanted, "h", log2_bits)
    sizes = sorted(r["length"] for r in wanted.select("length").distinct().collect())

    def scan(frames):
        known = WordHashes()
        bits = np.frombuffer(bitmap, np.uint64)
        for frame in frames:
            for i, no, key, text in frame.itertuples(index=False, name=None):
                tokens = tokens_of(text, known)
                for size in sizes:
                    h, first = np.unique(window_hashes(tokens, size), return_index=True)
                    at = h >> np.uint64(64 - log2_bits)
                    hit = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                    if hit.any():
                        yield pd.DataFrame(
                            {"i": i, "no": no, "text_key": key, "h": h[hit].view(np.int64), "length": size, "start": first[hit]}
                        )

    found = rows.mapInPandas(tidy(scan), f"{ROW}, h long, length int, start int").distinct()
    return found.join(wanted, ["h", "length"]).select(
        "i", "no", "text_key", "item_id", "start", "length", F.col("length").alias("matched")
    )


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, min_tokens: int = MIN_TOKENS) -> tuple[int, int, int]:
    """Start in ``doc``, length and equal tokens of the best aligned stretch; zeros if none.

    Only stretches of at least ``min_tokens`` tokens, or the whole item if it is shorter, with
    four fifths of them equal. The best has the largest sum of 1 for an equal token and -4
    for another, which is not negative exactly if four fifths are equal.
    """
    least = min(min_tokens, len(item))
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if not 0 < least <= hi - lo:
        return 0, 0, 0
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -PER_OTHER))])
    # each end's lowest start that is at least that far before it
    gain = total[least:] - np.minimum.accumulate(total[: len(total) - least])
    at = int(np.argmax(gain))
    if gain[at] < 0:
        return 0, 0, 0
    start, end = int(np.argmin(total[: at + 1])), at + least
    return start + lo + shift, end - start, int(same[start:end].sum())


def overlaps(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, unnamed: bool = False) -> DataFrame:
    """``(doc_id, text_key, item_id)`` with the best overlap: ``start``, ``length``, ``matched``.

    ``start`` counts tokens. Rows without an id are looked at only if ``unnamed``; items
    without an id have no overlap; null texts are empty; other columns are not read.
    """
    items, index = benchmark_index(benchmark, min_tokens)
    rows = (docs if unnamed else docs.filter("doc_id is not null")).select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("i"),
        F.col("doc_id").isNull().alias("no"),
        text_key().alias("text_key"),
        text_or_empty().alias("text"),
    )
    few = items.dropna(subset=["item_id"]).filter(F.size("tokens") < WHOLE)
    sizes = items.filter(F.size("tokens") >= WHOLE).agg(F.max(F.size("tokens")).alias("most"), F.min(F.size("tokens")).alias("least")).head()
    size, short = sizes["most"] or 0, (sizes["least"] or SHORT + 1) <= SHORT
    both = index.select("h").union(index.select(_mixed("h").alias("h")))
    bitmap = bits_of(both, "h", LOG2_BITS)
    found = settle(regions(rows, bitmap, max(size, SEEDS[-1][-1] + 1), short), "regions")
    one, lined = REGION, candidates(found, index)

    @F.pandas_udf("start int, length int, matched int")
    def verify(tokens: pd.Series, item: pd.Series, shift: pd.Series) -> pd.DataFrame:
        got = [best_overlap(np.asarray(a), np.asarray(b), int(s), min_tokens) for a, b, s in zip(tokens, item, shift)]
        return pd.DataFrame(got, columns=["start", "length", "matched"])

    compared = (
        lined.join(found.select(*one, "tokens").dropDuplicates(one), one)
        .join(items.select("item_id", F.col("tokens").alias("item")), "item_id")
        .select(*one, "item_id", verify("tokens", "item", "shift").alias("v"))
    )
    good = compared.filter("v.length > 0").select(
        "i", "no", "text_key", "item_id", (F.col("start") + F.col("v.start")).alias("start"), "v.length", "v.matched"
    )
    if few.limit(1).count():
        good = good.unionByName(whole_items(rows, few))
    best = F.max(F.struct("matched", -F.col("start"), "length")).alias("b")
    return good.groupBy("i", "no", "text_key", "item_id").agg(best).select(
        F.when(~F.col("no"), F.col("i")).alias("doc_id"),
        "text_key",
        "item_id",
        (-F.col("b.col2")).alias("start"),
        F.col("b.length").alias("length"),
        F.col("b.matched").alias("matched"),
    )


def _mixed(column: str):
    """``_mix(h ^ ODD[0])`` as Spark columns: products of 64 bits wrap."""

    @F.pandas_udf("long")
    def mixed(h: pd.Series) -> pd.Series:
        return pd.Series(_mix(h.to_numpy(np.int64).view(np.uint64) ^ ODD[0]).view(np.int64))

    return mixed(column)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, unnamed: bool = False
) -> DataFrame:
    """The rows of ``docs`` that share no overlap with the benchmark, columns as they are.

    Rows without an id all stay unless ``unnamed``.
    """
    leaked = settle(overlaps(docs, benchmark, min_tokens, unnamed).select("doc_id", "text_key").distinct(), "leaked")
    key, one = fresh(docs.columns, "_key", "_leaked_id")
    leaked = leaked.select(F.col("doc_id").alias(one), F.col("text_key").alias(key))
    tagged = docs.withColumn(key + "_own", text_key())
    kept = tagged.join(leaked, tagged["doc_id"].eqNullSafe(leaked[one]) & (tagged[key + "_own"] == leaked[key]), "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
