"""Exact removal of repeated byte strings with suffix arrays.

Every byte covered by a ``WIDTH``-byte string that also starts earlier goes. Two places can
share such a string only if they share an anchor: the smallest hash of ``GRAM`` bytes in the
string. Anchors are a few per cent of all places; those that occur once are dropped after
one exchange, and the rest bring their context, the bytes that the strings with this anchor
cover. Contexts equal to an earlier one are repeats as a whole. Of the different
contexts around one anchor, shards of suffix arrays find what they share:

- suffixes are classed as S or L, leftmost S (LMS) substrings are sorted by induction and
  named, the string of names is ranked (by doubling, to a depth that covers ``WIDTH`` bytes),
- the sorted LMS suffixes induce the whole array in one pass up and one down,
- permuted common prefixes, cut off at ``WIDTH``, mark the runs of equal strings; all but the
  earliest of a run are repeats.

An anchor with more contexts than a shard holds is resolved by grouping its strings instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import bits_of, chunks, keyed, may_be_in
from tidegauge.session import settle

WIDTH = 100
GRAM = 32
REACH = WIDTH - GRAM  # places an anchor can have in a string, less one
SHARD_BYTES = 2_000_000  # text of one suffix array
HOT = 6_000  # contexts of one anchor that a shard takes
LOG2_BITS = 24

TABLE = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
POWER = {n: np.uint64(pow(BASE, n, 1 << 64)) for n in (1, 2, 4, 8, 16)}


def _mix(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of the 32 bytes at each place, doubled up from single bytes."""
    h = TABLE[data]
    n = 1
    while n < GRAM:
        h = h[:-n] * POWER[n] + h[n:] if len(h) > n else h[:0]
        n *= 2
    return h


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each stretch of ``width`` entries."""
    n = 1
    while 2 * n <= width:
        a = op(a[:-n], a[n:])
        n *= 2
    rest = width - n
    return op(a[:-rest], a[rest:]) if rest else a


def anchors(texts: list[bytes]):
    """Contexts of several texts: anchor's hash, text number, start, length, context hash.

    The anchor of ``WIDTH`` bytes is the smallest of their grams. Strings that start one
    after the other and have the same smallest gram make one context, so each string lies in
    one context. Where that gram comes again within reach, as in periodic text, its last
    place in the string counts, so that no context repeats a string of its own.
    """
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    if len(flat) < WIDTH:
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    raw = gram_hashes(flat)
    h = _mix(raw)
    least = _slide(h, REACH + 1, np.minimum)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + WIDTH <= ends[owner]
    first = np.ones(len(least), bool)
    first[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    first |= _next_twin(h, least)
    cut = np.flatnonzero(first | ~inside)
    run = np.diff(np.append(cut, len(least)))
    cut, run = cut[inside[cut]], run[inside[cut]]
    length = run + WIDTH - 1
    context = length.astype(np.uint64)
    last = cut + length - GRAM
    for i in range(-(-(WIDTH + REACH) // GRAM)):
        context += raw[np.minimum(cut + GRAM * i, last)] * np.uint64(pow(BASE, 3 * i + 5, 1 << 64))
    return least[cut], owner[cut], cut - (ends - sizes)[owner[cut]], length, _mix(context)


def _next_twin(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Strings whose smallest gram is the same as before but has its last place further on."""
    rest = np.zeros(REACH, np.uint64)
    most = _slide(np.concatenate([rest, least, rest]), REACH + 1, np.maximum)
    at = np.flatnonzero(h == most)  # all smallest grams
    out = np.zeros(len(least), bool)
    touched = np.zeros(len(h) + 1, np.int32)
    for k in range(1, len(at)):
        near = at[k:] - at[:-k] <= REACH + 1
        if not near.any():
            break
        place = at[np.flatnonzero(near & (h[at[k:]] == h[at[:-k]])) + k]
        np.add.at(touched, np.maximum(place - REACH, 0), 1)
        np.add.at(touched, place + 1, -1)
    strings = np.flatnonzero(np.cumsum(touched)[: len(least)] > 0)
    if strings.size:
        where = np.searchsorted(at, strings + REACH, side="right") - 1
        while (other := h[at[where]] != least[strings]).any():
            where[other] -= 1
        new = np.ones(len(strings), bool)
        new[1:] = (where[1:] != where[:-1]) | (strings[1:] != strings[:-1] + 1)
        out[strings] = new
    return out


PLACES = "h long, c long, doc_id long, text_key long, start int, length int"


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """Anchors whose hash occurs more than once, each with its context's place and hash.

    Within a batch repeats are already known, and only one row of each hash goes on to be
    compared, so that a hash that is everywhere brings one row a batch to its task.
    """

    def scan(frames):
        for whole in frames:
            for first, last in chunks(whole["text"].tolist(), 8_000_000):
                frame = whole.iloc[first:last]
                texts = [t.encode() for t in frame["text"]]
                parts = []
                for lo, hi in chunks(texts, 1_000_000):
                    h, owner, start, length, c = anchors(texts[lo:hi])
                    if h.size:
                        parts.append((h, owner + lo, start, length, c))
                if not parts:
                    continue
                h, owner, start, length, c = (np.concatenate(x) for x in zip(*parts))
                _, one, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                goes = np.zeros(len(h), bool)
                goes[one] = True
                yield pd.DataFrame(
                    {
                        "h": h.view(np.int64),
                        "c": c.view(np.int64),
                        "doc_id": frame["doc_id"].astype("Int64").take(owner).array,
                        "text_key": frame["text_key"].to_numpy(np.int64)[owner],
                        "start": start.astype(np.int32),
                        "length": length.astype(np.int32),
                        "known": count[inverse] > 1,
                        "deal": np.where(goes, h, _mix(h + np.arange(len(h), dtype=np.uint64))).view(np.int64),
                    }
                )

    def keep(frames):
        """Rows sorted by ``deal``, then hash: a row stays if it is known or has a neighbour."""
        held = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            h = frame["h"].to_numpy()
            if not h.size:
                continue
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            stays = same | frame["known"].to_numpy(bool)
            stays[:-1] |= same[1:]
            # the last row waits for its neighbour; once it has one it is known
            held = frame.iloc[-1:].copy()
            held["known"] = bool(stays[-1])
            yield frame.iloc[:-1][stays[:-1]].drop(columns=["known", "deal"])
        if held is not None and bool(held["known"].iloc[0]):
            yield held.drop(columns=["known", "deal"])

    found = rows.mapInPandas(scan, f"{PLACES}, known boolean, deal long")
    return found.repartition("deal").sortWithinPartitions("deal", "h").mapInPandas(keep, PLACES)


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the sentinel is S."""
    step = np.sign(np.diff(t.astype(np.int32)))
    after = np.where(step != 0, np.arange(len(step)), len(step))
    after = np.minimum.accumulate(after[::-1])[::-1]
    s = np.ones(len(t), bool)
    s[:-1] = np.concatenate([step, [-1]])[after] > 0
    s[-1] = True
    return s


def _deal(items: np.ndarray, keys: np.ndarray):
    """Items by key, in their order: pairs of a key and its items."""
    if len(keys) == 1:
        yield int(keys[0]), items
        return
    order = np.argsort(keys, kind="stable")  # 16-bit symbols are sorted by radix
    items, keys = items[order], keys[order]
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(keys[a]), items[a:b]


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array from LMS suffixes in order, bucket by bucket.

    Upwards, each suffix of a bucket places the L suffix before it at the head of its own
    bucket; downwards, each places the S suffix before it at the tail.
    """
    size = int(t.max()) + 1
    ups: list[list[np.ndarray]] = [[] for _ in range(size)]
    seeds: list[np.ndarray] = [lms[:0]] * size
    for key, part in _deal(lms, t[lms]):
        seeds[key] = part

    def push(lists, chunk, wanted):
        before = chunk[chunk > 0] - 1
        before = before[s[before] == wanted]
        if before.size:
            for key, part in _deal(before, t[before]):
                lists[key].append(part)

    for c in range(size):
        i = 0
        while i < len(ups[c]):
            push(ups, ups[c][i], False)
            i += 1
        if seeds[c].size:
            push(ups, seeds[c], False)
    downs: list[list[np.ndarray]] = [[] for _ in range(size)]
    heads = [np.concatenate(u) if u else lms[:0] for u in ups]
    downs[int(t[-1])].append(np.array([len(t) - 1], np.int32))
    for c in range(size - 1, -1, -1):
        i = 0
        while i < len(downs[c]):
            push(downs, downs[c][i], True)
            i += 1
        if heads[c].size:
            push(downs, heads[c][::-1], True)
    out = []
    for c in range(size):
        out.append(heads[c])
        if downs[c]:
            out.append(np.concatenate(downs[c])[::-1])
    return np.concatenate(out)


def _rank(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the name string by their first ``depth`` names at least."""
    rank, step = names.astype(np.int64), 1
    while step < depth and rank.max() + 1 < len(rank):
        following = np.zeros(len(rank), np.int64)
        following[:-step] = rank[step:] + 1 if step < len(rank) else 0
        pair = rank * (int(following.max()) + 1) + following
        _, rank = np.unique(pair, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least.

    ``t`` holds small non-negative numbers and ends with its only 0. Induced sorting: LMS
    substrings are sorted by induction and named, names are ranked, and the array is induced
    from the LMS suffixes in order.
    """
    s = _types(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    if not lms.size:
        return induce(t, s, lms)
    first = induce(t, s, lms)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    # equal LMS substrings get one name: compare each with the one before it, symbol by symbol
    nxt = np.full(len(t), len(t) - 1, np.int32)
    nxt[lms[:-1]] = lms[1:]
    span = nxt[ordered] - ordered + 1
    new = np.ones(len(ordered), bool)
    same = np.flatnonzero(span[1:] == span[:-1]) + 1
    offset = 0
    equal_until = same
    while equal_until.size:
        a, b = ordered[equal_until], ordered[equal_until - 1]
        more = span[equal_until] > offset
        done = equal_until[~more]
        new[done] = False
        a, b, equal_until = a[more], b[more], equal_until[more]
        equal_until = equal_until[(t[a + offset] == t[b + offset]) & (s[a + offset] == s[b + offset])]
        offset += 1
    name = np.empty(len(t), np.int64)
    name[ordered] = np.cumsum(new) - 1
    sorted_lms = lms[_rank(name[lms], depth // 2 + 1)]  # a name moves on by two symbols at least
    return induce(t, s, sorted_lms)


def common_prefixes(data: np.ndarray, left: np.ndarray, order: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """For each place, bytes its suffix shares with the one before it in ``order``, up to ``most``.

    The permuted table: it is indexed by place, not by rank. ``left`` is how many bytes
    remain to each place's text; eight bytes are compared at a time.
    """
    shared = np.zeros(len(data), np.int64)
    if len(order) < 2:
        return shared
    padded = np.concatenate([data.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view("<u8")[:, 0]
    at, before = order[1:], order[:-1]
    limit = np.minimum(np.minimum(left[at], left[before]), most)
    going = np.flatnonzero(limit > 0)
    count = np.zeros(len(at), np.int64)
    done = 0
    while going.size:
        a, b = at[going] + done, before[going] + done
        differ = words[a] ^ words[b]
        lowest = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
        count[going] += equal
        done += 8
        going = going[(differ == 0) & (limit[going] > done)]
    shared[at] = np.minimum(count, limit)
    return shared


def shard_repeats(contexts: list[bytes], places: np.ndarray) -> np.ndarray:
    """Places in the shard's text where a repeated string starts, as ``(context, offset)`` rows.

    ``places`` orders each context's first byte among all documents; a string is a repeat
    if the same string starts at a smaller place.
    """
    lengths = np.array([len(c) for c in contexts])
    begin = np.cumsum(lengths + 1) - lengths - 1
    raw = np.frombuffer(b"\0".join(contexts) + b"\0\0", np.uint8)
    t = raw.astype(np.uint16) + np.uint16(2)
    t[begin + lengths] = 1  # between texts
    t[-1] = 0
    owner = np.repeat(np.arange(len(contexts)), lengths + 1)
    inner = np.arange(len(owner)) - begin[owner]
    left = np.append(lengths[owner] - inner, 0)
    sa = suffix_array(t)
    sa = sa[left[sa] >= WIDTH]  # places where a whole string starts
    if not sa.size:
        return np.zeros((0, 2), np.int64)
    joined = common_prefixes(raw, left, sa)[sa] >= WIDTH
    joined[0] = False
    where = places[owner[sa]] + inner[sa]
    start = np.flatnonzero(~joined)
    lowest = np.minimum.reduceat(where, start)
    repeat = sa[where > lowest[np.cumsum(~joined) - 1]]
    return np.stack([owner[repeat], inner[repeat]], axis=1)


def _merge(spans) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RANGES = "doc_id long, text_key long, start int, end int"


def _shard_ranges(frames):
    """Repeats among the contexts of each anchor, whole anchors to a shard."""
    columns = ["doc_id", "text_key", "start", "end"]

    def solve(rows: pd.DataFrame):
        ids = rows["doc_id"].astype("Int64")
        order = pd.DataFrame({"some": ids.notna(), "id": ids.fillna(0), "key": rows["text_key"]})
        rank = order.groupby(["some", "id", "key"], sort=True).ngroup().to_numpy(np.int64)
        places = (rank << 32) + rows["start"].to_numpy(np.int64)
        found = shard_repeats(rows["context"].tolist(), places)
        if not len(found):
            return
        start = rows["start"].to_numpy()[found[:, 0]] + found[:, 1]
        doc = rank[found[:, 0]]
        by = np.lexsort((start, doc))
        start, doc, home = start[by], doc[by], found[by, 0]
        # a span goes on while strings of one document overlap or touch
        cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + WIDTH)])
        last = np.r_[cut[1:], len(start)] - 1
        yield pd.DataFrame(
            {
                "doc_id": ids.take(home[cut]).array,
                "text_key": rows["text_key"].to_numpy()[home[cut]],
                "start": start[cut].astype(np.int32),
                "end": (start[last] + WIDTH).astype(np.int32),
            },
            columns=columns,
        )

    held, size = [], 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        size += int(frame["context"].map(len).sum())
        if size >= SHARD_BYTES:
            rows = pd.concat(held, ignore_index=True)
            h = rows["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield from solve(rows.iloc[:cut])
            held = [rows.iloc[cut:]]
            size = int(held[0]["context"].map(len).sum())
    if held:
        rows = pd.concat(held, ignore_index=True)
        if len(rows):
            yield from solve(rows)


def _id(df: DataFrame) -> DataFrame:
    """Join columns that are never null."""
    return df.withColumns({"i": F.coalesce("doc_id", F.lit(0)), "no": F.col("doc_id").isNull()})


def _some_of(rows: DataFrame, wanted: DataFrame, yes: bool = True) -> DataFrame:
    """Rows whose key may be among the wanted ones, by a bitmap of fixed size (or the others)."""
    bitmap = bits_of(wanted.select(F.xxhash64("i", "no", "text_key").alias("k")), "k", LOG2_BITS)
    test = may_be_in(F.xxhash64("i", "no", "text_key"), bitmap, LOG2_BITS)
    return rows.filter(test if yes else ~test)


ON = ["i", "no", "text_key"]


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """Ranges of bytes to remove, ``(doc_id, text_key, start, end)``; they may overlap.

    ``rows`` come from ``keyed``. Rows with one id and text count as one document.
    """
    found = settle(repeated_anchors(rows), "anchors")
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text_key", "start")
    firsts = settle(found.groupBy("h", "c", "length").agg(F.min(place).alias("first")), "contexts")
    whole = (
        found.filter(F.col("length") >= WIDTH)
        .join(firsts, ["h", "c", "length"])
        .filter(place != F.col("first"))
        .select("doc_id", "text_key", "start", (F.col("start") + F.col("length")).alias("end"))
    )
    several = firsts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    apart = settle(
        _id(firsts.join(several, "h").select("h", "n", "first.doc_id", "first.text_key", "first.start", "length"))
        .groupBy(*ON)
        .agg(F.collect_list(F.struct("h", "n", "start", "length")).alias("places")),
        "apart",
    )

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, places):
            raw = text.encode()
            out.append([raw[p["start"] : p["start"] + p["length"]] for p in own])
        return pd.Series(out, dtype=object)

    held = _some_of(_id(rows), apart).dropDuplicates(ON).join(apart, ON)
    contexts = settle(
        held.select("doc_id", "text_key", "places", cut("text", "places").alias("context"))
        .select("doc_id", "text_key", F.explode(F.arrays_zip("places", "context")).alias("x"))
        .select("doc_id", "text_key", "x.places.h", "x.places.n", "x.places.start", "x.context"),
        "shards",
    )
    sharded = (
        contexts.filter(F.col("n") <= HOT)
        .drop("n")
        .repartition("h")
        .sortWithinPartitions("h")
        .mapInPandas(_shard_ranges, RANGES)
    )
    return whole.union(sharded).union(_hot_ranges(contexts.filter(F.col("n") > HOT)))


def _hot_ranges(contexts: DataFrame) -> DataFrame:
    """Repeats around anchors with very many contexts: their strings are grouped one by one."""

    def strings(frames):
        for frame in frames:
            for doc, key, start, raw in zip(frame["doc_id"].astype("Int64"), frame["text_key"], frame["start"], frame["context"]):
                n = len(raw) - WIDTH + 1
                if n <= 0:
                    continue
                digests = [xxhash.xxh128(raw[i : i + WIDTH]).digest() for i in range(n)]
                out = pd.DataFrame({"w": digests, "start": np.arange(start, start + n, dtype=np.int32)})
                out["doc_id"] = pd.array([doc] * n, dtype="Int64")
                out["text_key"] = key
                yield out[["doc_id", "text_key", "start", "w"]]

    each = settle(contexts.mapInPandas(strings, "doc_id long, text_key long, start int, w binary").distinct(), "strings")
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text_key", "start")
    first = each.groupBy("w").agg(F.min(place).alias("first"))
    return (
        each.join(first, "w").filter(place != F.col("first")).select("doc_id", "text_key", "start", (F.col("start") + WIDTH).alias("end"))
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed runs of bytes) and ``kept`` (binary), one row a row.

    Null texts are empty. "Earlier" is a smaller ``doc_id`` (null ids come first, rows of one
    id are ordered by the hash of their text), or an earlier place of the same document;
    repeated rows are one document and keep the same bytes. Other columns are not read.
    """
    rows = keyed(docs)
    ranges = settle(
        _id(repeated_ranges(rows)).groupBy(*ON).agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges"
    )

    @F.pandas_udf("spans array<struct<start int, end int>>, kept binary")
    def remove(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for text, own in zip(texts, found):
            raw = text.encode()
            runs = _merge((r["start"], r["end"]) for r in own) if own is not None else []
            cuts = [0, *(x for run in runs for x in run), len(raw)]
            spans.append([{"start": a, "end": b} for a, b in runs])
            kept.append(b"".join(raw[a:b] for a, b in zip(cuts[0::2], cuts[1::2])))
        return pd.DataFrame({"spans": pd.Series(spans, dtype=object), "kept": pd.Series(kept, dtype=object)})

    identified = _id(rows)
    size = F.octet_length("text").cast("long").alias("n_bytes")
    touched = (
        _some_of(identified, ranges)
        .join(ranges, ON, "left")
        .select("doc_id", size, remove("text", "ranges").alias("x"))
        .select("doc_id", "n_bytes", "x.spans", "x.kept")
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")
    clean = _some_of(identified, ranges, yes=False).select("doc_id", size, empty.alias("spans"), F.col("text").cast("binary").alias("kept"))
    return touched.union(clean)


def report(found: DataFrame) -> DataFrame:
    """Counts and a digest of what ``remove_repeats`` leaves."""
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
