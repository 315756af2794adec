"""Spelling variants: words of a corpus that differ by one edit.

Words that differ by one edit agree on both sides of it. So they are dealt into groups by a
few characters that they share in front or behind, each pair into exactly one group, and a
group that is still too large is dealt again by more characters, until what is left open is
too short to hold many words. Inside its group a word is compared with the sorted list of the
others: the row of the edit matrix (three cells around the diagonal) that belongs to a prefix
is computed once for all words that share it, as the longest common prefixes of neighbours
tell, and a range whose prefix is more than one edit away is left at once. All words of many
groups go down the list together, one depth at a time, in numpy arrays.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import text_or_empty
from tidegauge.session import settle

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST = 5  # code points of a word
SUPPORT = 3  # occurrences of a word
NOISE = 97  # one run in so many, by hash, loses a code point
STEP = 2  # characters by which groups are dealt at a time
CELLS = 60_000  # characters to compare of a group that is not dealt again
BATCH = 60_000  # characters of the groups that are compared together
TASK_WORDS = 20_000  # rows of a task
MOST = 200_000  # words counted before they are handed on
FAR = 2  # any distance above one


def runs(doc_id, text: str) -> Counter:
    """Words of one text with their counts: runs of letters, some short of a code point."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        hashed = zlib.crc32(run.encode(), seed)
        if hashed % NOISE == 0:
            at = hashed % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= SHORTEST:
            found[run] += n
    return found


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts, of words with at least ``SUPPORT``.

    A null text has no words. A null id is spelled as nothing in the hash. Repeated rows
    count each time.
    """

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text")):
                held.update(runs(doc_id, text.as_py()))
                if len(held) >= MOST:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)

    found = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT)


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


KEY = ["m", "a", "b", "u", "front", "back"]


def _deal(rows: DataFrame) -> DataFrame:
    """Deal groups by ``STEP`` more characters in front, and once more by as many behind.

    Of long words a quarter of what is open, so that the rounds grow with the logarithm.

    A row's group: length ``m`` of a pair's shorter word, ``a`` characters in front and ``b``
    behind that are shared, and the bound ``u`` that the pair's common prefix stays below.
    A pair whose common prefix has the new characters goes to the group in front, any other
    to the one behind. That one shares them there: what lies before its edit is shorter than
    the step and the open part has two steps, or is dealt by half of itself.
    """
    step = F.least(F.greatest(F.lit(STEP), F.expr("(m - a - b) div 4")), F.expr("(m - a - b) div 2")).cast("int")
    way = F.explode(
        F.array(
            F.struct((F.col("a") + step).alias("a"), F.col("b").alias("b"), F.col("u").alias("u")),
            F.struct(F.col("a").alias("a"), (F.col("b") + step).alias("b"), F.least("u", F.col("a") + step).alias("u")),
        )
    ).alias("way")
    dealt = rows.select("word", "n", "m", way).select("word", "n", "m", "way.*")
    return dealt.withColumns({"front": F.expr("left(word, a)"), "back": F.expr("right(word, b)")})


def groups(words: DataFrame) -> DataFrame:
    """Each word's rows ``(word, n, m, a, b, u, front, back)``, one for each group it is in."""
    length = F.length("word")
    shorter = F.explode(F.array(length, length - 1)).alias("m")
    rows = words.select("word", "n", shorter).filter(F.col("m") >= SHORTEST)
    rows = rows.withColumns({"a": F.lit(0), "b": F.lit(0), "u": F.lit(np.iinfo(np.int32).max)})
    done = None
    while True:
        rows = settle(_deal(rows), "variant_groups")
        cells = F.count("*") * (F.col("m") - F.col("a") - F.col("b") + 1)
        sizes = rows.groupBy(KEY).agg(cells.alias("cells"), F.count("*").alias("n"))
        large = settle(sizes.filter((F.col("cells") > CELLS) & F.expr("n > 1 and m - a - b > 1")).select(KEY), "variant_large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = rows.join(large, KEY, "left_semi")


def _one_edit(middle: list[str], query: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, other, common prefix) of strings of a group with exactly one edit.

    The strings are sorted within their groups, and those of a group that are not in
    ``query`` are one longer than those that are. ``group`` is each string's group number.
    """
    n = len(middle)
    size = np.array([len(s) for s in middle], np.int64)
    width = int(size.max()) + 1
    chars = np.zeros((n, width), np.int32)  # 0 after the end
    inside = np.arange(width) < size[:, None]
    chars[inside] = np.frombuffer("".join(middle).encode("utf-32-le"), np.int32) + 1
    # longest common prefix with the string before, -1 at the first of a group
    differs = chars[1:] != chars[:-1]
    lcp = np.concatenate([[-1], np.where(differs.any(axis=1), differs.argmax(axis=1), width)])
    lcp[1:][group[1:] != group[:-1]] = -1
    first = np.flatnonzero(lcp < 0)
    bounds = np.append(first, n)
    q = np.flatnonzero(query)
    lo, hi = bounds[group[q]], bounds[group[q] + 1]
    # cells (depth, depth - 1), (depth, depth), (depth, depth + 1) of the matrix: strings by query
    r0, r1, r2 = (np.full(len(q), v, np.int8) for v in (FAR, 0, 1))
    common = np.zeros(len(q), np.int64)
    pairs = []
    for depth in range(width):
        # strings that end here are the first of their range
        ends = size[lo] == depth
        if ends.any():
            far = np.where(size[q] == depth, r1, r0)
            hit = ends & (far == 1) & (size[q] >= depth - 1)
            pairs.append((q[hit], lo[hit], common[hit]))
            lo = lo + ends
            keep = lo < hi
            q, lo, hi, r0, r1, r2, common = (x[keep] for x in (q, lo, hi, r0, r1, r2, common))
        if not len(q):
            break
        # one state for each next character: cut ranges where neighbours share no more than this prefix
        cuts = np.flatnonzero(lcp <= depth)
        after = np.searchsorted(cuts, lo, side="right")
        count = np.searchsorted(cuts, hi, side="left") - after + 1
        which = np.repeat(np.arange(len(q)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        inner = np.concatenate([cuts, [n]])
        start = np.where(nth == 0, lo[which], inner[np.minimum(after[which] + nth - 1, len(cuts))])
        stop = np.where(nth == count[which] - 1, hi[which], inner[np.minimum(after[which] + nth, len(cuts))])
        q, lo, hi = q[which], start, stop
        r0, r1, r2, common = r0[which], r1[which], r2[which], common[which]
        c, length = chars[lo, depth], size[q]
        before = chars[q, max(depth - 1, 0)]
        here = chars[q, depth]
        ahead = chars[q, min(depth + 1, width - 1)]
        new0 = np.minimum(r1 + 1, r0 + (before != c))
        new1 = np.minimum(np.minimum(r2 + 1, new0 + 1), r1 + (here != c))
        new1[length < depth + 1] = FAR
        new2 = np.minimum(new1 + 1, r2 + (ahead != c))
        new2[length < depth + 2] = FAR
        new0[length < depth] = FAR
        r0, r1, r2 = (np.minimum(x, FAR).astype(np.int8) for x in (new0, new1, new2))
        common = np.where(r1 == 0, depth + 1, common)
        near = np.minimum(np.minimum(r0, r1), r2) < FAR
        q, lo, hi, r0, r1, r2, common = (x[near] for x in (q, lo, hi, r0, r1, r2, common))
    if not pairs:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*pairs))


def _near_words(rows: list[tuple]) -> pa.RecordBatch:
    """For each word of whole groups, sorted by ``KEY`` and word: near words, the best of them."""
    numbers: dict[tuple, int] = {}
    group = np.array([numbers.setdefault(r[2:], len(numbers)) for r in rows], np.int64)
    words = [r[0] for r in rows]
    n = np.array([r[1] for r in rows], np.int64)
    middle = [w[r[3] : len(w) - r[4]] for w, r in zip(words, rows)]
    order = sorted(range(len(rows)), key=lambda i: (group[i], middle[i]))
    words, middle, group, n = [words[i] for i in order], [middle[i] for i in order], group[order], n[order]
    shortest = np.array([rows[i][2] for i in order], np.int64)
    offset = np.array([rows[i][3] for i in order], np.int64)
    bound = np.array([rows[i][5] for i in order], np.int64)
    query = np.array([len(w) for w in words], np.int64) == shortest
    a, b, common = _one_edit(middle, query, group)
    mine = common + offset[a] < bound[a]
    a, b = a[mine], b[mine]
    longer = ~query[b]
    a, b = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    by = np.lexsort((place[b], -n[b], a))
    a, b = a[by], b[by]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in a[first]], pa.string()),
            pa.array(np.diff(first, append=len(a)), pa.int64()),
            pa.array(n[b[first]], pa.int64()),
            pa.array([words[i] for i in b[first]], pa.string()),
        ],
        ["word", "n_near", "best_n", "best"],
    )


def near(words: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``best`` (near word of largest ``n``) and ``best_n`` of words that have any.

    ``words`` has distinct words of ``SHORTEST`` or more code points, each with its ``n``.
    """
    dealt = settle(groups(words), "variant_dealt")
    parts = max(1, -(-dealt.count() // TASK_WORDS))

    def scan(batches):
        held: list[tuple] = []  # rows of groups, the last one perhaps not whole
        cells = 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[-1][2:] != row[2:]:
                    if cells > BATCH:
                        yield _near_words(held)
                        held, cells = [], 0
                held.append(row)
                cells += row[2] - row[3] - row[4] + 1
        if held:
            yield _near_words(held)

    spread = dealt.select("word", "n", *KEY).repartition(parts, *KEY).sortWithinPartitions(*KEY)
    found = spread.mapInArrow(scan, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), first.alias("first"))
        .select("word", "n_near", F.col("first.word").alias("best"), (-F.col("first.n")).alias("best_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, where its forms end; ``forms`` has ``word`` and its ``form``.

    A form is at least twice as frequent, so there are no cycles and the paths are short;
    each round doubles the part of the path that is known.
    """
    now = settle(forms.select("word", F.col("form").alias("root")), "variant_roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left").select("word", "root", "next")
        moved = settle(moved, "variant_paths")
        if moved.filter(F.col("next").isNotNull()).isEmpty():
            return now
        now = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """Each word of the texts with its more frequent spelling, if there is one.

    ``form`` is the near word with the largest count (ties: smallest in code-point order)
    if that is at least twice the word's own, ``root`` the end of the forms from it. Null
    and empty texts have no words, very long words are words like others, repeated rows
    count each time, an empty table gives an empty one. Other columns are not read.
    """
    words = settle(vocabulary(docs), "vocabulary")
    linked = settle(
        words.join(near(words), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.expr("if(best_n >= 2 * n, best, null)").alias("form"),
            F.expr("if(best_n >= 2 * n, best_n, null)").alias("form_n"),
        ),
        "variants",
    )
    ends = roots(linked.filter(F.col("form").isNotNull()))
    return linked.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
