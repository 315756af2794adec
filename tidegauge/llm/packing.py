"""Packing into sequences as a cutting-stock problem.

Documents are cut into pieces of at most ``CAPACITY`` tokens. Piece lengths are rounded up
to classes of ``GRAIN`` tokens, and the histogram of the classes, a few hundred numbers, goes
to the driver. There a linear program over patterns (how many pieces of each class share a
sequence) is solved by column generation: the dual values price a knapsack, whose dynamic
program gives the next pattern. Patterns are rounded down and the rest is filled greedily.
Then every piece's rank within its class gives its sequence by arithmetic; texts and ids
never leave the executors.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import Remembered, text_or_empty, trim, worker_memory
from tidegauge.session import settle

CAPACITY = 4096
GRAIN = 8
END_ID = 2
GAP = 1e-3  # the linear program stops this close to its bound
POOL = 16  # patterns priced by one dynamic program
KNOWN_BYTES = 64_000_000  # of words a Python worker remembers in a task
KEPT_BYTES = 16_000_000  # of these, from task to task: idle workers hold them too
BUCKET = 10_000  # pieces of one class that are ranked together

# Parts of a word that are pre-tokens by themselves. The apostrophe (contractions) and ``<``
# (special tokens) are not among the signs, so words that hold them are left to the tokenizer.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PART = re.compile(rf"[{LETTERS}]+|[0-9]|[!-&(-/:;=>?@\[-`{{-~]+")


def _tokenizer(path: str):
    """The tokenizer, its merges alone and how letters are spelled for them."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = [c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c)]
    spelling = {ord(c): bytewise.pre_tokenize_str(c.lower())[0][0] for c in letters}
    return tokenizer, tokenizer.model, spelling


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(Remembered):
    """Word to its ids as little-endian 32-bit numbers; a new one's are made when it is asked for."""

    def __init__(self, path: str):
        super().__init__(KNOWN_BYTES, 170, KEPT_BYTES)
        self.tokenizer, self.merges, self.spelling = _tokenizer(path)

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 1 and word[-1] in b".," and b"a" <= word[-2:-1] <= b"z":
            # the sign is a pre-token by itself; the two together are kept from the second time on
            bare = self.get(word[:-1])
            if bare is None:
                return self[word[:-1]] + self[word[-1:]]
            made = bare + self[word[-1:]]
            return self.keep(word, made, len(made))
        plain = word.decode()
        if word.isalpha() and word.islower():
            ids = [token.id for token in self.merges.tokenize(plain)]
        else:
            parts = PART.findall(plain)
            if sum(map(len, parts)) < len(plain):
                ids = self.tokenizer.encode([plain], is_pretokenized=True, add_special_tokens=False).ids
            else:
                ids = [token.id for part in parts for token in self.merges.tokenize(part.translate(self.spelling))]
        return self.keep(word, struct.pack(f"<{len(ids)}I", *ids), 4 * len(ids))


def word_ids(path: str) -> WordIds:
    """The words this Python worker remembers."""
    memory = worker_memory(f"packing {path}")
    if "words" not in memory:
        memory["words"] = WordIds(path)
    return memory["words"]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers, without special tokens.

    This vocabulary drops white space and lowers letters, so a text's ids are those of its
    words in turn. Words met before are looked up. New ones made of ``PART`` need only the
    merges; the others go through the tokenizer. Texts that hold ``<|`` keep their case,
    because special tokens are read from the raw text.
    """
    ids_of, out = word_ids(path).__getitem__, []
    for text in texts:
        raw = text.encode()
        words = (raw if b"<|" in raw else raw.lower()).split()
        out.append(b"".join(map(ids_of, words)))
    return out


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``doc_tokens`` and each piece's ``start`` and ``ids`` (binary, 32-bit little-endian).

    A document is its text's ids and ``end_id``; a null or empty text is that id alone.
    """
    where = path or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")

    def cut(frames):
        for frame in frames:
            texts = frame["text"].tolist()
            for lo in range(0, len(texts), 500):
                out = []
                for doc, ids in zip(frame["doc_id"].iloc[lo : lo + 500], encode(texts[lo : lo + 500], where)):
                    ids += end
                    n = len(ids) // 4
                    out += [(doc, n, s, ids[4 * s : 4 * (s + capacity)]) for s in range(0, n, capacity)]
                got = pd.DataFrame(out, columns=["doc_id", "doc_tokens", "start", "ids"])
                got["doc_id"] = got["doc_id"].astype("Int64")
                yield got
        # the worker may lie idle from here on
        word_ids(where).shrink()
        trim()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(
        cut, "doc_id long, doc_tokens long, start long, ids binary"
    )


def knapsack(values: np.ndarray, classes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room, the most that pieces in it are worth, and the class to put in last (-1: none)."""
    worth = np.full(capacity, -np.inf)
    worth[classes - 1] = values
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    index = np.full(capacity, -1)
    index[classes - 1] = np.arange(len(classes))
    for room in range(1, capacity + 1):
        got = worth[:room] + best[room - 1 :: -1]
        i = got.argmax()
        if got[i] > best[room - 1]:
            best[room], pick[room] = got[i], index[i]
        else:
            best[room] = best[room - 1]
    return best, pick


def fill(pick: np.ndarray, classes: np.ndarray, room: int) -> dict[int, int]:
    """The pieces that the knapsack chose for a room."""
    counts: dict[int, int] = {}
    while room > 0:
        i = int(pick[room])
        if i < 0:
            room -= 1
            continue
        counts[i] = counts.get(i, 0) + 1
        room -= int(classes[i])
    return counts


def priced_patterns(dual: np.ndarray, classes: np.ndarray, capacity: int) -> tuple[float, list[dict[int, int]]]:
    """The worth of the best pattern, and for each class the best that holds it, if worth more than 1.

    One dynamic program gives all of them, ``POOL`` at most, the best first.
    """
    best, pick = knapsack(dual, classes, capacity)
    worth = dual + best[capacity - classes]
    found: dict[tuple, dict[int, int]] = {}
    for i in np.argsort(-worth, kind="stable").tolist():
        if worth[i] <= 1 + 1e-9 or len(found) == POOL:
            break
        pattern = fill(pick, classes, int(capacity - classes[i]))
        pattern[i] = pattern.get(i, 0) + 1
        found[tuple(sorted(pattern.items()))] = pattern
    return float(worth.max()), list(found.values())


def column_generation(classes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP):
    """Patterns (as dictionaries) and how often to use each, fractional.

    Starts with one class a pattern. Ends within a share ``gap`` of a lower bound: the room
    that the pieces need in all, or the dual values scaled until no pattern is worth more
    than 1. Patterns priced together enter one after the other while the changing dual
    values leave them worth it.
    """
    m = len(classes)
    columns = [{i: int(capacity // c)} for i, c in enumerate(classes)]
    inverse = np.diag([1 / (capacity // c) for c in classes]).astype(float)
    use, dual = inverse @ demand, inverse.sum(axis=0)
    steps, bound = 0, float(classes @ demand) / capacity
    while steps < 40 * m and use.sum() > (1 + gap) * bound:
        value, pool = priced_patterns(dual, classes, capacity)
        bound = max(bound, float(dual @ demand) / value)
        if not pool or use.sum() <= (1 + gap) * bound:
            break
        entries = np.zeros((len(pool), m))
        for j, pattern in enumerate(pool):
            entries[j, list(pattern)] = list(pattern.values())
        while True:
            values = entries @ dual
            j = int(np.argmax(values))
            if values[j] <= 1 + 1e-9 or steps >= 40 * m or use.sum() <= (1 + gap) * bound:
                break
            steps += 1
            direction = inverse @ entries[j]
            up = direction > 1e-9
            ratio = np.full(m, np.inf)
            ratio[up] = use[up] / direction[up]
            leave = int(np.argmin(ratio))
            row = inverse[leave] / direction[leave]
            inverse -= np.outer(direction, row)
            inverse[leave] = row
            columns[leave] = pool[j]
            if steps % 200 == 0:  # against rounding errors
                basis = np.zeros((m, m))
                for k, c in enumerate(columns):
                    basis[list(c), k] = list(c.values())
                inverse = np.linalg.inv(basis)
            use, dual = np.maximum(inverse @ demand, 0), inverse.sum(axis=0)
    return columns, use


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(times, {class: pieces})`` for a histogram ``{class: pieces}``; every piece is placed."""
    if not histogram:
        return []
    classes = np.array(sorted(histogram))
    demand = np.array([histogram[c] for c in classes], float)
    columns, use = column_generation(classes, demand, capacity)
    left = demand.astype(np.int64)
    out = []
    for pattern, x in sorted(zip(columns, use), key=lambda p: -p[1]):
        times = min([int(x + 1e-6), *(int(left[i] // k) for i, k in pattern.items())])
        if times > 0:
            out.append((times, {int(classes[i]): k for i, k in pattern.items()}))
            for i, k in pattern.items():
                left[i] -= times * k
    # what rounding left: largest first, each sequence filled by the largest that fits
    while left.any():
        room, counts = capacity, {}
        for i in range(len(classes) - 1, -1, -1):
            k = min(int(left[i]), room // int(classes[i]))
            if k:
                counts[i], room = k, room - k * int(classes[i])
        times = min(int(left[i]) // k for i, k in counts.items())
        for i, k in counts.items():
            left[i] -= times * k
        out.append((times, {int(classes[i]): k for i, k in counts.items()}))
    return out


def slot_table(chosen: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """Ranks of a class from ``low`` on go to sequences from ``first`` on, ``per`` to each."""
    rows, taken, first = [], {}, 0
    for times, pattern in chosen:
        for c, k in pattern.items():
            rows.append((c, taken.get(c, 0), first, k))
            taken[c] = taken.get(c, 0) + times * k
        first += times
    return pd.DataFrame(rows, columns=["cls", "low", "first", "per"]).sort_values(["cls", "low"], ignore_index=True)


def sequence_of(cls: Column, rank: Column, slots: pd.DataFrame) -> Column:
    """The sequence of a piece from its class and its rank there."""
    start = (slots["cls"].to_numpy(np.int64) << 48) + slots["low"].to_numpy(np.int64)
    first, per = slots["first"].to_numpy(np.int64), slots["per"].to_numpy(np.int64)
    low = slots["low"].to_numpy(np.int64)

    @F.pandas_udf("long")
    def place(c: pd.Series, r: pd.Series) -> pd.Series:
        rank = r.to_numpy(np.int64)
        at = np.searchsorted(start, (c.to_numpy(np.int64) << 48) + rank, side="right") - 1
        return pd.Series(first[at] + (rank - low[at]) // per[at])

    return place(cls, rank)


def pack(cut: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``doc_id``, ``start`` and ``length``.

    ``length`` is between 1 and ``capacity``. Pieces of one sequence lie one after the other
    from offset 0. An empty table gives an empty one. ``cut`` is read twice, so pass a table.
    """
    cls = F.ceil(F.col("length") / grain).cast("long")
    total = cut.count()
    ranked = cut.withColumns(
        {"_cls": cls, "_bucket": F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(1, -(-total // BUCKET))))}
    )
    counts = settle(ranked.groupBy("_cls", "_bucket").agg(F.count("*").alias("_n")), "class_counts")
    histogram = {r["_cls"]: r["n"] for r in counts.groupBy("_cls").agg(F.sum("_n").alias("n")).collect()}  # capacity / grain rows
    slots = slot_table(plan(histogram, capacity // grain))
    before = Window.partitionBy("_cls").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_cls", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_cls", "_bucket").orderBy("doc_id", "start", "length")
    placed = (
        ranked.withColumn("_own", F.row_number().over(own) - 1)
        .join(base, ["_cls", "_bucket"])
        .withColumn("sequence_id", sequence_of(F.col("_cls"), F.col("_base") + F.col("_own"), slots))
    )
    # at most capacity pieces share a sequence
    along = Window.partitionBy("sequence_id").orderBy(F.desc("_cls"), F.col("_base") + F.col("_own"))
    offset = F.sum("length").over(along) - F.col("length")
    return placed.withColumn("offset", offset).drop("_cls", "_bucket", "_own", "_base")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a piece: ids' CRC-32, place in its document and place in its sequence.

    Null texts are empty. Rows that share an id are packed as separate documents. The ids
    themselves are those of ``pieces``, cut at the same places.
    """
    cut = settle(
        pieces(docs, path).select(
            "doc_id",
            "start",
            (F.octet_length("ids") / 4).cast("long").alias("length"),
            F.crc32("ids").alias("ids_crc32"),
            "doc_tokens",
        ),
        "pieces",
    )
    return pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
