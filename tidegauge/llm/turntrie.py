"""Trie of conversation prefixes: adaptive radix trees over the turns' fixed-width ids.

A turn's id is 16 bytes, big-endian, of a hash of its role and text; a conversation's key is
its turns' ids in order. Equal keys are merged first. The distinct keys are sorted and cut by
range into shards, and each shard builds a radix tree: inner nodes grow from 4 to 16, 48 and
256 children, and single paths are compressed. Only byte depths at the end of a turn give
nodes. A shard also has the last key before it and the first one behind it, so it knows which
of its nodes it shares: every sum it returns for those is a part, and the parts are added up
by a table of the shared nodes, at most one path for each border between shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import text_or_empty
from tidegauge.session import settle

WIDTH = 16  # bytes of a turn's id
SHARD_KEYS, SHARD_BYTES = 20_000, 16_000_000
BLOB = 1_000_000  # bytes of ids that are joined before they meet the others of a node
FAMILY, HEADS = 20, 4  # a conversation's first turns (fewer than HEADS) come from its family's first
EMPTY_SHA256 = hashlib.sha256().hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (place in the conversation, from 0), ``id`` and ``words`` of each turn.

    Turns are ordered by ``turn``, null first, and by id where it is the same. Rows without
    ``conv_id`` belong to no conversation. Rows are sorted by ranges and numbered in each, so
    that a conversation of very many turns is spread; the numbers of rows before a range are
    added afterwards.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    spelled = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn_id = F.expr(f"substring(unhex(sha), 1, {WIDTH})")
    rows = settle(
        conversations.filter(F.col("conv_id").isNotNull())
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.sha2(spelled, 256).alias("sha"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        )
        .select("conv_id", "turn", turn_id.alias("id"), "words", F.monotonically_increasing_id().alias("row")),
        "turns",
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "id", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = settle(
        ranged.select("conv_id", "id", "words", F.monotonically_increasing_id().alias("place")), "turns_sorted"
    )
    part = F.shiftright("place", 33).alias("part")
    starts = numbered.groupBy("conv_id", part).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    pos = (F.col("place") - F.col("first") + F.col("before")).alias("pos")
    return numbered.withColumn("part", part).join(starts, ["conv_id", "part"]).select("conv_id", pos, "id", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``key`` and ``words`` (of each turn) of every conversation, put together anew.

    The first ``h`` turns come from the family's first conversation, as far as it has them,
    the others are its own from the ``h``-th on. One without any turn left has an empty key.
    A conversation's ids are put into one row.
    """
    own_from = F.expr(f"crc32(cast(conv_id as string)) % {HEADS}")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = turns.groupBy("conv_id").agg(F.lit(1).alias("_one")).select("conv_id", family.alias("base"), own_from.alias("h"))
    heads = turns.filter((F.col("pos") < HEADS - 1) & (F.col("conv_id") == family))
    heads = heads.select(F.col("conv_id").alias("base"), "pos", "id", "words")
    borrowed = convs.join(heads, "base", "left").withColumn("used", F.coalesce(F.col("pos") < F.col("h"), F.lit(False)))
    borrowed = borrowed.select("conv_id", *(F.when(F.col("used"), F.col(c)).alias(c) for c in ("pos", "id", "words")))
    rows = borrowed.unionByName(turns.filter(F.col("pos") >= own_from))
    # rows that are not used keep their conversation, with nothing in it
    turn = F.when(F.col("id").isNotNull(), F.struct("pos", "id", "words"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    key = F.coalesce(F.unhex(F.array_join(F.transform("t.id", lambda i: F.hex(i)), "")), F.lit(b""))
    return gathered.select("conv_id", key.alias("key"), F.col("t.words").alias("words"))


class Node:
    """A radix tree node: a compressed path, perhaps a key that ends here, and children by byte."""

    __slots__ = ("path", "value", "keys", "children")

    def __init__(self, path: bytes, value: int = -1):
        self.path, self.value = path, value
        self.keys: bytearray | None = bytearray()  # up to 16 sorted bytes; a table of 256 for 48; None for 256
        self.children: list = []

    def child(self, byte: int) -> Node | None:
        keys = self.keys
        if keys is None:
            return self.children[byte]
        if len(keys) == 256:
            return self.children[keys[byte] - 1] if keys[byte] else None
        at = keys.find(byte)
        return self.children[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> None:
        """Set the child for a byte; the layout grows when it is full."""
        keys = self.keys
        if keys is None:
            self.children[byte] = node
        elif len(keys) == 256:
            if keys[byte]:
                self.children[keys[byte] - 1] = node
            elif len(self.children) < 48:
                self.children.append(node)
                keys[byte] = len(self.children)
            else:
                self.children = [self.children[k - 1] if k else None for k in keys]
                self.keys = None
                self.children[byte] = node
        else:
            at = keys.find(byte)
            if at >= 0:
                self.children[at] = node
            elif len(keys) < 16:  # 4 and 16 differ only in how much is allocated
                at = sum(k < byte for k in keys)
                keys.insert(at, byte)
                self.children.insert(at, node)
            else:
                table = bytearray(256)
                for slot, k in enumerate(keys):
                    table[k] = slot + 1
                self.keys = table
                self.put(byte, node)

    def ordered(self) -> list[Node]:
        """The children in the order of their bytes."""
        keys = self.keys
        if keys is None:
            return [c for c in self.children if c is not None]
        if len(keys) == 256:
            return [self.children[k - 1] for k in keys if k]
        return self.children


def insert(root: Node, key: bytes, value: int) -> None:
    node, at = root, 0
    while True:
        path = node.path
        if key.startswith(path, at):
            at += len(path)
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            node, at = below, at + 1
            continue
        # the path splits: what is shared stays here, the rest goes one level down
        rest = key[at : at + len(path)]
        same = next((i for i, (a, b) in enumerate(zip(path, rest)) if a != b), len(rest))
        lower = Node(path[same + 1 :], node.value)
        lower.keys, lower.children = node.keys, node.children
        node.path, node.value, node.keys, node.children = path[:same], -1, bytearray(), []
        node.put(path[same], lower)
        at += same
        if at == len(key):
            node.value = value
        else:
            node.put(key[at], Node(key[at + 1 :], value))
        return


BEFORE, BEHIND = 1, 2  # a key of the shard before, of the one behind

NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, kid binary, shared binary, parent_shared binary"
)


def shard_nodes(keys: list[bytes], n: list[int], least: list[int], words: list[list[int]], border: list[int]) -> list[list]:
    """Rows of ``NODES`` for the turn-aligned nodes of a shard's keys, deepest first.

    ``border`` is 0 for the shard's own keys, else which neighbour a key is from; those count
    nothing. ``shared`` names a node that a neighbour has too, whose figures are parts.
    """
    root = Node(b"")
    for i, key in enumerate(keys):
        insert(root, key, i)
    rows: list[list] = []
    # what is known of the subtree of each finished child: conversations, least id, leaves, saved
    # tokens, border marks, one of the shard's own keys, rows at the next turn's end
    done: list[tuple] = []
    stack = [(root, 0, False)]
    while stack:
        node, start, ready = stack.pop()
        end = start + len(node.path) + (node is not root)
        children = node.ordered()
        if not ready:
            stack.append((node, start, True))
            stack.extend((c, end, False) for c in reversed(children))
            continue
        count, smallest, leaves, saved, marks, some, tops = 0, None, 0, 0, 0, -1, []
        below = done[len(done) - len(children) :] if children else []
        del done[len(done) - len(below) :]
        value = node.value
        if value >= 0:
            count, marks = n[value], border[value]
            if count:
                smallest, some = least[value], value
                leaves = int(not children)
        for c, s, lv, sv, mk, one, tp in below:
            count, leaves, saved, marks, some = count + c, leaves + lv, saved + sv, marks | mk, one if some < 0 else some
            if s is not None and (smallest is None or s < smallest):
                smallest = s
            tops += tp
        key = keys[some] if some >= 0 else b""
        # ends of turns on the path to this node, from below; the root is one too
        for depth in range(end // WIDTH, start // WIDTH - (node is root), -1):
            if not count:
                tops = []
                continue
            new = not marks & BEFORE
            saved += (count - new) * words[some][depth - 1] if depth else 0
            shared = hashlib.sha256(key[: depth * WIDTH]).digest()[:WIDTH] if marks else None
            fresh = 0
            for t in tops:
                rows[t][2], rows[t][9] = smallest, shared
                fresh += rows[t][10]
            here = value >= 0 and depth * WIDTH == end and n[value] > 0
            kid = hashlib.sha256(keys[value]).digest() if here else None
            tops = [len(rows)]
            rows.append([smallest, depth, None, count, fresh, leaves, saved, kid, shared, None, new])
        done.append((count, smallest, leaves, saved, marks, some, tops))
    return rows


def _sharded(keys: DataFrame) -> DataFrame:
    """The distinct keys with their shard, and in each shard its neighbours' nearest keys."""
    size = keys.agg(F.count("*"), F.sum(F.length("key"))).head()
    parts = max(1, -(-size[0] // SHARD_KEYS), -(-(size[1] or 0) // SHARD_BYTES))
    ranged = keys.repartitionByRange(parts, "key").withColumn("shard", F.spark_partition_id())
    ranged = settle(ranged.withColumn("border", F.lit(0)), "trie_shards")
    order = Window.partitionBy(F.lit(0)).orderBy("shard")  # one row a shard
    ends = ranged.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    ends = ends.select("shard", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("behind"))
    ghost = lambda name, mark: ends.filter(F.col(name).isNotNull()).select(
        F.col(name).alias("key"), "shard", F.lit(mark).alias("border")
    )
    ghosts = ghost("before", BEFORE).unionByName(ghost("behind", BEHIND))
    rows = ranged.unionByName(ghosts, allowMissingColumns=True)
    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "key")


def _nodes(sharded: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in NODES.split(", ")]
    schema = pa.schema(
        [(f.split()[0], pa.int64() if f.endswith("long") else pa.binary()) for f in NODES.split(", ")]
    )

    def build(batches):
        shard, held = None, []

        def flush():
            rows = shard_nodes(*map(list, zip(*held)))
            for lo in range(0, len(rows), 20_000):
                part = rows[lo : lo + 20_000]
                columns = [pa.array([r[j] for r in part], schema.field(j).type) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for number, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "n", "least", "words", "border"))):
                if number != shard and held:
                    yield from flush()
                    held = []
                shard = number
                key, n, least, words, border = row
                held.append((key, n or 0, least, words, border))
        if held:
            yield from flush()

    return sharded.mapInArrow(build, NODES)


def _ends(members: DataFrame) -> DataFrame:
    """``kid`` and the SHA-256 of its conversations' ids, ascending and comma-joined.

    The ids of one key are sorted over ranges and joined to blobs there; the blobs, not the
    ids, meet in one task, which reads them one after the other.
    """

    def join(batches):
        kid, first, held, size = None, None, [], 0
        out: list[tuple] = []

        def cut():
            if held:
                out.append((kid, first, ",".join(held)))

        for batch in batches:
            for k, c in zip(batch.column("kid").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != kid or size > BLOB:
                    cut()
                    kid, first, held, size = k, c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            yield _batch(out, ["kid", "first", "ids"])
            out = []
        cut()
        yield _batch(out, ["kid", "first", "ids"])

    def digest(batches):
        kid, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for k, ids in zip(batch.column("kid").to_pylist(), batch.column("ids")):
                if k != kid:
                    if kid is not None:
                        out.append((kid, state.hexdigest()))
                    kid, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield _batch(out, ["kid", "ends_sha256"])
            out = []
        if kid is not None:
            yield _batch([(kid, state.hexdigest())], ["kid", "ends_sha256"])

    blobs = members.repartitionByRange("kid", "conv_id").sortWithinPartitions("kid", "conv_id")
    blobs = blobs.mapInArrow(join, "kid binary, first long, ids string")
    return blobs.repartition("kid").sortWithinPartitions("kid", "first").mapInArrow(digest, "kid binary, ends_sha256 string")


TYPES = {"kid": pa.binary(), "first": pa.int64(), "ids": pa.string(), "ends_sha256": pa.string()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], TYPES[c]) for j, c in enumerate(names)], names)


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of ``(conv_id, key, words)``, as ``prefix_trie`` describes them."""
    sequences = settle(sequences.withColumn("kid", F.unhex(F.sha2("key", 256))), "sequences")
    keys = sequences.groupBy("key").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.any_value("words").alias("words")
    )
    nodes = settle(_nodes(_sharded(settle(keys, "trie_keys"))), "trie_nodes")
    total: list[Column] = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.filter(F.col("shared").isNotNull()).groupBy("shared", "depth")
    merged = parts.agg(F.min("conv_id").alias("conv_id"), *total, F.max("kid").alias("kid"), F.max("parent_shared").alias("parent_shared"))
    merged = settle(merged, "trie_shared")
    whole = nodes.filter(F.col("shared").isNull()).unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("long")))
    above = merged.select(F.col("shared").alias("parent_shared"), F.col("conv_id").alias("above"))
    ends = _ends(sequences.select("kid", "conv_id"))
    return (
        whole.join(above, "parent_shared", "left")
        .join(ends, "kid", "left")
        .select(
            "conv_id",
            "depth",
            F.coalesce("above", "parent_conv_id").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations.

    Null roles and texts are empty ones, turns of one number are ordered by their ids, rows
    without ``conv_id`` are left out, repeated rows are turns of their own. Texts are hashed
    where they are read, however long. An empty table has no nodes, not even a root. Other
    columns are not read.
    """
    return trie(rebuilt(turn_rows(conversations)))
