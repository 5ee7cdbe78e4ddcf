"""Trie of conversations: one node per distinct sequence of first turns, with its members, children and savings.

A turn's id is a 128-bit digest of role and text, written big-endian in 16 bytes; a conversation is the string of its turns' ids.
Tasks hold such strings in adaptive radix trees: nodes of 4, 16, 48 or 256 children that grow as they fill, with the bytes that
all keys below share kept in the node (path compression). Only byte depths that end a turn are nodes of the trie; a
compressed path emits every one it passes. Each tree sends one partial row per node, so a prefix that a third of all conversations share
costs a row per tree, and rows of a node are merged by the digest of its path.

What a subtree holds is summed without walking it level by level. A node's owner is its smallest member, and the nodes an
owner has are the last ones of its own path. So the distinct bytes below a node are, over its members, the lesser of the bytes they have
left there and the bytes they own, and the leaves below it are the members that own one: plain sums over members again.

Conversations longer than `SEGMENT` turns are cut into segments, each keyed by the digest of what came before, so
neither a key nor a task grows with a conversation. The hash of the members that end in a node is read off rows sorted by node and id,
one at a time: its order is part of its definition, so a node's own list passes through one task, as a stream.

Rows without `conv_id` belong to no conversation and are left out. NULL role and text count as empty; NULL turns come first, equal turns in the order of
their ids, and repeated rows are turns of their own. Empty tables give no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import arrow_schema, settle

WIDTH = 16
#: Most turns in one key; most keys in one tree.
SEGMENT, TREE_KEYS = 64, 20_000
ROOT = bytes(WIDTH)
PATHS = "conv_id long, before long, anchor binary, ids binary, bytes array<long>, rest array<long>, total long, last boolean, end_key binary"


class Node:
    """A node with up to 4 or 16 children in sorted arrays, up to 48 behind an index of 256 bytes, or 256 slots."""

    __slots__ = ("prefix", "ends", "capacity", "labels", "children")

    def __init__(self, prefix: bytes, ends: list[int]):
        self.prefix, self.ends = prefix, ends
        self.capacity, self.labels, self.children = 4, bytearray(), []

    def child(self, label: int) -> Node | None:
        if self.capacity <= 16:
            at = bisect_left(self.labels, label)
            return self.children[at] if at < len(self.labels) and self.labels[at] == label else None
        if self.capacity == 48:
            slot = self.labels[label]
            return self.children[slot - 1] if slot else None
        return self.children[label]

    def put(self, label: int, node: Node) -> None:
        """Set the child at `label`; a full node changes to the next layout first."""
        if self.capacity <= 16:
            at = bisect_left(self.labels, label)
            if at < len(self.labels) and self.labels[at] == label:
                self.children[at] = node
                return
            if len(self.labels) < self.capacity or self.capacity == 4:
                self.capacity = 16 if len(self.labels) == 4 else self.capacity
                self.labels.insert(at, label)
                self.children.insert(at, node)
                return
            index = bytearray(256)
            for slot, own in enumerate(self.labels):
                index[own] = slot + 1
            self.capacity, self.labels = 48, index
        if self.capacity == 48:
            slot = self.labels[label]
            if slot:
                self.children[slot - 1] = node
                return
            if len(self.children) < 48:
                self.children.append(node)
                self.labels[label] = len(self.children)
                return
            self.children = [self.children[s - 1] if s else None for s in self.labels]
            self.capacity, self.labels = 256, bytearray()
        self.children[label] = node

    def items(self) -> list[tuple[int, Node]]:
        if self.capacity <= 16:
            return list(zip(self.labels, self.children))
        if self.capacity == 48:
            return [(label, self.children[s - 1]) for label, s in enumerate(self.labels) if s]
        return [(label, n) for label, n in enumerate(self.children) if n is not None]


class RadixTree:
    """Byte strings with the numbers of the rows that have them."""

    def __init__(self) -> None:
        self.root = Node(b"", [])

    def insert(self, key: bytes, row: int) -> None:
        parent, label, node, at = None, 0, self.root, 0
        while True:
            if not key.startswith(node.prefix, at):
                same = 0
                while at + same < len(key) and node.prefix[same] == key[at + same]:
                    same += 1
                upper = Node(node.prefix[:same], [])
                upper.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                if parent is None:
                    self.root = upper
                else:
                    parent.put(label, upper)
                node = upper
            at += len(node.prefix)
            if at == len(key):
                node.ends.append(row)
                return
            parent, label = node, key[at]
            found = node.child(label)
            at += 1
            if found is None:
                node.put(label, Node(key[at:], [row]))
                return
            node = found

    def walk(self) -> tuple[list[int], list[tuple[int, bytes, int, int]]]:
        """Rows in the order of their keys, and (length before, path, first, last) of every node: its rows are order[first:last]."""
        order, nodes, stack = [], [], [(self.root, 0, self.root.prefix, -1)]
        while stack:
            node, start, path, entry = stack.pop()
            if entry >= 0:
                nodes[entry] = (start, path, nodes[entry][2], len(order))
                continue
            nodes.append((start, path, len(order), 0))
            order += node.ends
            stack.append((node, start, path, len(nodes) - 1))
            stack += [(n, len(path), path + bytes([label]) + n.prefix, -1) for label, n in reversed(node.items())]
        return order, nodes


def next_key(key: bytes, turn_id: bytes) -> bytes:
    """The digest of a path, from that of the path without its last turn."""
    return hashlib.sha256(key + turn_id).digest()[:WIDTH]


def aligned_nodes(rows: list[dict]) -> Iterator[tuple[bytes, bytes | None, int, list[dict]]]:
    """(key, parent's key, depth, members) of every turn-aligned node of the tree over the segments `rows`."""
    tree = RadixTree()
    for k, r in enumerate(rows):
        tree.insert(r["anchor"] + r["ids"], k)
    order, nodes = tree.walk()
    keys: dict[bytes, bytes] = {}  # digests at the ends of paths above, by aligned path
    for start, path, first, last in nodes:
        members = [rows[k] for k in order[first:last]]
        for length in range(WIDTH * (start // WIDTH + 1), len(path) + 1, WIDTH):
            depth = members[0]["before"] + length // WIDTH - 1
            if length == WIDTH:
                keys[path[:length]] = path[:length]
                if not depth:
                    yield ROOT, None, 0, members
                continue
            above = keys[path[: length - WIDTH]]
            key = keys[path[:length]] = next_key(above, path[length - WIDTH : length])
            yield key, above, depth, members


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(`conv_id`, `pos` from 1, `turn_id`, `n_bytes`) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(digest), 1, WIDTH).alias("turn_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_id")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "turn_id", "n_bytes")


def paths(turns: DataFrame, near: str) -> DataFrame:
    """Segments of every conversation of (conv_id, pos, turn_id, n_bytes); conversations with equal `near` go to one task.

    A row without `turn_id` only says that there is such a conversation. Rows pass as a sorted stream.
    """
    whole = Window.partitionBy(near, "conv_id")
    left = F.sum("n_bytes").over(whole) - F.sum("n_bytes").over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) + F.col("n_bytes")
    total = F.sum("n_bytes").over(whole)
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.repartition(tasks, near).withColumns({"rest": left, "total": total}).sortWithinPartitions(near, "conv_id", "pos")
    schema = arrow_schema(PATHS)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out, now = None, [], {}

        def begin(conv_id: int, before: int, anchor: bytes, total: int) -> dict:
            return {"conv_id": conv_id, "before": before, "anchor": anchor, "ids": b"", "bytes": [], "rest": [], "total": total, "last": False, "end_key": anchor}

        for batch in batches:
            for conv_id, turn_id, n_bytes, rest, total in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != conv:
                    if now:
                        out.append(now | {"last": True})
                    conv, now = conv_id, begin(conv_id, 0, ROOT, total)
                if turn_id is None:
                    continue
                if len(now["bytes"]) == SEGMENT:
                    out.append(now)
                    now = begin(conv_id, now["before"] + SEGMENT, now["end_key"], total)
                now["ids"] += turn_id
                now["bytes"].append(n_bytes)
                now["rest"].append(rest)
                now["end_key"] = next_key(now["end_key"], turn_id)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now:
            yield pa.RecordBatch.from_pylist([now | {"last": True}], schema)

    return rows.select("conv_id", "turn_id", "n_bytes", "rest", "total").mapInArrow(segments, PATHS)


def from_trees(segments: DataFrame, ddl: str, row: Callable) -> DataFrame:
    """Rows `row(key, parent, depth, members)` of every node of the trees over bounded runs of segments."""
    schema = arrow_schema(ddl)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for start in range(0, batch.num_rows, TREE_KEYS):
                held += batch.slice(start, TREE_KEYS).to_pylist()
                if len(held) >= TREE_KEYS:
                    yield pa.RecordBatch.from_pylist([row(*n) for n in aligned_nodes(held)], schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist([row(*n) for n in aligned_nodes(held)], schema)

    return segments.mapInArrow(grown, ddl)


def _counted(key: bytes, parent: bytes | None, depth: int, members: list[dict]) -> dict:
    n_bytes = members[0]["bytes"][depth - members[0]["before"] - 1] if depth else 0
    return {"key": key, "parent": parent, "depth": depth, "n": len(members), "owner": min(m["conv_id"] for m in members), "n_bytes": n_bytes}


def _summed(key: bytes, parent: bytes | None, depth: int, members: list[dict]) -> dict:
    left = [m["rest"][depth - m["before"] - 1] if depth else m["total"] for m in members]
    own = sum(min(x, m["owned_bytes"]) for x, m in zip(left, members))
    return {"key": key, "leaves": sum(m["owns_leaf"] for m in members), "saved": sum(left) - own}


def ends(segments: DataFrame) -> DataFrame:
    """(`key`, `ends_sha256`): SHA-256 of the ids, ascending and joined by commas, of the conversations that end in a node."""
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.where("last").select(F.col("end_key").alias("key"), "conv_id").repartition(tasks, "key").sortWithinPartitions("key", "conv_id")
    ddl = "key binary, ends_sha256 string"
    schema = arrow_schema(ddl)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for key, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if state:
                        out.append({"key": now, "ends_sha256": state.hexdigest()})
                    now, state = key, hashlib.sha256(str(conv_id).encode())
                else:
                    state.update(b",%d" % conv_id)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state:
            yield pa.RecordBatch.from_pylist([{"key": now, "ends_sha256": state.hexdigest()}], schema)

    return rows.mapInArrow(hashed, ddl)


def prefix_trie(turns: DataFrame, near: str = "conv_id") -> DataFrame:
    """Nodes of the trie over (conv_id, pos, turn_id, n_bytes): conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `saved_tokens` sums, over a node's subtree, (n_convs - 1) times the bytes of the node's last text. `near` names a column by which
    conversations that share prefixes lie together; it decides on speed only.
    """
    segments = settle(paths(turns, near), "paths")
    partial = from_trees(segments.drop("rest", "total"), "key binary, parent binary, depth long, n long, owner long, n_bytes long", _counted)
    merged = partial.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("owner").alias("owner"), F.min("n_bytes").alias("n_bytes")
    )
    merged = settle(merged, "merged")
    below = merged.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(merged.join(below, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("n_bytes").alias("owned_bytes"), F.max((F.col("n_children") == 0).cast("long")).alias("owns_leaf"))
    known = segments.drop("bytes", "last", "end_key").join(owned, "conv_id", "left").fillna(0, ["owned_bytes", "owns_leaf"])
    sums = from_trees(known, "key binary, leaves long, saved long", _summed).groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    parents = nodes.select(F.col("key").alias("parent"), F.col("owner").alias("parent_conv_id"))
    whole = nodes.join(sums, "key").join(ends(segments), "key", "left").join(parents, "parent", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
