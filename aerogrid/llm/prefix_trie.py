"""The trie of conversations' prefixes, built from adaptive radix trees over turn ids.

A turn is 16 bytes, big-endian: the code points of its text, then 96 bits of a hash of role and text; a conversation is the string of its
turns. Equal conversations become one key. Keys are sorted over the partitions; each task inserts runs of them into a radix tree with paths
compressed and nodes that grow from 4 over 16 and 48 to 256 ways, and emits a node wherever a depth in bytes is a whole number of turns.
Neighbouring trees share only the prefixes that the last key of one has in common with the first key of the next: those alone are merged.
"""

from __future__ import annotations

import hashlib
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_batches, materialise, small, struct

#: Bytes of a turn's id: four for its weight, twelve of a hash.
WIDTH, WEIGHT_BYTES = 16, 4
#: Keys, and bytes of keys, that one tree takes; then its nodes are emitted and the next tree begins.
TREE_KEYS, TREE_BYTES = 20_000, 16_000_000
#: Conversation ids whose decimals are joined to one piece of what a digest is made of.
PIECE = 20_000

_NODE = struct(
    ("node_id", T.BinaryType()), ("parent_id", T.BinaryType()), ("depth", T.LongType()), ("conv_id", T.LongType()), ("parent_conv_id", T.LongType()), ("n_convs", T.LongType()),
    ("n_children", T.LongType()), ("n_leaves", T.LongType()), ("saved_tokens", T.LongType()), ("ends_sha256", T.StringType()), ("shared", T.BooleanType()),
)


class Sorted:
    """Up to 4 or 16 ways: the bytes in order, found by search."""

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node):
        if len(self.nodes) == 16:
            return Indexed(self).put(byte, node)
        if len(self.nodes) == self.room:
            self.room = 16
        at = bisect(self.bytes, byte)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self):
        return zip(self.bytes, self.nodes, strict=True)


class Indexed:
    """Up to 48 ways: 256 one-byte places in a list of nodes."""

    def __init__(self, ways: Sorted):
        self.place, self.nodes = bytearray(256), []
        for byte, node in ways.items():
            self.put(byte, node)

    def get(self, byte: int):
        at = self.place[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node):
        if len(self.nodes) == 48:
            return Direct(self).put(byte, node)
        self.nodes.append(node)
        self.place[byte] = len(self.nodes)
        return self

    def items(self):
        return ((b, self.nodes[at - 1]) for b, at in enumerate(self.place) if at)


class Direct:
    """A way for each byte."""

    def __init__(self, ways: Indexed):
        self.nodes = [None] * 256
        for byte, node in ways.items():
            self.nodes[byte] = node

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def items(self):
        return ((b, node) for b, node in enumerate(self.nodes) if node is not None)


class Radix:
    """A node: the compressed path to it beyond its parent's byte, the ways on, and what ends here."""

    __slots__ = ("end", "path", "ways")

    def __init__(self, path: bytes, ways=None, end=None):
        self.path, self.ways, self.end = path, ways, end


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def insert(root: Radix, key: bytes, end) -> None:
    """Adds a key that the tree doesn't hold; the root has no path."""
    node, at = root, 0
    while True:
        rest = key[at : at + len(node.path)]
        if rest != node.path:
            cut = shared_length(rest, node.path)
            below = Radix(node.path[cut + 1 :], node.ways, node.end)
            node.ways, node.end = Sorted().put(node.path[cut], below), None
            node.path = node.path[:cut]
        at += len(node.path)
        if at == len(key):
            node.end = end
            return
        child = node.ways.get(key[at]) if node.ways else None
        if child is None:
            node.ways = (node.ways or Sorted()).put(key[at], Radix(key[at + 1 :], None, end))
            return
        node, at = child, at + 1


def _aligned(key: bytes, length: int) -> set[bytes]:
    """Names of the prefixes of whole turns within the first bytes of a key."""
    h, out = hashlib.md5(), set()
    for at in range(0, length + 1, WIDTH):
        out.add(h.digest())
        h.update(key[at : at + WIDTH])
    return out


class Frame:
    """A radix node on the way down, and the sums of what lies below it."""

    __slots__ = ("hash", "ids", "kids", "leaves", "left", "low", "n", "node", "rows", "saved", "tops")

    def __init__(self, node: Radix, hash_, ids: list[tuple[bytes, int]], left: bytes):
        self.node, self.hash, self.ids, self.left = node, hash_, ids, left
        self.n = self.saved = self.leaves = self.tops = 0
        self.low, self.rows = None, []  # the smallest conversation; rows that wait for their parent's
        self.kids = node.ways.items() if node.ways else iter(())

    def add(self, n: int, low: int, saved: int, leaves: int, tops: int, rows: list) -> None:
        self.n, self.saved, self.leaves, self.tops = self.n + n, self.saved + saved, self.leaves + leaves, self.tops + tops
        self.low = low if self.low is None else min(self.low, low)
        self.rows = rows if not self.rows else self.rows + rows if len(rows) > 1 else (self.rows.append(rows[0]) or self.rows) if rows else self.rows


def emit(root: Radix, goes_on: set[bytes], came: set[bytes]) -> list[list]:
    """Rows of all nodes of whole turns, without recursion.

    goes_on: names of prefixes that the next tree holds too; came: that the one before holds. A prefix is counted as a node (for its
    parent's children, as a leaf, and for the one text that must be stored) in the last tree that holds it, so sums over trees are right.
    """
    none, out = hashlib.sha256(b"").hexdigest(), []
    start = hashlib.md5()
    stack = [Frame(root, start, [(start.digest(), 0)], b"")]
    while True:
        f = stack[-1]
        step = next(f.kids, None)
        if step is not None:
            byte, child = step
            path = f.left + bytes((byte,)) + child.path
            h, ids = f.hash, []
            for at in range(0, len(path) - WIDTH + 1, WIDTH):
                h = h.copy()
                h.update(path[at : at + WIDTH])
                ids.append((h.digest(), int.from_bytes(path[at : at + WEIGHT_BYTES], "big")))
            stack.append(Frame(child, h, ids, path[len(path) - len(path) % WIDTH :]))
            continue
        stack.pop()
        end, bare = f.node.end, f.node.ways is None
        if end:
            f.add(end[0], end[1], 0, 0, 0, [])
        above = next((g for g in reversed(stack) if g.ids), None)
        depth = sum(len(g.ids) for g in stack) + len(f.ids) - 1 if f.ids else 0
        for i in range(len(f.ids) - 1, -1, -1):
            name, weight = f.ids[i]
            counted = name not in goes_on
            f.leaves += counted and bare
            f.saved += (f.n - counted) * weight
            parent = f.ids[i - 1][0] if i else above.ids[-1][0] if above else None
            row = [name, parent, depth, f.low, None, f.n, f.tops, f.leaves, f.saved, end[2] if end else none, not counted or name in came]
            for waiting in f.rows:
                waiting[4] = f.low
            out.append(row)
            f.rows, f.tops, end, bare, depth = [row], int(counted), None, False, depth - 1
        if not stack:
            return out
        stack[-1].add(f.n, f.low, f.saved, f.leaves, f.tops, f.rows)


def turn_id(role: Column | str, text: Column | str) -> Column:
    """16 bytes as hexadecimal digits: the text's code points, and a hash of role and text; null counts as empty."""
    role, text = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(F.lpad(F.lower(F.hex(F.length(text))), 2 * WEIGHT_BYTES, "0"), F.substring(digest, 1, 2 * (WIDTH - WEIGHT_BYTES)))


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its turns' ids in order: null turn numbers first, equal ones by id. Rows without a conv_id belong to no conversation."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_id(role_col, text_col).alias("tid"))
    held = rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "tid"))).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: t["tid"]).alias("tids"))


def share_openings(turns: DataFrame, every: int = 100, kinds: int = 6) -> DataFrame:
    """Conversations that open as another does: the first h turns of conversation c - c % every, then c's own beyond its first h.

    h is crc32 of c's decimals, modulo kinds; remainders have the sign of c. Of an opening that has fewer turns all are taken, of one that isn't there none.
    """
    c = F.col("conv_id")
    mine = turns.withColumn("h", (F.crc32(c.cast("string").cast("binary")) % kinds).cast("int")).withColumn("of", c - c % every)
    heads = turns.filter(c % every == 0).select(c.alias("of"), F.slice("tids", 1, kinds - 1).alias("head"))
    none = F.array().cast("array<string>")
    own = F.slice("tids", F.col("h") + 1, F.greatest(F.size("tids") - F.col("h"), F.lit(0)))
    return mine.join(heads, "of", "left").select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), own).alias("tids"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, conv_id) in order: runs of one key, their decimals joined."""
    key, ids, rows = None, [], []

    def close():
        if ids:
            rows.append((key, ids[0], len(ids), ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or len(ids) == PIECE:
                close()
                key = k
            ids.append(c)
        if len(rows) >= 1000:
            yield _piece_rows(rows)
            rows = []
    close()
    yield _piece_rows(rows)


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "first", "n", "decimals"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: a row for each key, with the digest of all its decimals; only one piece is held."""
    key, rows, now = None, [], None
    for batch in batches:
        for k, first, n, text in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
            if now is None or k != key:
                if now:
                    rows.append((key, now[0], now[1], now[2].hexdigest()))
                key, now = k, [first, 0, hashlib.sha256()]
            elif now[1]:
                now[2].update(b",")
            now[1] += n
            now[2].update(text.encode())
        if len(rows) >= 1000:
            yield _piece_rows(rows).rename_columns(["key", "first", "n", "sha"])
            rows = []
    if now:
        rows.append((key, now[0], now[1], now[2].hexdigest()))
    yield _piece_rows(rows).rename_columns(["key", "first", "n", "sha"])


def _trees(tree_keys: int, tree_bytes: int):
    """Of keys in order of (part, key): the nodes of one radix tree after the other. Rows of no conversation are a part's neighbours."""
    kinds = {T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.StringType: pa.string()}
    fields = [(f.name, kinds[type(f.dataType)]) for f in _NODE.fields]

    def rows_of(tree: Radix, first: bytes, before: bytes | None, last: bytes, after: bytes | None) -> Iterator[pa.RecordBatch]:
        goes_on = _aligned(last, shared_length(last, after)) if after is not None else set()
        came = _aligned(first, shared_length(first, before)) if before is not None else set()
        rows = emit(tree, goes_on, came)
        for at in range(0, len(rows), 10_000):
            cols = list(zip(*rows[at : at + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [name for name, _ in fields])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = first = last = before = None
        part, held, size = None, 0, 0
        for batch in batches:
            for p, key, n, conv, sha in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
                if tree is not None and (p != part or n == 0 or held >= tree_keys or size >= tree_bytes):
                    yield from rows_of(tree, first, before, last, key if p == part else None)
                    before, tree = last, None
                if p != part:
                    part, before = p, None
                if n == 0:
                    before = key
                    continue
                if tree is None:
                    tree, first, held, size = Radix(b""), key, 0, 0
                insert(tree, key, (n, conv, sha))
                last, held, size = key, held + 1, size + len(key)
        if tree is not None:
            yield from rows_of(tree, first, before, last, None)

    return grow


def prefix_trie(turns: DataFrame, parts: int | None = None, tree_keys: int = TREE_KEYS, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """A row for each different prefix of the conversations (conv_id, tids: ids by turn_id): node_id, parent_id, and what the query returns.

    conv_id is the node's smallest member, parent_conv_id its parent's (of the root: null); n_convs counts the members, n_children the nodes
    one turn longer; n_leaves (childless nodes) and saved_tokens (weights of last turns, for all members but one) are sums over the subtree
    with its top; ends_sha256 is the digest of the decimal ids, ascending and comma-joined, of the conversations that end here. A conversation without turns is a member of
    the root alone. Without any conversation there is no node. Of rows that repeat a conv_id each is a member.

    A task holds one tree of tree_keys keys at most, and a conversation is one key of 16 bytes a turn. Copies of one conversation are pieces
    of ids that are joined a piece at a time. Of the nodes only those on the edges of trees are shuffled.
    """
    n = parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.unhex(F.array_join("tids", "")).alias("key"), F.col("conv_id").cast("long").alias("conv_id"))
    sorted_ids = rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    kept = (("key", T.BinaryType()), ("first", T.LongType()), ("n", T.LongType()))
    pieces = map_batches(sorted_ids, _pieces, struct(*kept, ("decimals", T.StringType())))
    ends = map_batches(pieces.repartitionByRange(n, "key").sortWithinPartitions("key", "first"), _digests, struct(*kept, ("sha", T.StringType())))
    keys = materialise(ends.select(F.spark_partition_id().alias("part"), "key", "n", "first", "sha"))
    edges = keys.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    by = Window.orderBy("part")  # a row for each partition
    edges = edges.select("part", F.lag("high").over(by).alias("before"), F.lead("low").over(by).alias("after"))
    edges = edges.select("part", F.explode(F.array("before", "after")).alias("key")).filter(F.col("key").isNotNull())
    edges = edges.select("part", "key", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("sha"))
    placed = keys.unionByName(edges).repartition(n, "part").sortWithinPartitions("part", "key")
    nodes = materialise(map_batches(placed, _trees(tree_keys, tree_bytes), _NODE))
    same = [c for c in nodes.columns if c not in ("shared", "parent_conv_id")]
    whole = {"conv_id": F.min, "ends_sha256": F.max, "parent_id": F.first, "depth": F.first}
    # where nothing ends the digest is that of nothing: any other one is the node's
    nothing = hashlib.sha256(b"").hexdigest()
    edge = nodes.filter("shared").withColumn("ends_sha256", F.nullif("ends_sha256", F.lit(nothing)))
    edge = edge.groupBy("node_id").agg(*[whole.get(c, F.sum)(c).alias(c) for c in same[1:]]).fillna(nothing, ["ends_sha256"])
    edge = materialise(edge.withColumn("parent_conv_id", F.lit(None).cast("long")))
    names = small(edge.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("edge_conv")))
    out = nodes.filter(~F.col("shared")).select(*edge.columns).unionByName(edge).join(names, "parent_id", "left")
    out = out.withColumn("parent_conv_id", F.coalesce("edge_conv", "parent_conv_id")).drop("edge_conv")
    discard(keys)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", F.hex("node_id").alias("node_id"), F.hex("parent_id").alias("parent_id")
    )


def prefix_trie_sql(every: int = 100, kinds: int = 6) -> str:
    """The query's rows for the table conversations, as DuckDB SQL: all prefixes, and all pairs of a node and one above it."""
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ord(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT)"
    )
    tid = "md5(len(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))"
    width = "printf('%08x', len(coalesce(text, '')))"
    return f"""
    WITH turns AS (SELECT conv_id, turn, {width} || substr({tid}, 1, 24) AS tid, len(coalesce(text, '')) AS weight FROM conversations WHERE conv_id IS NOT NULL),
    seqs AS (SELECT conv_id, list(tid ORDER BY turn NULLS FIRST, tid) AS tids, list(weight ORDER BY turn NULLS FIRST, tid) AS weights FROM turns GROUP BY conv_id),
    mine AS (SELECT *, {crc} % {kinds} AS h, conv_id - conv_id % {every} AS start FROM seqs),
    rebuilt AS (
      SELECT mine.conv_id, list_concat(coalesce(list_slice(o.tids, 1, h), []), list_slice(mine.tids, h + 1, len(mine.tids))) AS tids,
        list_concat(coalesce(list_slice(o.weights, 1, h), []), list_slice(mine.weights, h + 1, len(mine.weights))) AS weights
      FROM mine LEFT JOIN seqs o ON o.conv_id = mine.start
    ), prefixes AS (SELECT conv_id, unnest(generate_series(0, len(tids)))::BIGINT AS depth, tids, weights FROM rebuilt),
    members AS (SELECT conv_id, depth, array_to_string(list_slice(tids, 1, depth), '') AS node, CASE WHEN depth > 0 THEN list_extract(weights, depth) ELSE 0 END AS weight, depth = len(tids) AS ends FROM prefixes),
    nodes AS (
      SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(weight) * (count(*) - 1) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM members GROUP BY node
    ), family AS (SELECT node, substr(node, 1, 32 * (depth - 1)) AS parent FROM nodes WHERE depth > 0),
    children AS (SELECT parent AS node, count(*) AS n_children FROM family GROUP BY parent),
    sums AS (
      SELECT top AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
      FROM (
        SELECT substr(nodes.node, 1, 32 * unnest(generate_series(0, depth))) AS top, saved, n_children IS NULL AS leaf FROM nodes LEFT JOIN children USING (node)
      ) GROUP BY top
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN family USING (node) LEFT JOIN nodes p ON p.node = family.parent"""
