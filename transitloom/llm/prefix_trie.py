"""Prefix trie of conversations: ternary search trees over coded turns for each range of sequences, merged where ranges meet."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, join_dealt, partitions, written

#: Conversations of a block of this many numbers share the beginning of the block's first one.
BLOCK = 100

#: A conversation takes fewer turns than this from its block's first one.
SHARED = 6

#: Conversations whose numbers are joined to one text on the way to the digest of a node's ends.
CHUNK_BITS = 12

#: Turns of the sequences in one tree.
TURNS_A_SHARD = 200_000

#: Nodes in one batch that a tree's task returns.
BATCH = 16_384

ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: key: of nodes that other shards may hold too; parent_key: of nodes whose parent is such a one; chars: of the node's last text.
SHARD = f"{NODE}, key binary, parent_key binary, chars long, bare boolean"


class TernaryTree:
    """Distinct sequences in a ternary search tree: siblings are a binary tree by ``low`` and ``high``, children hang at ``below``."""

    def __init__(self) -> None:
        self.code, self.chars, self.low, self.high, self.below = [None], [0], [-1], [-1], [-1]
        self.ends: dict[int, tuple[int, int, str]] = {}  # node: conversations that end there, the smallest, their digest

    def _new(self, code: int, chars: int) -> int:
        self.code.append(code)
        self.chars.append(chars)
        for links in (self.low, self.high, self.below):
            links.append(-1)
        return len(self.code) - 1

    def path(self, codes: list[int], chars: list[int]) -> list[int]:
        """The nodes from the root down these turns; those that are not there yet are made."""
        at, found = 0, [0]
        for code, length in zip(codes, chars, strict=True):
            links, k = self.below, at
            while (node := links[k]) >= 0 and self.code[node] != code:
                links, k = (self.low if code < self.code[node] else self.high), node
            if node < 0:
                node = links[k] = self._new(code, length)
            at = node
            found.append(at)
        return found

    def fill(self, sequences: list[tuple]) -> None:
        """Inserts sorted sequences (codes, chars, n, first, digest), each range's median before its halves, so siblings stay balanced."""
        ranges = [(0, len(sequences))]
        while ranges:
            start, end = ranges.pop()
            if start < end:
                middle = (start + end) // 2
                codes, chars, *ends = sequences[middle]
                self.ends[self.path(codes, chars)[-1]] = tuple(ends)
                ranges += [(start, middle), (middle + 1, end)]

    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """Nodes with parents before children, and each node's parent and depth by node."""
        order, parent, depth = [], [-1] * len(self.code), [0] * len(self.code)
        waiting = [0]
        while waiting:
            node = waiting.pop()
            order.append(node)
            siblings = [self.below[node]]
            while siblings:
                child = siblings.pop()
                if child >= 0:
                    parent[child], depth[child] = node, depth[node] + 1
                    waiting.append(child)
                    siblings += [self.low[child], self.high[child]]
        return order, parent, depth


def shard_nodes(sequences: list[tuple]) -> Iterator[tuple]:
    """Rows of SHARD for the nodes of a shard's sorted distinct sequences, counted as if no other shard had any."""
    tree = TernaryTree()
    tree.fill(sequences)
    order, parent, depth = tree.walk()
    size = len(tree.code)
    members, first, leaves, saved, children = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    for node, (n, smallest, _) in tree.ends.items():
        members[node], first[node] = n, smallest
    for node in reversed(order):
        leaves[node] = leaves[node] or 1
        saved[node] += (members[node] - 1) * tree.chars[node]
        above = parent[node]
        if above >= 0:
            members[above] += members[node]
            first[above] = first[node] if first[above] is None else min(first[above], first[node])
            leaves[above] += leaves[node]
            saved[above] += saved[node]
            children[above] += 1
    keys = {}
    for codes, chars, *_ in (sequences[0], sequences[-1]):
        key = ROOT
        for node in tree.path(codes, chars):
            if node:
                key = hashlib.sha256(key + tree.code[node].to_bytes(8, "big")).digest()[:16]
            keys[node] = key
    for node in order:
        above = parent[node]
        ends = tree.ends.get(node, (0, None, EMPTY))[2]
        yield (depth[node], first[node], first[above] if above >= 0 else None, members[node], children[node], leaves[node], saved[node], ends, keys.get(node), keys.get(above), tree.chars[node], not children[node])


def _merged_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Distinct sequences of a partition sorted by sequence and chunk, with the digest of all conversations that end there."""
    last, n, first, digest = None, 0, None, None
    for batch in batches:
        for codes, chars, count, smallest, numbers in zip(*(batch.column(k).to_pylist() for k in ("codes", "chars", "n", "first", "numbers")), strict=True):
            if last is None or last[0] != codes:
                if last is not None:
                    yield (*last, n, first, digest.hexdigest())
                last, n, first, digest = (codes, chars), 0, smallest, hashlib.sha256()
            digest.update(("," * (n > 0) + numbers).encode())
            n, first = n + count, min(first, smallest)
    if last is not None:
        yield (*last, n, first, digest.hexdigest())


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*((c, pa.int32() if c == "depth" else pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("chars", pa.int64()), ("bare", pa.bool_())])
    sequences = list(_merged_ends(batches))
    if not sequences:
        return
    rows: list[tuple] = []
    for row in shard_nodes(sequences):
        rows.append(row)
        if len(rows) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def coded_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, digest, code, chars): each turn with the dictionary number of its role and text; texts are not shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    read = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.unhex(F.substring(whole, 1, 32)).alias("digest"), F.length(text).alias("chars"))
    rows = written(read, "trie-turns")
    counted = rows.groupBy("digest").agg(F.count("*").alias("uses"))
    words = written(counted.withColumn("code", F.monotonically_increasing_id()), "trie-dictionary")
    return written(join_dealt(rows, words, "digest", "uses", 48, ["conv_id", "turn"]).drop("uses"), "trie-coded")


def rebuilt_conversations(coded: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """(conv_id, place, codes, chars): every conversation with the beginning of its block's first one; ``place`` grows with conv_id."""
    turn = F.struct("turn", "digest", "code", "chars")
    ranged = coded.repartitionByRange(partitions(coded.sparkSession), "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    own = ranged.select("conv_id", F.col("turns.code").alias("codes"), F.col("turns.chars").alias("chars"))
    own = written(own.sortWithinPartitions("conv_id").withColumn("place", F.monotonically_increasing_id()), "trie-conversations")
    number = F.col("conv_id")
    base = own.filter(number % block == 0).select(number.alias("base"), F.slice("codes", 1, shared).alias("base_codes"), F.slice("chars", 1, shared).alias("base_chars"))
    taken = (F.crc32(number.cast("string").cast("binary")) % shared).cast("int")
    joined = own.withColumn("base", number - number % block).join(if_small(base, 64 + 12 * shared), "base", "left").withColumn("taken", taken)

    def whole(column: str) -> Column:
        before = F.when(F.col(f"base_{column}").isNotNull(), F.slice(f"base_{column}", F.lit(1), F.col("taken")))
        after = F.slice(column, F.col("taken") + 1, F.size(column))
        return F.when(before.isNull(), after).otherwise(F.concat(before, after)).alias(column)

    return joined.select("conv_id", "place", whole("codes"), whole("chars"))


def summed_up(nodes: DataFrame) -> DataFrame:
    """(key, saved, leaves): the sums of each node's and all its descendants' values, by doubling how far a node looks up.

    ``nodes`` has (key, up, depth, saved, leaves), ``up`` the parent's key. After each round a
    node holds the sums of twice as many levels, so rounds are the logarithm of the depth.
    """
    deepest, step = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        gained = nodes.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        above = nodes.filter(F.col("depth") >= step).select(F.col("key").alias("up"), F.col("up").alias("next"))
        far = nodes.filter(F.col("depth") >= 2 * step).select("key", "up").join(if_small(above, 64), "up").select("key", "next")
        nodes = nodes.drop("up").join(gained, "key", "left").join(far, "key", "left")
        nodes = nodes.select("key", F.col("next").alias("up"), "depth", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("saved", "leaves")])
        nodes, step = written(nodes, "trie-sums"), 2 * step
    return nodes.select("key", "saved", "leaves")


def merged_boundary(trie: DataFrame) -> DataFrame:
    """The nodes that several shards may hold, one row each, with what the shards counted more than once taken out.

    A node of k shards added its text k - 1 times too rarely to its own and its ancestors'
    savings, was a leaf in those shards that have no child of it, and counts as k children.
    """
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ends = F.coalesce(F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))), F.lit(EMPTY)).alias("ends_sha256")
    same = [F.min(c).alias(c) for c in ("depth", "conv_id", "parent_key", "chars")]
    held = trie.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("shards"), F.sum(F.col("bare").cast("long")).alias("bare"), ends, *total, *same)
    held = written(held, "trie-boundary")
    twice = held.filter("shards > 1")
    values = twice.select("key", F.col("parent_key").alias("up"), "depth", ((F.col("shards") - 1) * F.col("chars")).alias("saved"), (-F.col("bare")).alias("leaves"))
    sums = summed_up(written(values, "trie-shared"))
    again = twice.filter(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.sum(F.col("shards") - 1).alias("again"))
    fixed = held.join(if_small(sums, 48), "key", "left").join(again, "key", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return written(fixed.select("key", "parent_key", "depth", "conv_id", "n_convs", plus("n_children", -F.col("again")), plus("n_leaves", F.col("leaves")), plus("saved_tokens", F.col("saved")), "ends_sha256"), "trie-merged")


def conversation_trie(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations, a row each.

    A conversation c takes its first h = crc32(decimal c) % shared turns from c - c % block and
    the rest from its own. Returns conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256, as the node's members,
    children, childless descendants (itself included), code points that sharing saves in the
    subtree, and the digest of the conversations that end there.

    Turns go by their number, null first; of one number by the digest of role and text, so
    repeated rows are turns of their own. Null roles and texts are empty. Rows without a
    conv_id belong to no conversation. An empty table has no nodes, not even a root. The
    codes of one conversation are one row, twelve bytes for each turn.
    """
    spark = turns.sparkSession
    whole = rebuilt_conversations(coded_turns(turns, conv_col, turn_col, role_col, text_col), block, shared)
    chunk = F.shiftright("place", CHUNK_BITS).alias("chunk")
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("numbers")
    chunks = whole.groupBy("codes", chunk).agg(F.any_value("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("first"), numbers)
    chunks = written(chunks, "trie-chunks")
    long = chunks.agg(F.sum(F.size("codes"))).first()[0] or 0
    shards = max(partitions(spark), math.ceil(long / TURNS_A_SHARD))
    ranged = chunks.repartitionByRange(shards, "codes").sortWithinPartitions("codes", "chunk")
    trie = written(ranged.mapInArrow(_trees, SHARD), "trie-shards")
    merged = merged_boundary(trie)
    names = [c.split()[0] for c in NODE.split(", ")]
    inner = trie.filter(F.col("key").isNull()).select(*names, "parent_key")
    outer = merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names, "parent_key")
    rows = inner.union(outer)
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), F.col("n_children").alias("below"))
    tied = join_dealt(rows.filter(F.col("parent_key").isNotNull()), parents, "parent_key", "below", 48, ["conv_id", "depth"])
    done = tied.withColumn("parent_conv_id", F.col("above")).select(*names).union(rows.filter(F.col("parent_key").isNull()).select(*names))
    return done.select("conv_id", F.col("depth").cast("long").alias("depth"), *names[2:])


#: The same nodes for DuckDB. Prefixes are lists of turn numbers, so its work grows with the square of a conversation's length.
TRIE_SQL = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
coded AS (SELECT conv_id, dense_rank() OVER (ORDER BY role, text) AS code, length(text) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS place FROM turns),
lengths AS (SELECT DISTINCT code, chars FROM coded),
convs AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda a, i: xor(a >> 1, 3988292384 * (a & 1))))) % 6 AS taken FROM (SELECT DISTINCT conv_id FROM coded)),
parts AS (SELECT c.conv_id, 0 AS part, b.place, b.code FROM convs c JOIN coded b ON b.conv_id = c.conv_id - c.conv_id % 100 AND b.place <= c.taken
    UNION ALL SELECT c.conv_id, 1, o.place, o.code FROM convs c JOIN coded o ON o.conv_id = c.conv_id AND o.place > c.taken),
whole AS (SELECT c.conv_id, coalesce(list(p.code ORDER BY p.part, p.place) FILTER (p.code IS NOT NULL), []) AS codes FROM convs c LEFT JOIN parts p USING (conv_id) GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, d, codes[1:d] AS node, len(codes) = d AS ends FROM whole, unnest(range(0, len(codes) + 1)) AS r(d)),
nodes AS (SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY node),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, (n.n_convs - 1) * coalesce(l.chars, 0) AS saved FROM nodes n LEFT JOIN children c USING (node) LEFT JOIN lengths l ON l.code = n.node[n.depth]),
sums AS (SELECT node[1:k] AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM own, unnest(range(0, depth + 1)) AS r(k) GROUP BY 1)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN sums s USING (node) LEFT JOIN nodes p ON o.depth > 0 AND p.node = o.node[1:o.depth - 1]
"""
