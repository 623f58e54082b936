"""Prefix trie of conversations: balanced parentheses in every shard, shared spines merged.

A conversation is the path of its turns; equal beginnings are one node. A path is written as the chain of 16-byte digests of its
prefixes, so that the byte order of paths puts equal beginnings side by side, and texts stay where they are read. Paths are shuffled
once by range of (path, conv_id): a partition, cut into shards of bounded size, holds a contiguous piece of the trie. In a shard the
trie is a sequence of parentheses. Blocks of 64 of them keep their least excess, and a tree over the blocks the least of its range;
`findclose` looks for the first lower excess in the own block, climbs to a block that has it and looks there, for all nodes at once.
A subtree is then a range of the sequence: leaves are the "()" pairs in it by rank, and members, savings and least conv_id come from
cumulative arrays over it.

Only what lies on a shard's first or last path, its spines, can go on in another shard. The shards give such nodes in parts: members,
leaves and savings that hang from them inside. The parts are merged by prefix; each merged node gives its own share on one of the spines
that it lies on, sums from below along each spine are added per node, and the totals are whole. That is two groupings and a window
over one spine at a time, whatever the number of shards. So one hot beginning, or one conversation that a third of all have, is split over
as many shards as it fills. The list of a node's own members is hashed in ascending order as it streams by; for a spine in pieces of a
shard each.

Defined results: turns of one conversation go by turn (null first), then role, then the digest of role and text; a null role or text is
an empty one; repeated rows are turns of their own; rows without conv_id belong to no conversation; a conversation that has no turn left
is a member of the root alone; no conversations give no node, not even a root; other columns are ignored. A conversation's digests (about
20 bytes a turn) pass through a task as one row; prefixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import WORD_GAP, spread_join, written

DIGEST = 16
ROOT = bytes(DIGEST)
#: Turns of paths in one shard, before shared ones are counted once.
SHARD_TURNS = 1 << 18
BLOCK = 64
#: Most rows of a table that is broadcast (some 60 bytes each).
FEW = 200_000

NODE = "kind int, shard long, spine int, node binary, parent binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, ends binary"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (place of the turn, from 0), item (digest of role and text) and words of every turn."""
    role, text = (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("role", "text"))
    item = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.size(F.array_remove(F.split(text, WORD_GAP), "")).cast("int")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), item.alias("item"), words.alias("words"))
    by = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "item")
    return rows.select("conv_id", (F.row_number().over(by) - 1).cast("long").alias("pos"), F.unhex("item").alias("item"), "words")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """turns (a written table) with each conversation's beginning taken from the first one of its group of ids.

    The first h = crc32(conv_id) mod `most` turns are those of conversation conv_id - conv_id mod `group`; a row of pos -1 without item
    stands for every conversation, so that none without turns is lost. Only the first turns of a group's head meet its members.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    convs = turns.where("pos = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("head"), h)
    heads = turns.where(F.col("pos") < most - 1).select(F.col("conv_id").alias("head"), "pos", "item", "words")
    lent = convs.where("h > 0").join(heads, "head").where("pos < h").select("conv_id", "pos", "item", "words")
    own = turns.withColumn("h", h).where("pos >= h").select("conv_id", "pos", "item", "words")
    return own.unionByName(lent).unionByName(convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("item"), F.lit(0).alias("words")))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (conv_id, pos) as conv_id, path (digests of all its prefixes) and words, one row a conversation."""
    names = ["conv_id", "path", "words"]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([bytes(r[1]) for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names)
    now, done = None, []
    for batch in batches:
        for conv, _, item, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now[0]:
                if now:
                    done.append(now)
                if len(done) >= 1000:
                    yield pack(done)
                    done = []
                now, last = (conv, bytearray(), []), ROOT
            if item is not None:
                last = hashlib.blake2b(last + item, digest_size=DIGEST).digest()
                now[1].extend(last)
                now[2].append(words)
    if now:
        done.append(now)
    if done:
        yield pack(done)


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with the least excess of blocks and of ranges of blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = max(1, -(-len(bits) // BLOCK))
        self.padded = np.full(blocks * BLOCK, -1)
        self.padded[: len(bits)] = self.excess
        width = 1 << (blocks - 1).bit_length()
        self.tree = np.full(2 * width, np.iinfo("int64").max)
        self.tree[width : width + blocks] = self.padded.reshape(-1, BLOCK).min(axis=1)
        for k in range(width.bit_length() - 1, 0, -1):
            a, b = 1 << (k - 1), 1 << k
            self.tree[a:b] = np.minimum(self.tree[2 * a : 2 * b : 2], self.tree[2 * a + 1 : 2 * b : 2])
        self.width = width
        self.leaf_rank = np.concatenate([[0], np.cumsum(bits[:-1] & ~bits[1:]), [0]]) if len(bits) else np.zeros(1, int)
        if len(bits):
            self.leaf_rank[-1] = self.leaf_rank[-2]

    def _first_below(self, block: np.ndarray, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place at or after start in the block whose excess is at most target, else -1."""
        rows = self.padded[(block * BLOCK)[:, None] + np.arange(BLOCK)]
        good = (rows <= target[:, None]) & (np.arange(BLOCK) >= start[:, None])
        return np.where(good.any(axis=1), block * BLOCK + good.argmax(axis=1), -1)

    def findclose(self, opens: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
        """The place of the parenthesis that closes each of opens."""
        return np.concatenate([self._close(opens[i : i + chunk]) for i in range(0, len(opens), chunk)]) if len(opens) else opens

    def _close(self, opens: np.ndarray) -> np.ndarray:
        target = self.excess[opens] - 1
        found = self._first_below(opens // BLOCK, opens % BLOCK + 1, target)
        left = np.flatnonzero(found < 0)
        at = opens[left] // BLOCK + self.width
        # Climb while no range to the right holds the excess, then go down to the first block that does.
        up = np.ones(len(left), bool)
        while up.any():
            right = up & (at % 2 == 0) & (self.tree[np.minimum(at + 1, 2 * self.width - 1)] <= target[left])
            at = np.where(right, at + 1, np.where(up, at // 2, at))
            up &= ~right
        while (inner := at < self.width).any():
            at = np.where(inner, np.where(self.tree[np.minimum(2 * at, 2 * self.width - 1)] <= target[left], 2 * at, 2 * at + 1), at)
        found[left] = self._first_below(at - self.width, np.zeros(len(left), int), target[left])
        return found

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """The "()" pairs between opens and closes, by rank."""
        return self.leaf_rank[closes] - self.leaf_rank[opens]


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair, by a doubling table."""
    table = [values]
    while (step := 1 << (len(table) - 1)) * 2 <= len(values):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    level = np.frexp((last - first + 1).astype("float64"))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(table[k][first[own]], table[k][last[own] - (1 << int(k)) + 1])
    return out


def shard_rows(shard: int, convs: list[int], paths: list[bytes], words: list[list[int]]) -> pa.RecordBatch:
    """The nodes of a shard (its rows in order of path and conv_id): kind 0 whole, kind 1 in part, on the shard's first or last path."""
    bits: list[int] = [1]
    keys, depth, parent, load, ended = [ROOT], [0], [-1], [0], []
    stack, before = [0], b""
    for path, w in zip(paths, words, strict=True):
        same = 0
        top = min(len(path), len(before))
        if path[:top] == before[:top]:
            same = top // DIGEST
        else:
            while path[same * DIGEST : (same + 1) * DIGEST] == before[same * DIGEST : (same + 1) * DIGEST]:
                same += 1
        bits += [0] * (len(stack) - 1 - same)
        del stack[same + 1 :]
        for d in range(same, len(path) // DIGEST):
            bits.append(1)
            parent.append(stack[-1])
            stack.append(len(keys))
            keys.append(path[d * DIGEST : (d + 1) * DIGEST])
            depth.append(d + 1)
            load.append(w[d])
        ended.append(stack[-1])
        before = path
    last_spine = list(stack)
    bits += [0] * len(stack)
    par = Parentheses(np.array(bits, bool))
    opens = np.flatnonzero(par.bits)
    closes = par.findclose(opens)
    n = len(keys)
    me, up, load = np.arange(n), np.array(parent), np.array(load, "int64")
    after = me + (closes - opens + 1) // 2  # one past the last node of the subtree
    spine = np.full(n, -1)
    spine[: len(paths[0]) // DIGEST + 1] = 0  # the first path's nodes come first
    spine[last_spine] = 1
    shared = spine >= 0
    # A conversation's place in the shard is its rank by the node that it ends at, as paths come in preorder.
    ended_at, ids = np.array(ended), np.array(convs, "int64")
    begin, end = np.searchsorted(ended_at, me), np.searchsorted(ended_at, after)
    members = end - begin
    least = _range_least(ids, begin, end - 1)
    gain = np.concatenate([[0], np.cumsum(np.where(shared, 0, (members - 1) * load))])
    saved = gain[after] - gain[me]
    alone = np.concatenate([[0], np.cumsum(shared & (closes == opens + 1))])
    leaves = par.leaves(opens, closes) - (alone[after] - alone[me])  # a pair on a spine may go on elsewhere
    children = np.bincount(up[1:][~shared[1:]], minlength=n) if n > 1 else np.zeros(n, int)
    # What hangs from a spine's node is its own total less that of the spines' nodes below it.
    below = {name: np.bincount(up[1:][shared[1:]], x[1:][shared[1:]], n).astype("int64") if n > 1 else np.zeros(n, "int64") for name, x in (("saved", saved), ("leaves", leaves))}
    saved, leaves = np.where(shared, saved - below["saved"], saved), np.where(shared, leaves - below["leaves"], leaves)
    own_end = np.searchsorted(ended_at, me, "right")
    texts = [",".join(map(str, ids[a:b].tolist())).encode() for a, b in zip(begin, own_end, strict=True)]
    under_spine = (up >= 0) & ~shared & shared[up]
    whole = ~shared
    columns = {
        "kind": pa.array(shared.astype("int32")),
        "shard": pa.array(np.full(n, shard)),
        "spine": pa.array(spine.astype("int32")),
        "node": pa.array([k if s else None for k, s in zip(keys, shared, strict=True)], pa.binary()),
        "parent": pa.array([keys[u] if u >= 0 and (s or x) else None for u, s, x in zip(parent, shared, under_spine, strict=True)], pa.binary()),
        "parent_conv_id": pa.array(least[up], mask=shared | under_spine | (up < 0)),
        "conv_id": pa.array(least),
        "depth": pa.array(np.array(depth, "int64")),
        "n_convs": pa.array(members.astype("int64")),
        "n_children": pa.array(children.astype("int64")),
        "n_leaves": pa.array(leaves.astype("int64")),
        "saved_tokens": pa.array(saved.astype("int64")),
        "words": pa.array(load),
        "ends_sha256": pa.array([hashlib.sha256(t).hexdigest() if w else None for t, w in zip(texts, whole, strict=True)], pa.string()),
        "ends": pa.array([None if w else t for t, w in zip(texts, whole, strict=True)], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _shards(most: int):
    """A partition's rows as shards of at most about `most` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, size = TaskContext.get().partitionId(), 0, 0
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for conv, path, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x, y in zip(held, (conv, path, words), strict=True):
                    x.append(y)
                size += 1 + len(words)
                if size >= most:
                    yield shard_rows(part << 32 | k, *held)
                    k, size, held = k + 1, 0, ([], [], [])
        if held[0]:
            yield shard_rows(part << 32 | k, *held)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, shard, spine, ends) in that order as node and ends_sha256: pieces of a node's members are hashed as they come."""
    now, hashed, some, done = None, hashlib.sha256(), False, []
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])
    for batch in batches:
        for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    done.append((now, hashed.hexdigest()))
                if len(done) >= 10_000:
                    yield pack(done)
                    done = []
                now, hashed, some = node, hashlib.sha256(), False
            if ends:
                hashed.update((b"," if some else b"") + ends)
                some = True
    if now is not None:
        done.append((now, hashed.hexdigest()))
    if done:
        yield pack(done)


def _merged(parts: DataFrame) -> DataFrame:
    """Whole rows of the nodes on spines, from their parts (a written table).

    Leaves and savings of a node's subtree: each node's share counts on the least of its spines; sums from below along every spine,
    added up per node, meet each node below exactly once, as the spine that counts it leads through all nodes above it.
    """
    line = F.struct("shard", "spine")
    nodes = parts.groupBy("node").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("hung"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"), F.min(line).alias("line"))
    nodes = written(nodes, "spines")
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    counted = nodes.join(below, "node", "left").withColumn("n_children", F.col("hung") + F.coalesce("more", F.lit(0)))
    share = counted.select("node", "line", "parent", "conv_id", "depth", "n_convs", "n_children", (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    share = written(share, "shares")
    # A node stands once in a shard; where both spines hold it, it lies on the last, and the first goes on from it.
    at = parts.select("node", "shard", "spine", "depth").where("spine = 1").unionByName(_first_paths(parts))
    laid = spread_join(at, share.select("node", "line", "leaves", "saved"), "node", "shard")
    mine = laid.withColumns({k: F.when(F.struct("shard", "spine") == F.col("line"), F.col(k)).otherwise(F.lit(0)) for k in ("leaves", "saved")})
    up = Window.partitionBy("shard", "spine").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = mine.select("node", F.sum("leaves").over(up).alias("n_leaves"), F.sum("saved").over(up).alias("saved_tokens")).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    named = share.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parts_of = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = parts.select("node", "ends", "shard").repartition(parts_of, "node").sortWithinPartitions("node", "shard").select("node", "ends").mapInArrow(_digests, "node binary, ends_sha256 string")
    return share.drop("leaves", "saved", "line").join(sums, "node").join(named, "parent", "left").join(ends, "node")


def _first_paths(parts: DataFrame) -> DataFrame:
    """The nodes of the shards' first paths: those of spine 0, and the nodes above them that the last path holds too."""
    reach = parts.where("spine = 0").groupBy("shard").agg(F.min("depth").alias("least"))
    both = parts.where("spine = 1").join(reach, "shard").where("depth < least").select("node", "shard", F.lit(0).alias("spine"), "depth")
    return parts.where("spine = 0").select("node", "shard", "spine", "depth").unionByName(both)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, pos, item, words; a row of null item for every conversation): see COLUMNS."""
    spark = sequences.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = sequences.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "pos", "item", "words").mapInArrow(_paths, "conv_id long, path binary, words array<int>")
    laid = written(paths, "paths").repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = written(laid.mapInArrow(_shards(shard_turns), NODE), "nodes")
    spines = written(nodes.where("kind = 1").select("shard", "spine", "node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "ends"), "parts")
    merged = written(_merged(spines), "merged")
    named = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_spine"))
    hung = nodes.where("kind = 0 AND parent IS NOT NULL")
    found = hung.join(F.broadcast(named), "parent") if merged.count() <= FEW else spread_join(hung, named, "parent", "conv_id")
    whole = nodes.where("kind = 0 AND parent IS NULL").select(*COLUMNS)
    return whole.unionByName(found.withColumn("parent_conv_id", F.col("of_spine")).select(*COLUMNS)).unionByName(merged.select(*COLUMNS))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The prefix trie of the rebuilt conversations (conv_id, turn, role, text), one row a node."""
    return trie_of(rebuilt(written(turns_of(conversations), "turns")), shard_turns)
