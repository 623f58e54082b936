"""Best-fit packing of tokenised documents into sequences, by a linear grouping scheme.

1. Every whole text is tokenised (byte-level BPE) in the scan; only longer documents are cut, the remainder first.
2. The histogram of piece lengths (at most `capacity` rows, whatever the input) goes to the driver. Large lengths form groups of
   equal cardinality and are rounded up to their group's largest; a cutting-stock linear program over these few sizes is solved by
   column generation, and its configurations are rounded down.
3. Slots are filled with actual lengths of the group, by runs of equal length; what is left over and the small pieces go best-fit
   into the least space that holds them. All of this works on run-length counts: a bin type stands for any number of bins.
4. Each piece takes its rank among the pieces of its length, spread over counters of about `share` pieces, and the rank falls into
   the run of one bin type, which gives sequence and offset.

Token ids: a text is cut at single blanks between non-blank characters. The tokenizer's splitting rule never lets a token cross
such a place, so the ids of the parts, which are kept per worker, put together are the ids of the whole text (tested). Vocabulary
and added tokens come from the tokenizers file; its merges are run by tiktoken, which needs less than half the time.

Defined results: a null or empty text is one piece of one token (the end mark); very long texts are cut, never shortened; repeated
rows are packed each on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import written

_CUT = re.compile(r"(?<=\S)(?= \S)")
_CACHE_ROWS = 250_000  # parts of texts kept per worker; about 40 MB


class _Parts(dict):
    """Part of a text -> its ids as little-endian 32-bit bytes; `added` finds the vocabulary's added tokens in a text."""

    def __init__(self, encode, added: dict[str, int]):
        self.encode = encode
        self.added = {k: np.array([i], "<u4").tobytes() for k, i in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(k) for k in sorted(added, key=len, reverse=True)) + ")") if added else None

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.encode(part), "<u4").tobytes()
        if len(self) < _CACHE_ROWS and len(part) < 40:
            self[part] = ids
        return ids


_PARTS: dict[str, _Parts] = {}


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _parts(vocabulary: str | None) -> _Parts:
    """The tokenizer of a byte-level vocabulary file (json), merged by a faster engine; ids in order of the merges are required."""
    key = vocabulary or ""
    if key not in _PARTS:
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            found = json.load(f)
        added = {t["content"]: t["id"] for t in found["added_tokens"]}
        if any(t[k] for t in found["added_tokens"] for k in ("lstrip", "rstrip", "single_word")) or found["normalizer"] or found["pre_tokenizer"]["type"] != "ByteLevel" or found["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without a normaliser or added blanks is needed")
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in found["model"]["vocab"].items() if piece not in added}
        coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _PARTS[key] = _Parts(coder.encode_ordinary, added)
    return _PARTS[key]


def token_bytes(text: str, parts: _Parts) -> bytes:
    """Ids of a text, as little-endian 32-bit integers; an added token's text is that token, wherever it stands."""
    if parts.cut and parts.cut.search(text):
        return b"".join([parts.added.get(x) or token_bytes(x, parts) for x in parts.cut.split(text) if x])
    split = text.split(" ")
    if all(split) and not any(x[0].isspace() or x[-1].isspace() for x in split):
        return parts[split[0]] + b"".join([parts[" " + x] for x in split[1:]])
    return b"".join([parts[x] for x in _CUT.split(text)])


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(vocabulary)
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = (token_bytes(t, parts) if (t := text.as_py()) else b"") + end
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    for column, x in zip(out, (doc_id, piece, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])), strict=True):
                        column.append(x)
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece long, start long, length long, ids_crc32 long").select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32")


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(bins, items of each size in such a bin): the cutting-stock LP by column generation, rounded down."""
    k = len(sizes)
    if not k:
        return []
    weights, need = np.array(sizes), np.array(demand, float)
    columns = [np.eye(k)[:, i] * (capacity // s) for i, s in enumerate(sizes)]
    basis = list(range(k))
    x = need / np.array([columns[i][i] for i in range(k)])
    for _ in range(60 * k):
        matrix = np.column_stack([columns[i] for i in basis])
        price = np.linalg.solve(matrix.T, np.ones(k))
        worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):  # unbounded knapsack, a layer per number of items of size s
            if price[i] <= 0:
                continue
            for low in range(s, capacity + 1, s):
                b = slice(low, min(low + s, capacity + 1))
                gain = worth[low - s : low - s + (b.stop - b.start)] + price[i]
                better = gain > worth[b] + 1e-12
                worth[b] = np.where(better, gain, worth[b])
                last[b] = np.where(better, i, last[b])
        room = int(np.argmax(worth))
        if worth[room] <= 1 + 1e-7:
            break
        new = np.zeros(k)
        while room > 0 and last[room] >= 0:
            new[last[room]] += 1
            room -= int(weights[last[room]])
        move = np.linalg.solve(matrix, new)
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        step = ratio[leave]
        x = np.maximum(x - step * move, 0)
        columns.append(new)
        basis[leave], x[leave] = len(columns) - 1, step
    return [(int(v + 1e-6), tuple(int(c) for c in columns[i])) for i, v in zip(basis, x, strict=True) if v >= 1 - 1e-6]


class _Bins:
    """Bin types with room left: room -> [(bins, lengths so far)]."""

    def __init__(self):
        self.at: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.closed: list[tuple[int, tuple[int, ...]]] = []

    def add(self, n: int, items: tuple[int, ...], room: int) -> None:
        if n and not room:
            self.closed.append((n, items))
        elif n:
            if room not in self.at or not self.at[room]:
                bisect.insort(self.rooms, room)
            self.at[room].append((n, items))

    def fit(self, size: int) -> tuple[int, int, tuple[int, ...]] | None:
        """Take the bins of one type with the least room of at least size."""
        i = bisect.bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        n, items = self.at[room].pop()
        if not self.at[room]:
            self.rooms.pop(i)
        return room, n, items


def plan(histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = (12, 24), large_from: tuple[float, ...] = (0.25, 1 / 3, 0.5)) -> list[tuple[int, tuple[int, ...]]]:
    """The bins of the best choice of groups and of the share of capacity from which a length counts as large.

    Rounding up costs room wherever configurations hold many items, so the choice matters; each takes well under a second.
    """
    return min((grouped(histogram, capacity, g, s) for g in groups for s in large_from), key=lambda bins: sum(n for n, _ in bins))


def grouped(histogram: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[int, tuple[int, ...]]]:
    """(number of bins, the lengths in each): every piece of the histogram once. Works on counts alone."""
    bins, left = _Bins(), {s: n for s, n in histogram.items() if n}
    if left.get(capacity):
        bins.add(left.pop(capacity), (capacity,), 0)
    large = sorted((s for s in left if s > small * capacity), reverse=True)
    total = sum(left[s] for s in large)
    members: list[list[int]] = []
    at = 0
    for s in large:  # equal cardinality, largest first; a length stays in one group
        g = min(groups - 1, at * groups // max(1, total))
        while len(members) <= g:
            members.append([])
        members[g].append(s)
        at += left[s]
    members = [m for m in members if m]
    found = configurations([m[0] for m in members], [sum(left[s] for s in m) for m in members], capacity)
    runs = [[[s, left[s]] for s in m] for m in members]  # what each group still has, largest first
    for n, counts in sorted(found, key=lambda f: -sum(c * members[g][0] for g, c in enumerate(f[1]))):
        slots = [g for g, c in enumerate(counts) for _ in range(c)]
        while n and slots and all(runs[g] for g in slots):
            need: dict[int, int] = defaultdict(int)
            for g in slots:
                need[g] += 1
            take = n
            for g, c in need.items():  # so many bins whose slots of a group all hold the group's largest length left
                take = min(take, runs[g][0][1] // c)
            items: list[int] = []
            if take:
                for g, c in need.items():
                    items += [runs[g][0][0]] * c
                    runs[g][0][1] -= take * c
            else:  # one bin across the end of a run
                take = 1
                if any(sum(r[1] for r in runs[g]) < c for g, c in need.items()):
                    break
                for g in slots:
                    while not runs[g][0][1]:
                        runs[g].pop(0)
                    items.append(runs[g][0][0])
                    runs[g][0][1] -= 1
            for g in need:
                while runs[g] and not runs[g][0][1]:
                    runs[g].pop(0)
            bins.add(take, tuple(sorted(items, reverse=True)), capacity - sum(items))
            n -= take
    rest = {s: n for r in runs for s, n in r}
    rest |= {s: n for s, n in left.items() if s <= small * capacity}
    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            if (got := bins.fit(s)) is None:
                each = capacity // s
                full, over = divmod(n, each)
                bins.add(full, (s,) * each, capacity - s * each)
                bins.add(1 if over else 0, (s,) * over, capacity - s * over)
                n = 0
                continue
            room, many, items = got
            each = room // s
            full = min(many, n // each)
            if full:
                bins.add(full, items + (s,) * each, room - s * each)
                bins.add(many - full, items, room)
                n -= full * each
            else:
                bins.add(1, items + (s,) * n, room - s * n)
                bins.add(many - 1, items, room)
                n = 0
    return bins.closed + [b for room in bins.rooms for b in bins.at[room]]


def _runs(bins: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length -> (first rank, first sequence, offset) of each run of ranks; the i-th rank of a run goes to the i-th bin of its type."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    first = 0
    for n, items in bins:
        offset = 0
        for s in items:
            found[s].append((rank[s], first, offset))
            rank[s] += n
            offset += s
        first += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for s, v in found.items()}


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, share: int = 100_000) -> DataFrame:
    """The pieces with sequence_id and offset.

    The plan holds at most a few runs per length, so what travels with the tasks is bounded by capacity and groups, not by the
    input. Ranks: a length of n pieces is dealt over 1 + n / share counters, so that no task ranks many more than `share` pieces of
    a length however common it is; a piece's rank is its counter's start plus its place within the counter. That makes at most
    capacity + pieces / share counters, the only figure here that grows: one for some 100,000 pieces.
    """
    cut = written(pieces(docs, capacity, end_id, vocabulary), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    salts = np.ones(capacity + 1, np.int64)
    for length, n in histogram.items():
        salts[length] += n // share
    many = {int(k): int(v) for k, v in enumerate(salts) if v > 1}
    of = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("length").cast("int")), F.lit(1)) if many else F.lit(1)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), of).cast("int"))
    base = np.cumsum(salts) - salts  # the first counter of each length
    first, seen = np.zeros(int(salts.sum()), np.int64), defaultdict(int)
    for length, salt, n in sorted((r["length"], r["salt"], r["n"]) for r in cut.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()):
        first[base[length] + salt] = seen[length]
        seen[length] += n
    runs = _runs(plan(histogram, capacity))
    sent = docs.sparkSession.sparkContext.broadcast((base, first, runs))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, first, runs = sent.value
        for batch in batches:
            length, salt, inner = (batch.column(i).to_numpy() for i in (3, 5, 6))
            rank = first[base[length] + salt] + inner - 1
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = order[a:b]
                ranks, sequences, offsets = runs[int(length[rows[0]])]
                i = np.searchsorted(ranks, rank[rows], side="right") - 1
                sequence[rows] = sequences[i] + rank[rows] - ranks[i]
                offset[rows] = offsets[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    from pyspark.sql import Window

    ranked = cut.withColumn("inner", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", F.col("inner").cast("long").alias("inner")).mapInArrow(place, schema)
