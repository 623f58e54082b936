"""MinHash near-duplicates by a forest of sorted signature orders.

1. A document becomes the set of its distinct word shingles (64-bit hashes) and a signature of `hashes` minima. Documents of equal
   sets form a class with the least doc_id as representative; only representatives go on.
2. Forest: each tree orders the representatives by its own sequence of signature values. Orders are range-partitioned with the id
   as the last key, so a crowd of equal sequences is spread like any other. A representative alone in its prefix of `base` values is
   dropped from that tree.
3. In an order, the rows next to a document are those with the longest common prefix. The walk goes outward while the common prefix
   has `base` values or more, over `window` rows each way: where a region is crowded, that many rows share ever longer prefixes, so
   the depth adapts to the region. In regions of over 2 * window rows every row also meets the region's centres, the rows nearest to
   the values that most rows of the region share, chosen once per region over all tasks. Pairs whose signatures agree too seldom for the threshold are dropped.
4. Confirmation on full sets: first a spanning forest of each task's pairs, strongest first; then every candidate pair whose ends
   are not connected yet. Links between documents that are connected already change nothing and are not confirmed again.
5. Components of the confirmed links, by star contraction.
6. Exact rest: all rows of the regions that still hold different components go through a prefix-filter join on the rarest shingles
   of their full sets, whatever the window, the centres, the signatures and the edges of tasks left out. The prefix of the smaller
   set holds no boilerplate as long as strangers stay below the threshold. Its pairs are confirmed like the others.

So every pair that shares a region in any tree is decided. Steps 2 to 4 make documents * trees * window pairs, and leave few
components to step 6. `base` follows from the threshold so that a pair at the threshold shares no region with a chance of about one
in 10**5.

Defined results: a null or empty text has no shingles, is linked with nothing and is kept; a text of fewer words than a shingle is one
shingle; long texts are read whole; ties go to the least doc_id; rows without a
doc_id have no component and are kept; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import free_name, lean, spread_join, written
from freshet.llm.components import components, joined

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)]
_BATCH = 1 << 19
_SLOT_BITS = 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, np.uint64(base), np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _ODD[0]
        x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


_POWERS: list = []


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its shingles; A-Z count as a-z."""
    joined = b" " + b" ".join(texts).lower() + b" "
    buf = np.frombuffer(joined, np.uint8)
    if not _POWERS or len(_POWERS[0]) <= len(buf):
        _POWERS[:] = _powers(max(len(buf) + 1, _BATCH * 2))
    up, down = _POWERS
    space = _SPACE[buf]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
        word = _mix((total[end] - total[first]) * down[first])
        sizes = np.array([len(t) for t in texts], np.int64)
        edge = np.cumsum(sizes + 1) + 1
        upto = np.searchsorted(first, edge)
        from_ = np.concatenate([[0], upto[:-1]])
        m = max(0, len(word) - words + 1)
        gram = np.zeros(m, np.uint64)
        for j in range(words):
            gram = (gram ^ word[j : j + m]) * _ODD[2 + j % 6] + np.uint64(j + 1)
        gram = _mix(gram)
    out = []
    for a, b in zip(from_.tolist(), upto.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    x = (x ^ w) * _ODD[7] + np.uint64(b - a)
            out.append(_mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def multipliers(hashes: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, hashes).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, a row per set; no set may be empty."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), len(factors)), np.uint64)
    with np.errstate(over="ignore"):
        for k, a in enumerate(factors):
            out[:, k] = np.minimum.reduceat(flat * a, at)
    return (_mix(out) >> np.uint64(48)).astype(np.uint16)


def _chunks(ids: list[int], texts: Iterator) -> Iterator[tuple[list[int], list[bytes]]]:
    held, raw, total = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        raw.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
        held.append(i)
        total += len(raw[-1])
        if total > _BATCH:
            yield held, raw
            held, raw, total = [], [], 0
    if held:
        yield held, raw


def signed(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest (s1, s2) and its signature."""
    import xxhash

    names = ["doc_id", "n_shingles", "s1", "s2", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(hashes)
        for batch in batches:
            for ids, raw in _chunks(batch.column(0).to_pylist(), batch.column(1)):
                sets = shingles(raw, words)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full, factors)) if full else iter(())
                digest = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()), pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def sequences(hashes: int, trees: int, depth: int) -> list[list[int]]:
    """Signature places that each tree compares, in order; the first values of different trees differ."""
    order = np.random.default_rng(9).permutation(hashes)
    step = max(1, hashes // trees)
    return [np.roll(order, -t * step)[:depth].tolist() for t in range(trees)]


def base_depth(threshold: float, trees: int, miss: float = 2e-5) -> int:
    """The deepest prefix at which a pair at the threshold is missed by all trees with no more than that chance."""
    return max(1, max((d for d in range(1, 9) if (1 - threshold**d) ** trees <= miss), default=1))


class _Joined:
    """Disjoint sets of a task's rows."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


def neighbours(tree: np.ndarray, seq: np.ndarray, ids: np.ndarray, sig: np.ndarray, base: int, window: int, least: float) -> list[tuple[float, int, int]]:
    """Candidate pairs (agreement, a, b) of rows in sorted order."""
    found: dict[tuple[int, int], float] = {}

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), 8192):
            x, y = i[at : at + 8192], j[at : at + 8192]
            score = (sig[x] == sig[y]).mean(axis=1)
            good = (score >= least) & (ids[x] != ids[y])
            for s, a, b in zip(score[good].tolist(), ids[x[good]].tolist(), ids[y[good]].tolist(), strict=True):
                found[min(a, b), max(a, b)] = s

    n = len(ids)
    for o in range(1, min(window, n - 1) + 1):
        near = (tree[:-o] == tree[o:]) & (seq[:-o, :base] == seq[o:, :base]).all(axis=1)
        i = np.flatnonzero(near)
        if not len(i):
            break
        meet(i, i + o)
    return sorted(((s, a, b) for (a, b), s in found.items()), reverse=True)


def least_agreement(threshold: float, hashes: int) -> float:
    """Share of equal signature values under which a pair is not taken to reach the threshold."""
    return threshold - 3.5 * math.sqrt(threshold * (1 - threshold) / hashes)


def regions(reps: DataFrame, threshold: float, hashes: int, trees: int, depth: int) -> DataFrame:
    """tree, prefix, rep and the region's number of rows n, of every representative that is not alone in its prefix."""
    base = base_depth(threshold, trees)
    prefix = [F.concat(*[F.substring("sig", 2 * k + 1, 2) for k in order[:base]]) for order in sequences(hashes, trees, depth)]
    rows = reps.select("rep", F.posexplode(F.array(*[F.xxhash64(p) for p in prefix])).alias("tree", "prefix"))
    crowd = rows.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(crowd, ["tree", "prefix"])


def stars(reps: DataFrame, members: DataFrame, threshold: float, hashes: int, window: int, centres: int = 8, drawn: int = 128, salts: int = 16) -> DataFrame:
    """u, best and partners: the centres of its crowded regions that a representative agrees with, the best one apart.

    The centres are chosen once per region, among all of its rows: those nearest to the values that most rows share (the middle of
    about `drawn` rows that a hash draws). They meet every row of the region on a salted key.
    """
    least = least_agreement(threshold, hashes)
    big = written(members.where(F.col("n") > 2 * window).join(reps.select("rep", "sig"), "rep").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")), "crowded")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")

    def middle(key: tuple, table: pa.Table) -> pa.Table:
        part = np.sort(np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, hashes), axis=0)
        usual = part[len(part) // 2].tobytes()  # what more than half of the rows share is the middle value
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "prefix": pa.array([key[1].as_py()], pa.int64()), "usual": pa.array([usual], pa.binary())})

    def agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, hashes) for i in (3, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((x == y).sum(axis=1), pa.int64())], ["tree", "prefix", "rep", "agree"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for u, sig, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                others = [c for c in found if c["rep"] != u]
                score = (np.frombuffer(b"".join(c["sig"] for c in others), np.uint16).reshape(len(others), hashes) == np.frombuffer(sig, np.uint16)).mean(axis=1)
                good = [i for i in np.argsort(-score, kind="stable").tolist() if score[i] >= least]
                if good:
                    for column, value in zip(out, (u, others[good[0]]["rep"], float(score[good[0]]), [others[i]["rep"] for i in good]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], lists)], ["u", "best", "score", "partners"])

    from pyspark.sql import Window

    some = big.where(F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n")) < drawn).select("tree", "prefix", "sig")  # about `drawn` rows a region
    usual = some.groupBy("tree", "prefix").applyInArrow(middle, "tree int, prefix long, usual binary")
    agree = big.join(usual.select("*", every), ["tree", "prefix", "salt"]).select("tree", "prefix", "rep", "sig", "usual").mapInArrow(lean(agreement), "tree int, prefix long, rep long, agree long")
    place = F.row_number().over(Window.partitionBy("tree", "prefix").orderBy(F.desc("agree"), "rep"))
    top = agree.withColumn("place", place).where(F.col("place") <= centres).join(reps.select("rep", "sig"), "rep")
    chosen = written(top.groupBy("tree", "prefix").agg(F.collect_list(F.struct("rep", "sig")).alias("found")), "centres")
    met = big.join(chosen.select("*", every), ["tree", "prefix", "salt"]).select("rep", "sig", "found").mapInArrow(lean(meet), "u long, best long, score double, partners array<long>")
    return met.groupBy("u").agg(F.max_by("best", F.struct("score", -F.col("best"))).alias("best"), F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))  # trees * centres partners at most


def candidates(reps: DataFrame, members: DataFrame, threshold: float, hashes: int, trees: int, depth: int, window: int) -> DataFrame:
    """crowd (rows that one task saw connected), u, all its partners there, and those of its links in the task's spanning forest."""
    base = base_depth(threshold, trees)
    orders = sequences(hashes, trees, depth)
    least = least_agreement(threshold, hashes)
    where = members.groupBy("rep").agg(F.collect_list("tree").alias("trees"))  # trees entries at most
    full = F.array(*[F.concat(*[F.substring("sig", 2 * k + 1, 2) for k in order]) for order in orders])
    spread = reps.join(where, "rep").select("rep", "sig", F.explode("trees").alias("tree"), full.alias("all")).select("rep", "sig", "tree", F.get("all", F.col("tree")).alias("seq"))
    parts = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = spread.repartitionByRange(parts, "tree", "seq", "rep").sortWithinPartitions("tree", "seq", "rep").select("tree", "seq", "rep", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        first = TaskContext.get().partitionId() << 40

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal first
            tree, ids = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
            seq = np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(len(rows), depth)
            sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), hashes)
            sets, partners, forest = _Joined(), defaultdict(list), defaultdict(list)
            for _, a, b in neighbours(tree, seq, ids, sig, base, window, least):
                partners[a].append(b)
                partners[b].append(a)
                if sets.join(a, b):
                    forest[a].append(b)
            number: dict[int, int] = {}
            crowd = [first + number.setdefault(sets.root(u), len(number)) for u in partners]
            first += len(number)
            lists = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(crowd, pa.int64()), pa.array(list(partners), pa.int64()), pa.array(list(partners.values()), lists), pa.array([forest.get(u, []) for u in partners], lists)], ["crowd", "u", "partners", "forest"])

        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= 8_000:
                yield solve(held)
                held = held[-window:]
        if held:
            yield solve(held)

    return ordered.mapInArrow(lean(run), "crowd long, u long, partners array<long>, forest array<long>")


def unconnected(found: DataFrame, label: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) whose ends have different labels.

    Of a crowd (what one task saw connected) most documents carry one label. A pair of different labels has an end that does not carry
    it, and every document lists all its partners, so only the lists of those others are opened.
    """
    end = lambda name: label.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
    known = spread_join(found.select("crowd", "u", "partners"), end("u"), "u", "crowd", "left").withColumn("lu", F.coalesce("lu", "u"))
    usual = known.groupBy("crowd", "lu").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max_by("lu", F.struct("n", "lu")).alias("most"))
    apart = written(known.join(usual, "crowd").where("lu <> most").select("u", "lu", F.explode("partners").alias("v")), "opened")
    far = spread_join(apart, end("v"), "v", "u", "left").where("lu <> coalesce(lv, v)")
    return far.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (u, v) whose ends have different labels, once each."""
    end = lambda name: label.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
    of, total = {c: pairs.groupBy(c).agg(F.count("*").alias("n")) for c in ("u", "v")}, pairs.count()
    known = spread_join(pairs, end("u"), "u", "v", "left", of["u"], total)
    far = spread_join(known, end("v"), "v", "u", "left", of["v"], total).where("coalesce(lu, u) <> coalesce(lv, v)")
    return far.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold: percent * intersection against union, in whole numbers.

    Sets are arrays that the joins and Spark's own functions work on a row at a time, so memory holds two sets a task, however long
    they are and however many partners one of them has.
    """
    percent = round(threshold * 100)
    pairs = written(pairs.select("u", "v"), "pairs")
    of, total = {c: pairs.groupBy(c).agg(F.count("*").alias("n")) for c in ("u", "v")}, pairs.count()
    left = spread_join(pairs, sets.select(F.col("rep").alias("v"), F.col("set").alias("y")), "v", "u", counts=of["v"], total=total)
    both = spread_join(left, sets.select(F.col("rep").alias("u"), F.col("set").alias("x")), "u", "v", counts=of["u"], total=total)
    x, y = F.size("x"), F.size("y")
    near = both.where(100 * F.least(x, y) >= percent * F.greatest(x, y))
    return near.select("u", "v", (x + y).alias("sum"), F.size(F.array_intersect("x", "y")).alias("shared")).where(100 * F.col("shared") >= percent * (F.col("sum") - F.col("shared"))).select("u", "v")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, bits: int = 26) -> DataFrame:
    """rep and its whole shingle set, for the representatives wanted and, by chance, a few others.

    The texts stay where they are read: a bit map of 2**bits places (8 MB, whatever the input) says which ids are wanted. Ids that
    share a place only cost their sets; with more ids than places all sets are made, which is slower and as right.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << bits)) + 1  # the bit map functions count from 1
    maps = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()  # a fixed number of maps
    flags = np.zeros((1 << bits) // 8, np.uint8)
    for row in maps:
        at = (row["k"] - 1) * len(row["m"])
        flags[at : at + len(row["m"])] = np.frombuffer(bytes(row["m"]), np.uint8)
    sent = spark.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = sent.value
        for batch in batches:
            p = batch.column(2).to_numpy() - 1
            keep = batch.filter(pa.array((flags[p >> 3] >> (p & 7)) & 1 == 1))
            for ids, raw in _chunks(keep.column(0).to_pylist(), keep.column(1)):
                sets = shingles(raw, words)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["rep", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep IS NOT NULL")
    return rows.select("rep", "text", place.alias("p")).mapInArrow(lean(run), "rep long, set array<long>")


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def token_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold the shingles of each of 2**_SLOT_BITS slots: a table of fixed size, whatever the input."""
    size = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _SLOT_BITS, np.int64)
        for batch in batches:
            np.add.at(total, _slots(batch.column(0).flatten().to_numpy().view(np.uint64)), 1)
        parts = [(k, c) for k, c in enumerate(total.reshape(-1, size)) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([c.tobytes() for _, c in parts], pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((1 << _SLOT_BITS) // size * size, np.int64)
    for row in sets.select("set").mapInArrow(lean(count), "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():  # a fixed number of parts
        out[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(bytes(row["counts"]), np.int64)
    return out


def prefixes(tokens: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set that a link must share: those of the larger set's prefix, and how many the smaller set's has.

    A link of sets x <= y shares at least 2 * percent / (100 + percent) of x and percent of y, so in any one order of all
    shingles the first ones of both, up to these numbers, meet.
    """
    n = len(tokens)
    order = np.lexsort((tokens, counts[_slots(tokens)]))
    small, large = n + (-2 * percent * n // (100 + percent)) + 1, n + (-percent * n // 100) + 1
    return tokens[order[:large]], small


def unmet(sets: DataFrame, percent: int, salts: int = 16, words: int = 16) -> DataFrame:
    """Every pair (u, v) of different labels that can reach the threshold, from sets (rep, label, set), by a prefix-filter join.

    Of a shingle's list, one end of such a pair does not carry the list's most frequent label; only those meet the list, which is
    split by a salt. The order of the shingles (by count of their slot) bears on the cost only.

    Two bounds drop pairs in the join, both exact. Sets whose first common shingle stands at places i and j share at most what is left
    from there. And where the sets' bit maps (of 64 * words bits) differ, an element of one set only must stand, so the number of
    differing bits bounds the overlap from above; strangers of the same boilerplate end there.
    """
    sent = sets.sparkSession.sparkContext.broadcast(token_counts(sets))
    names = ["token", "rep", "label", "size", "small", "at"]
    maps = [f"b{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, label, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = held.values.to_numpy().view(np.uint64)
                if not len(tokens):
                    continue
                found, small = prefixes(tokens, sent.value, percent)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(n, rep)), pa.array(np.full(n, label)), pa.array(np.full(n, len(tokens))), pa.array(np.arange(n) < small), pa.array(np.arange(n))], names)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, 64 * words), np.uint8)
            for i, held in enumerate(batch.column(1)):
                bits[i, (held.values.to_numpy().view(np.uint64) % np.uint64(64 * words)).astype(np.int64)] = 1
            found = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(words))], ["rep", *maps])

    lists = written(sets.select("rep", "label", "set").mapInArrow(lean(run), "token long, rep long, label long, size long, small boolean, at long"), "prefixes")
    usual = lists.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    bits = sets.select("rep", "set").mapInArrow(lean(mapped), "rep long, " + ", ".join(f"{m} long" for m in maps))
    lists = written(lists.join(usual, "token").join(bits, "rep"), "mixed")  # the shingles of one label only bring no pair
    other = lists.where("label <> most").select("token", *[F.col(c).alias(f"o_{c}") for c in [*names[1:], *maps]], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = other.join(lists.drop("most").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")), ["token", "salt"])
    first = F.struct("o_size", "o_rep") < F.struct(F.col("size").alias("o_size"), F.col("rep").alias("o_rep"))
    both = F.col("size") + F.col("o_size")
    differing = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"o_b{k}"))) for k in range(1, words)), F.bit_count(F.col("b0").bitwiseXOR(F.col("o_b0"))))
    reach = lambda twice: (100 + percent) * twice >= 2 * percent * both  # noqa: E731  (twice the overlap at most)
    near = (F.col("label") != F.col("o_label")) & F.when(first, F.col("o_small")).otherwise(F.col("small")) & (100 * F.least("size", "o_size") >= percent * F.greatest("size", "o_size"))
    near = near & reach(2 * F.least(F.col("size") - F.col("at"), F.col("o_size") - F.col("o_at"))) & reach(both - differing)
    return met.where(near).select(F.least("rep", "o_rep").alias("u"), F.greatest("rep", "o_rep").alias("v")).distinct()


def undecided(members: DataFrame, label: DataFrame) -> DataFrame:
    """rep and label of every row of the regions that still hold different labels."""
    known = members.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select("tree", "prefix", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = known.groupBy("tree", "prefix").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("tree", "prefix")
    return known.join(mixed, ["tree", "prefix"]).select("rep", "label").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, hashes: int = 128, trees: int = 16, depth: int = 12, window: int = 12) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; doc_id is a key of docs."""
    marks = written(signed(docs, words, hashes), "signed")
    reps = written(marks.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "sig")).alias("x")).select("s1", "s2", F.col("x.doc_id").alias("rep"), F.col("x.sig").alias("sig")), "representatives")
    members = written(regions(reps.select("rep", "sig"), threshold, hashes, trees, depth), "regions")
    found = written(candidates(reps.select("rep", "sig"), members, threshold, hashes, trees, depth, window), "candidates")
    star = written(stars(reps, members, threshold, hashes, window), "stars")
    spokes = star.select("u", F.explode("partners").alias("v"))
    ends = found.select(F.col("u").alias("rep")).union(star.select("u")).union(star.select(F.explode("partners")))
    sets = written(full_sets(docs, ends, words), "sets")
    first = found.select("u", F.explode("forest").alias("v")).union(star.select("u", F.col("best").alias("v")))
    links = confirmed(first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), sets, threshold)
    label = written(components(links), "labels")
    more = written(confirmed(unconnected(found, label).union(apart(spokes, label)).distinct(), sets, threshold), "links")
    if not more.isEmpty():
        label = written(joined(label, more), "labels")
    open_ = written(undecided(members, label), "undecided")
    if not open_.isEmpty():
        rest = written(full_sets(docs, open_, words).join(open_, "rep"), "sets")
        more = written(confirmed(unmet(rest, round(threshold * 100)), rest, threshold), "links")
        if not more.isEmpty():
            label = joined(label, more)
    named = reps.select("s1", "s2", "rep").join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select("s1", "s2", F.coalesce("label", "rep").alias("class"))
    out = marks.drop("sig").join(named, ["s1", "s2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each group, that of the least doc_id; all columns stay, and so do rows without a doc_id and empty texts.

    Where doc_ids repeat, rows are told apart by doc_id and text, so that one text goes and another of the same doc_id stays; of equal
    rows one stays.
    """
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = near_duplicates(docs, words, threshold).where("NOT kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti")
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text", F.col("text").isNull()))
    name = free_name(docs, "row")
    rows = docs.withColumn(name, row)
    keys = written(rows.where("doc_id IS NOT NULL").select(F.col(name).alias("row"), "doc_id").groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "rows")
    groups = near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"), words, threshold).where("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("row"), "component_id").distinct()
    placed = written(groups.join(keys, "row"), "groups")
    best = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("b")).select(F.col("b.row").alias("row"))
    gone = placed.join(best, "row", "left_anti").select(F.col("row").alias(name))
    left = rows.join(gone, name, "left_anti")
    several = keys.where("n > 1").select(F.col("row").alias(name))
    once = left.join(several, name, "left_semi").dropDuplicates([name])
    return left.join(several, name, "left_anti").unionByName(once).drop(name)
