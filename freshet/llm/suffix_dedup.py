"""Removal of repeated passages, by run-length indices of a distributed corpus.

Every byte covered by a string of `length` bytes (200) that also starts anywhere else goes. No match is sampled or estimated.

1. Routing. Each window of `length` bytes is named by the least hash of its 32-byte grams (winnowing), so equal windows have equal
   names wherever they stand. Neighbouring windows of one name form a context; a corpus has about one context per 85 bytes. Names
   that occur once, in contexts that do not repeat themselves, hold no match and go no further.
2. Equal contexts of a name (equal by a hash of 128 bits) form a class: one of them stands for all, with their number as its weight.
   Copies only lengthen the runs of a Burrows-Wheeler transform, so a class enters an index once.
3. Index. Classes meet by name, in batches of whole names. Their suffix order gives the Burrows-Wheeler transform; only its runs are
   kept, with the text positions of both ends and the length of their matches with the suffixes outside of the run. Inside a run the
   match of the next text position is one shorter than the last, so matching statistics of all positions stream from the run ends
   alone. Windows whose statistic reaches `length` are marked; the marks of a class hold for each of its contexts.
4. A name whose classes hold more than `hot` bytes (a common line) would make its index one task. Its classes are salted into shares,
   which exchange lists of the fingerprints of their windows, so that no task receives such a group. Windows there are equal if two
   64-bit hashes folded into one agree within one 44-bit name. The README gives the share of removed bytes that goes this way.

Nothing is collected; a row's size is bounded by its document. Rows are told apart by doc_id and text, not by doc_id alone: rows of
one doc_id with different texts, and rows without one, are cut each by its own passages.

Defined results: a null text counts as empty; texts under `length` bytes stay; long texts are read whole; equal rows are copies of
each other and go; an empty table gives an empty one; other columns are ignored (`cleaned` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import free_name, lean, spread_join, written

GRAM = 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xD6E8FEB86659FD93 | 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PLACE = np.uint64((1 << 20) - 1)
_BATCH = 1 << 18  # bytes of text that are hashed together


def rolling(buf: np.ndarray, size: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Mixed polynomial hash of every run of size bytes (modulo 2**64), by doubling."""
    power, width = base, 1
    part = buf.astype(np.uint64) + np.uint64(1)
    done, have = None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                if done is None:
                    done, have, shift = part, width, power
                else:  # the lower bits come first: done covers [i, i + have), part goes on from there
                    m = len(buf) - have - width + 1
                    done = done[:m] * power + part[have : have + m]
                    have += width
            if width * 2 > size:
                break
            m = len(part) - width
            part = part[:m] * power + part[width:]
            power, width = power * power, width * 2
        done = done ^ (done >> np.uint64(31))
        done = done * _MIX
    return done ^ (done >> np.uint64(29))


def window_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of every run of size values."""
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def contexts(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie in buf: (text, first window, end of windows, name, repeats itself) of each context."""
    none = np.zeros(0, np.int64)
    wide = np.flatnonzero(sizes >= length)
    if not len(wide):
        return none, none, none, none, none.astype(bool)
    grams = rolling(buf, GRAM)
    place = np.arange(len(grams), dtype=np.uint64) & _PLACE
    least = window_least((grams & ~_PLACE) | place, length - GRAM + 1)
    first, end = starts[wide], starts[wide] + sizes[wide] - length + 1
    inside = np.zeros(len(least) + 1, np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    name = least >> np.uint64(20)
    change = np.ones(len(least), bool)
    change[1:] = name[1:] != name[:-1]
    moved = np.zeros(len(least) + 1, np.int64)
    moved[2:] = np.cumsum((least[1:] != least[:-1]) & ~change[1:])
    change[first] = True
    heads = np.flatnonzero(change & inside)
    text = wide[np.searchsorted(first, heads, side="right") - 1]
    stop = np.minimum(np.append(heads[1:], len(least)), starts[text] + sizes[text] - length + 1)
    own = moved[stop] - moved[np.minimum(heads + 1, stop)] > 0
    return text, heads - starts[text], stop - starts[text], name[heads].astype(np.int64), own


def _grouped_texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """Consecutive texts of a batch, about _BATCH bytes at a time: (batch, first row, texts)."""
    for batch in batches:
        texts, first, total = [], 0, 0
        for i, t in enumerate(batch.column(column).cast(pa.large_binary())):
            texts.append(t.as_py() or b"")
            total += len(texts[-1])
            if total >= _BATCH:
                yield batch, first, texts
                texts, first, total = [], i + 1, 0
        if texts:
            yield batch, first, texts


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts) + bytes(GRAM), np.uint8)
    return buf, np.cumsum(sizes) - sizes, sizes


def _contexts_of(length: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, texts in _grouped_texts(batches, 0):
            one, two = (batch.column(i).to_numpy() for i in (1, 2))
            long = [i for i, t in enumerate(texts) if len(t) >= length]
            pieces = []
            for i in long:  # a very long text is hashed by parts that share length - 1 bytes
                t = texts[i]
                pieces += [(i, a, t[a : a + _BATCH + length - 1]) for a in range(0, len(t) - length + 1, _BATCH)]
            at = 0
            while at < len(pieces):
                part, total = [], 0
                while at < len(pieces) and (not part or total + len(pieces[at][2]) < 2 * _BATCH):
                    part.append(pieces[at])
                    total += len(pieces[at][2])
                    at += 1
                buf, starts, sizes = _laid([p[2] for p in part])
                text, a, b, name, own = contexts(buf, starts, sizes, length)
                if not len(text):
                    continue
                raw = memoryview(buf)
                digest = xxhash.xxh3_128_digest
                lo, hi = (starts[text] + a).tolist(), (starts[text] + b + length - 1).tolist()
                content = np.frombuffer(b"".join([digest(raw[x:y]) for x, y in zip(lo, hi, strict=True)]), np.int64).reshape(-1, 2)
                base = np.array([p[1] for p in part])[text]
                doc = row + np.array([p[0] for p in part])[text]
                yield pa.RecordBatch.from_arrays([pa.array(one[doc]), pa.array(two[doc]), pa.array((base + a).astype(np.int32)), pa.array((base + b).astype(np.int32)), pa.array(name), pa.array(content[:, 0].copy()), pa.array(content[:, 1].copy()), pa.array(own)], ["k1", "k2", "a", "b", "name", "c1", "c2", "own"])

    return run


class RunIndex:
    """The run-length compressed Burrows-Wheeler transform of a few contexts, with samples at both ends of its runs.

    Of the suffix order only the runs stay: symbol, length (copies counted), and the text positions of the ends with the length of
    their matches with the suffix outside of the run.
    """

    def __init__(self, texts: list[bytes], weights: list[int] | None = None):
        """The contexts are laid end to end; an end mark below all bytes closes each. weights: how many copies each stands for."""
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        self.sizes, self.total = sizes, int((sizes + 1).sum())
        self.copied = np.array(weights or [1] * len(texts)) > 1
        symbols = np.zeros(self.total, np.int16)
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
        symbols[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)] = flat
        order, ranks = self._sorted(symbols)
        before = symbols[order - 1]
        heads = np.ones(len(order), bool)
        heads[1:] = before[1:] != before[:-1]
        at = np.flatnonzero(order == 0)  # the text's first symbol has none before it and is a run of its own
        heads[at] = True
        heads[at[at + 1 < len(order)] + 1] = True
        head = np.flatnonzero(heads)
        tail = np.append(head[1:], len(order)) - 1
        inside = np.add.accumulate(np.repeat(np.array(weights or [1] * len(texts), np.int64), sizes + 1)[order])
        self.symbol, self.length = before[head], np.diff(inside[tail], prepend=0)
        self.first, self.last = order[head].astype(np.int64), order[tail].astype(np.int64)
        self.first_match, self.last_match = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        self.first_match[1:] = self._common(symbols, ranks, self.last[:-1], self.first[1:])
        self.last_match[:-1] = self.first_match[1:]

    @staticmethod
    def _sorted(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by prefix doubling over what is not settled yet; the ranks of each step."""
        n = len(symbols)
        padded = np.concatenate([symbols, np.zeros(7, np.int16)])
        key = np.zeros(n, np.int64)
        for j in range(7):
            key = (key << 9) | padded[j : j + n]
        order = np.argsort(key, kind="stable").astype(np.int32)
        new = np.ones(n, bool)
        sorted_ = key[order]
        new[1:] = sorted_[1:] != sorted_[:-1]
        del key, sorted_
        rank = np.empty(n, np.int32)
        head = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        rank[order] = head
        levels, width = [(7, rank.copy())], 7
        while True:
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                return order, levels
            who = order[slots]
            follow = who.astype(np.int64) + width
            second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
            key = head[slots].astype(np.int64) * (n + 1) + second
            sort = np.argsort(key, kind="stable")
            who, key = who[sort], key[sort]
            order[slots] = who
            fresh = np.ones(len(slots), bool)
            fresh[1:] = key[1:] != key[:-1]
            new[slots] = fresh
            head = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
            rank[who] = head[slots]
            width *= 2
            levels.append((width, rank.copy()))

    @staticmethod
    def _common(symbols: np.ndarray, ranks: list[tuple[int, np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes x and y, from the ranks of the steps."""
        n, found = len(symbols), np.zeros(len(x), np.int64)
        x, y = x.copy(), y.copy()
        for width, rank in reversed(ranks):
            same = (x < n) & (y < n)
            same[same] = rank[x[same]] == rank[y[same]]
            step = np.where(same, width, 0)
            found, x, y = found + step, x + step, y + step
        for _ in range(7):
            same = (x < n) & (y < n)
            same[same] = symbols[x[same]] == symbols[y[same]]
            found, x, y = found + same, x + same, y + same
        return found

    def _streamed(self, at: np.ndarray, match: np.ndarray) -> np.ndarray:
        """The matches of all text positions, from those at samples: one shorter with each step up to the next sample."""
        place = np.arange(self.total)
        value, source = np.zeros(self.total, np.int64), np.full(self.total, -1)
        value[at], source[at] = match, at
        last = np.maximum.accumulate(source)
        return np.where(last >= 0, value[last] - (place - last), 0)

    def statistics(self) -> np.ndarray:
        """Of every position, the longest match of what follows it with what follows any other position."""
        found = np.maximum(self._streamed(self.first, self.first_match), self._streamed(self.last, self.last_match))
        return np.maximum(found, self._streamed(self.starts, np.where(self.copied, self.sizes, 0)))  # a copy matches to its end

    def marked(self, length: int) -> list[np.ndarray]:
        """Of each context, the places from which length bytes occur elsewhere too."""
        long = self.statistics() >= length
        return [np.flatnonzero(long[s : s + n - length + 1]) for s, n in zip(self.starts, self.sizes, strict=True)]


def merged(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that windows at sorted places cover."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > length)
    return list(zip(places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + length).tolist(), strict=True))


_SPANS = "name long, c1 long, c2 long, spans array<struct<x: int, y: int>>"
_SPANS_ARROW = pa.schema([("name", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("spans", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))])


def _span_batch(rows: list[tuple[int, int, int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"name": n, "c1": a, "c2": b, "spans": [{"x": x, "y": y} for x, y in found]} for n, a, b, found in rows if found], schema=_SPANS_ARROW)


def _index_of(length: int, batch_bytes: int = 1 << 19):
    """Rows (name, c1, c2, bytes, weight), sorted by name within the partition -> spans of each class; whole names at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = RunIndex([r[3] for r in rows], [r[4] for r in rows]).marked(length)
        return _span_batch([(*row[:3], merged(places, length)) for row, places in zip(rows, found, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total >= batch_bytes and row[0] != held[-1][0]:
                    yield solve(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[3])
        if held:
            yield solve(held)

    return run


_WANTED = "name long, c1 long, c2 long, bytes binary, weight long, total long"
_WANTED_ARROW = pa.schema([("name", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bytes", pa.binary()), ("weight", pa.int64()), ("total", pa.int64())])


def _wanted_of(length: int):
    """Rows (text, asked) -> the bytes of the contexts asked for, which stand for their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(x["name"], x["c1"], x["c2"], raw[x["a"] : x["b"] + length - 1], x["weight"], x["total"]) for x in asked]
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000], strict=True), _WANTED_ARROW.types, strict=True)], schema=_WANTED_ARROW)

    return run


def _prints(raw: bytes, length: int) -> np.ndarray:
    """Fingerprints of all windows of a context; compared within one name only."""
    buf = np.frombuffer(raw, np.uint8)
    return (rolling(buf, length) ^ (rolling(buf, length, _BASE2) >> np.uint64(7))).view(np.int64)


def _split_names(wanted: DataFrame, length: int, share: int = 1 << 16, buckets: int = 64) -> DataFrame:
    """Spans of the classes of hot names, without gathering such a name in one task.

    A name's classes are salted into shares of about `share` bytes. Each share lists its windows' fingerprints, those seen once and
    those seen again, by bucket; a bucket's lists from all shares tell which fingerprints repeat; those go back to every share, which
    marks its classes. Lists travel as arrays, so there are a few rows per share, and work and traffic grow in proportion to the windows.
    """
    rows = wanted.withColumn("salts", F.ceil(F.col("total") / share).cast("int")).withColumn("salt", F.pmod(F.xxhash64("c1", "c2"), F.col("salts")).cast("int"))
    listed = pa.schema([("name", pa.int64()), ("bucket", pa.int32()), ("salts", pa.int32()), ("once", pa.list_(pa.int64())), ("again", pa.list_(pa.int64()))])

    def lists(group: pa.Table) -> pa.Table:
        own, weight = [_prints(x.as_py(), length) for x in group.column("bytes")], group.column("weight").to_numpy()
        values, at, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        counts += np.bincount(at, np.repeat(weight > 1, [len(x) for x in own]), len(values)).astype(np.int64)  # a copy is an occurrence too
        bucket, out = values % buckets, []
        for k in np.unique(bucket):
            mine = bucket == k
            out.append({"name": group.column("name")[0].as_py(), "bucket": int(k), "salts": group.column("salts")[0].as_py(), "once": values[mine & (counts == 1)], "again": values[mine & (counts > 1)]})
        return pa.Table.from_pylist(out, schema=listed)

    def merge(group: pa.Table) -> pa.Table:
        flat = lambda c: np.concatenate([np.zeros(0, np.int64), *(np.array(x.as_py(), np.int64) for x in group.column(c))])
        again = np.unique(flat("again"))
        values, counts = np.unique(np.concatenate([flat("once"), again]), return_counts=True)
        return pa.table({"name": group.column("name")[:1], "salts": group.column("salts")[:1], "prints": pa.array([np.union1d(values[counts > 1], again)], pa.list_(pa.int64()))})

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        prints = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.array(x.as_py(), np.int64) for x in right.column("prints"))]))
        out = []
        if len(prints):
            for name, c1, c2, raw in zip(*(left.column(c).to_pylist() for c in ("name", "c1", "c2", "bytes")), strict=True):
                own = _prints(raw, length)
                hit = prints[np.minimum(np.searchsorted(prints, own), len(prints) - 1)] == own
                out.append((name, c1, c2, merged(np.flatnonzero(hit), length)))
        return pa.Table.from_batches([_span_batch(out)])

    found = rows.select("name", "salt", "salts", "bytes", "weight").groupBy("name", "salt").applyInArrow(lists, "name long, bucket int, salts int, once array<long>, again array<long>")
    repeats = found.groupBy("name", "bucket").applyInArrow(merge, "name long, salts int, prints array<long>").where(F.size("prints") > 0)
    sent = repeats.select("name", "prints", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return rows.select("name", "salt", "c1", "c2", "bytes").groupBy("name", "salt").cogroup(sent.groupBy("name", "salt")).applyInArrow(mark, _SPANS)


def _keys() -> tuple[Column, Column]:
    """What tells the rows apart: the doc_id (a hash of the text where it is null) and a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), text)), F.xxhash64(text)


def class_spans(docs: DataFrame, length: int = 200, hot: int = 1 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The contexts of names that occur again (k1, k2, a, name, c1, c2), and the spans of their classes: by index, and by lists."""
    k1, k2 = _keys()
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))
    found = written(texts.mapInArrow(lean(_contexts_of(length)), "k1 long, k2 long, a int, b int, name long, c1 long, c2 long, own boolean"), "contexts")
    often = written(found.groupBy("name").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 OR any_own").select("name", "n"), "names")
    shared = written(spread_join(found.drop("own"), often.select("name"), "name", "c1", counts=often, total=found.count()), "shared")
    size = F.col("b") - F.col("a") + length - 1
    alike = shared.groupBy("name", "c1", "c2").agg(F.count("*").alias("weight"), F.min(F.struct("k1", "k2", "a", "b")).alias("one"), F.max(size).cast("long").alias("size"))
    alike = written(alike.select("name", "c1", "c2", "weight", "size", "one.*"), "classes")
    whole = written(alike.groupBy("name").agg(F.sum("size").alias("total"), F.count("*").alias("n")), "names")
    rows = spread_join(alike, whole.select("name", "total"), "name", "c1", counts=whole.select("name", "n"), total=alike.count())
    asked = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("name", "c1", "c2", "a", "b", "weight", "total")).alias("asked"))
    # equal rows send their classes twice; these have a weight above 1 anyway, and their spans are united
    wanted = written(texts.join(asked, ["k1", "k2"]).select("text", "asked").mapInArrow(lean(_wanted_of(length)), _WANTED), "wanted")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_name = wanted.where(F.col("total") <= hot).select("name", "c1", "c2", "bytes", "weight")
    indexed = by_name.repartition(parts, "name").sortWithinPartitions("name", "c1", "c2").mapInArrow(lean(_index_of(length)), _SPANS)
    return shared, indexed, _split_names(wanted.where(F.col("total") > hot), length)


def repeated_ranges(docs: DataFrame, length: int = 200, hot: int = 1 << 20) -> DataFrame:
    """k1, k2, a, b: byte ranges that repeated windows cover; ranges of one row may overlap."""
    shared, indexed, listed = class_spans(docs, length, hot)
    spans = written(indexed.unionByName(listed), "spans")
    found = shared.select("k1", "k2", "a", "name", "c1", "c2").join(spans, ["name", "c1", "c2"]).select("k1", "k2", "a", F.explode("spans").alias("s"))
    return found.select("k1", "k2", (F.col("a") + F.col("s.x")).alias("a"), (F.col("a") + F.col("s.y")).alias("b"))


def _union(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_ranges(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """docs with one more column, the last: the ranges of each row."""
    name, one, two = (free_name(docs, x) for x in ("ranges", "k1", "k2"))
    spans = repeated_ranges(docs, length, hot).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias(name)).withColumnsRenamed({"k1": one, "k2": two})
    k1, k2 = _keys()
    return docs.withColumns({one: k1, two: k2}).join(spans, [one, two], "left").select(*docs.columns, name)


def _cut(text: str | None, ranges: list) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    spans, at, kept = _union(ranges), 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return raw, b"".join(kept), spans


def suffix_dedup(docs: DataFrame, length: int = 200, hot: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, kept, spans = _cut(text, ranges)
                rows.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(zip(*rows, strict=True) if rows else [()] * 5)], names)

    cut = _with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, hot)
    return cut.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = 200, hot: int = 1 << 20) -> DataFrame:
    """docs without their repeated passages; a character that a cut splits goes too; n_chars follows; all rows and columns stay."""

    text, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            old = columns[text].to_pylist()
            new = [t if not r else _cut(t, r)[1].decode("utf-8", "ignore") for t, r in zip(old, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            if size is not None:
                columns[size] = pa.array([n if a is b else len(b) for n, a, b in zip(columns[size].to_pylist(), old, new, strict=True)], columns[size].type)
            columns[text] = pa.array(new, columns[text].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return _with_ranges(docs, length, hot).mapInArrow(lean(run), docs.schema)
