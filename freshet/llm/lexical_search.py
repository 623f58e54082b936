"""Ranked lexical search over a length-stratified index.

A document's score depends on its length only through its normaliser m, so documents of equal m form a stratum: inside it a term's
share of a score is a function of tf alone. The index lays documents out by m in segments of bounded size; a segment holds, for each
term, the ordinals of its documents grouped by (m, tf), so that an impact is computed once per tf of a stratum and added to a whole
group of documents at once. Bounds are kept at two levels: the largest impact of a term in a segment, and in each of its strata. A
search visits an item's most promising segment first; the score of rank k found there is a floor for all others, so that segments and
strata whose bound lies below it are never opened. What is skipped is provably outside the best k, and every result is exact.

Jobs: documents are tokenised once into a written table of (terms, tf); N and L are two sums over it; one range shuffle on (m, hash of
the id) builds segments (a stratum of any size is split over them); document frequencies are summed from the segments' own counts.
Items are searched in blocks of bounded size, which is what travels to the tasks: a block is a set of stated queries, and no pair of
documents is ever made. Each segment returns at most k rows an item, and ranks are taken by a window that is limited to k on the map
side too.

Defined results: a null or empty text has no terms: as a document it counts neither in N nor in L and is never returned, as an item it
finds nothing; rows of one item_id are one item with the terms of all of them; repeated documents are documents of their own and are
returned as often as they stand there (equal scores and ids share no order); a null doc_id sorts first among equal scores; a document
of any length is one row; an empty table of documents or items gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import lean, released, written

# Fixed values of the contract: characters that belong to no term (ASCII but for letters and digits), and the scale of scores.
GAPS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
UNIT = 1_000_000_000

_FOLD = bytes(0x20 if b in GAPS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
NO_ID = -(1 << 63)

SEGMENT_DOCS = 1 << 14
SEGMENT_POSTINGS = 1 << 20
#: Rows of the index that leave a worker at once: what Spark must hold of a segment beside its own rows.
INDEX_ROWS = 1 << 13
#: (item, term) pairs that travel to the tasks at once.
BLOCK_PAIRS = 100_000

INDEX = "segment long, term string, df long, top long, m array<int>, tf array<int>, size array<int>, docs array<int>, ids array<long>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: separators become blanks and A-Z small in one pass; multi-byte characters stay whole."""
    return text.translate(_FOLD).split()


def impact(tf, m):
    """What a term adds to a score for each unit of its weight."""
    return UNIT * tf // (1000 * tf + 20 * m)


def tokenised(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n (terms with repeats), terms (distinct) and tfs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, flat, tfs = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = Counter(terms_of(text or b""))
                n.append(found.total())
                flat += found.keys()
                tfs += found.values()
                ends.append(len(flat))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(flat, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], [key, "n", "terms", "tfs"])

    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"{key} long, n long, terms array<string>, tfs array<int>")


class _Segment:
    """Gathers documents in order of (m, doc_id) and gives the index rows of one segment."""

    def __init__(self) -> None:
        self.pieces: list[pa.RecordBatch] = []
        self.docs = self.postings = 0

    def take(self, batch: pa.RecordBatch, ends: np.ndarray) -> int:
        """Add as many rows of batch as the segment has room for (a first row always), and say how many; ends: postings up to a row's end."""
        room = int(np.searchsorted(ends, SEGMENT_POSTINGS - self.postings, "right"))
        n = min(len(ends), SEGMENT_DOCS - self.docs, max(room, 0 if self.docs else 1))
        if n:
            self.pieces.append(batch.slice(0, n))
            self.docs, self.postings = self.docs + n, self.postings + int(ends[n - 1])
        return n

    def rows(self, name: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(self.pieces).combine_chunks()
        ids, ms = table.column("doc_id").fill_null(NO_ID).to_numpy(), table.column("m").to_numpy()
        terms, tfs = (table.column(k).combine_chunks() for k in ("terms", "tfs"))
        coded = terms.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        by_word = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), "int64")
        rank[by_word] = np.arange(len(words))
        code = rank[coded.indices.to_numpy()]
        doc = np.repeat(np.arange(len(ids), dtype="int32"), terms.value_lengths().to_numpy())
        m, tf = ms[doc], tfs.flatten().to_numpy()
        order = np.lexsort((doc, tf, m, code))
        code, m, tf, doc = code[order], m[order], tf[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(m) != 0) | (np.diff(tf) != 0)]))
        size = np.diff(np.append(new, len(code))).astype("int32")
        first = np.searchsorted(code[new], np.arange(len(words) + 1))
        top = np.maximum.reduceat(impact(tf[new].astype("int64"), m[new].astype("int64")), first[:-1])
        strata, count = np.unique(ms, return_counts=True)

        def lists(head: np.ndarray, rest: np.ndarray, ends: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + len(head)]).astype("int32")), pa.array(np.concatenate([head, rest]).astype("int32")))

        none = np.zeros(0, "int32")
        columns = {
            # The first row of a segment has no term: its strata, their sizes, and the documents' ids.
            "segment": pa.array(np.full(len(words) + 1, name)),
            "term": pa.array([None, *(words[i] for i in by_word)], pa.string()),
            "df": pa.array(np.concatenate([[0], np.bincount(code, minlength=len(words))])),
            "top": pa.array(np.concatenate([[0], top])),
            "m": lists(strata, m[new], first),
            "tf": lists(none, tf[new], first),
            "size": lists(count, size, first),
            "docs": lists(none, doc, np.searchsorted(code, np.arange(len(words) + 1))),
            "ids": pa.array([ids, *[None] * len(words)], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_pydict(columns)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    def sent(segment: _Segment, name: int) -> Iterator[pa.RecordBatch]:
        rows = segment.rows(name)
        segment.pieces.clear()
        for at in range(0, rows.num_rows, INDEX_ROWS):
            yield rows.slice(at, INDEX_ROWS)
        del rows
        released()

    part, k, now = TaskContext.get().partitionId(), 0, _Segment()
    for batch in batches:
        while batch.num_rows:
            taken = now.take(batch, np.cumsum(batch.column(2).value_lengths().to_numpy()))
            batch = batch.slice(taken)
            if batch.num_rows:
                yield from sent(now, part << 32 | k)
                k, now = k + 1, _Segment()
    if now.docs:
        yield from sent(now, part << 32 | k)


class LexicalIndex:
    """index: one row a segment and term (see INDEX); N and L of the contract."""

    def __init__(self, index: DataFrame, n_docs: int, n_terms: int):
        self.index, self.n_docs, self.n_terms = index, n_docs, n_terms

    @classmethod
    def build(cls, docs: DataFrame) -> LexicalIndex:
        """The index of all documents (doc_id, text) and all of their terms."""
        known = written(tokenised(docs).where("n > 0"), "terms")
        sums = known.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        n, l = sums["n"], sums["l"] or 1
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        m = (F.lit(50) + F.expr(f"50 * n * {n}L div {l}L")).cast("int").alias("m")
        laid = known.select("doc_id", m, "terms", "tfs").repartitionByRange(parts, "m", F.xxhash64("doc_id")).sortWithinPartitions("m", "doc_id")
        return cls(written(laid.mapInArrow(lean(_segments), INDEX), "index"), n, l)

    def weights(self, terms: DataFrame) -> DataFrame:
        """term and w of those of terms (term) that some document holds."""
        held = self.index.where("term IS NOT NULL").select("term", "df").join(terms.distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        return held.select("term", F.floor(1000 * F.log((2.0 * self.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w"))

    def search(self, items: DataFrame, k: int = 50) -> DataFrame:
        """item_id, rank, doc_id, score: the k best documents of every item (item_id, text) with a score above 0."""
        asked = written(tokenised(items, "item_id").select("item_id", F.explode("terms").alias("term")).distinct(), "asked")
        weighted = written(asked.join(self.weights(asked.select("term")), "term").where("w > 0"), "weighted")
        blocks = max(1, math.ceil(weighted.count() / BLOCK_PAIRS))
        found = [self._block(weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
        best = found[0]
        for more in found[1:]:
            best = best.unionByName(more)
        return ranked(best, k)

    def _block(self, weighted: DataFrame, k: int) -> DataFrame:
        """item_id, doc_id, score of at most k documents an item and visited segment."""
        rows = weighted.select("item_id", "term", "w").collect()  # at most about BLOCK_PAIRS
        names = sorted({r["item_id"] for r in rows}, key=lambda x: (x is not None, x or 0))
        place = {x: i for i, x in enumerate(names)}
        terms: dict[str, list[tuple[int, int]]] = {}
        for r in rows:
            terms.setdefault(r["term"], []).append((place[r["item_id"]], r["w"]))
        asked = weighted.select("term").distinct()
        spark = weighted.sparkSession
        numbered = spark.createDataFrame([(i, x) for x, i in place.items()], "item int, name long")
        pairs = weighted.join(F.broadcast(numbered), F.col("item_id").eqNullSafe(F.col("name"))).select("item", "term", "w")
        held = self.index.join(F.broadcast(asked), "term", "left_semi")  # a block has few terms
        bounds = written(held.select("segment", "term", "top").join(F.broadcast(pairs), "term").groupBy("item", "segment").agg(F.sum(F.col("w") * F.col("top")).alias("bound")), "bounds")
        opened = held.unionByName(self.index.where("term IS NULL"))
        score = scorer(terms, k)

        def visit(opened: DataFrame, visits: DataFrame) -> DataFrame:
            """The best of each segment for the items that visit it (segment, item, floor)."""
            return opened.groupBy("segment").cogroup(visits.groupBy("segment")).applyInPandas(score, "item int, doc_id long, score long")

        seed = Window.partitionBy("item").orderBy(F.desc("bound"), "segment")
        firsts = bounds.withColumn("k", F.row_number().over(seed)).where("k = 1").select("segment", "item", F.lit(1).cast("long").alias("floor"))
        near = written(visit(opened.join(F.broadcast(firsts.select("segment").distinct()), "segment", "left_semi"), firsts), "seeds")
        floors = near.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("r") == k).select("item", F.col("score").alias("floor"))
        rest = bounds.join(firsts.select("segment", "item"), ["segment", "item"], "left_anti").join(floors, "item", "left").select("segment", "item", "bound", F.coalesce("floor", F.lit(1).cast("long")).alias("floor"))
        late = visit(opened, rest.where("bound >= floor").select("segment", "item", "floor"))
        return near.unionByName(late).join(F.broadcast(numbered), "item").select(F.col("name").alias("item_id"), "doc_id", "score")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of every item, by falling score and rising doc_id."""
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def scorer(terms: dict[str, list[tuple[int, int]]], k: int):
    """The kernel of a segment: for each visiting item, strata by falling bound until none can reach the k-th score so far."""

    def strata_of(head: pd.Series, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """m and first ordinal of each stratum, ids; and for each term its groups: stratum, impact, where its documents lie."""
        m, size, ids = head["m"], head["size"], head["ids"]
        known = {}
        for term, gm, gtf, gsize, docs in zip(rows["term"], rows["m"], rows["tf"], rows["size"], rows["docs"], strict=True):
            at = np.searchsorted(m, gm)
            known[term] = (at, impact(gtf.astype("int64"), gm.astype("int64")), np.concatenate([[0], np.cumsum(gsize)]), docs)
        return m, np.concatenate([[0], np.cumsum(size)]), ids, known

    def kernel(rows: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(visits) and len(rows):
            head = rows[rows["term"].isna()].iloc[0]
            m, first, ids, known = strata_of(head, rows[rows["term"].notna()])
            asked: dict[int, list[tuple[str, int]]] = {}
            for term in known:
                for item, w in terms[term]:
                    asked.setdefault(item, []).append((term, w))
            # Largest impact of a term in each stratum, once for all items.
            tops = {}
            for term, (at, imp, _, _) in known.items():
                tops[term] = np.zeros(len(m), "int64")
                np.maximum.at(tops[term], at, imp)
            for item, floor in zip(visits["item"], visits["floor"], strict=True):
                out += best_of(int(item), int(floor), asked.get(int(item), []), first, ids, known, tops)
            rows = head = known = tops = None
            released()  # a segment's share, as the worker stays for the next one
        return pd.DataFrame(out, columns=["item", "doc_id", "score"]).astype({"item": "int32", "doc_id": "Int64", "score": "int64"})

    def best_of(item, floor, mine, first, ids, known, tops) -> list[tuple]:
        bound = np.zeros(len(first) - 1, "int64")
        for term, w in mine:
            bound += w * tops[term]
        best = (np.zeros(0, "int64"), np.zeros(0, "int64"))
        for s in np.argsort(-bound, kind="stable"):
            if bound[s] < floor:
                break
            lo, hi = first[s], first[s + 1]
            total = np.zeros(hi - lo, "int64")
            for term, w in mine:
                if tops[term][s]:
                    at, imp, ends, docs = known[term]
                    a, b = np.searchsorted(at, s), np.searchsorted(at, s, "right")
                    gain = np.repeat(w * imp[a:b], np.diff(ends[a : b + 1]))
                    total[docs[ends[a] : ends[b]] - lo] += gain  # a document holds a term once
            good = np.flatnonzero(total >= floor)
            if len(good):
                score, doc = np.concatenate([best[0], total[good]]), np.concatenate([best[1], ids[lo:hi][good]])
                keep = np.lexsort((doc, -score))[:k]
                best = score[keep], doc[keep]
                if len(keep) == k:
                    floor = max(floor, int(best[0][-1]))
        return [(item, None if d == NO_ID else int(d), int(x)) for x, d in zip(*best, strict=True)]

    return kernel


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents (doc_id, text) of every item (item_id, text)."""
    return LexicalIndex.build(docs).search(items, k)
