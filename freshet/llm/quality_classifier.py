"""Quality classifier: Naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their smoothed counts in the two classes (Naive Bayes), and a linear hinge-loss
model is fitted to the scaled indicators by dual coordinate descent. N-grams are words, word pairs, and pairs of word shapes
(letters folded to their case, digits to 0, runs shortened), so that junk made of unseen words is still seen; how dense the
unusual shapes and the immediate repeats are enters as bucketed indicators. The margin becomes a probability by a logistic
curve fitted on rows that the hinge model did not see, weighted back to the classes' true shares.

Bounded parameter: at most about `per_class` labelled rows of each class are learnt from; scoring covers every row.

Defined results: a null or empty text has no n-grams and gets the score of the bias alone; long texts are read whole; repeated
rows get equal scores; without usable labels every score is 0.5; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import crc_fold, lean, learning_sample, logistic_curve, written

_LETTERS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+"))


_ODD, _CAPS, _BARE = 1, 2, 4
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SHAPE_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class _Kept(dict):
    """A function of words, kept for a bounded number of them; very long words are worked out each time."""

    def __init__(self, f: Callable[[str], int]):
        self.f = f

    def __missing__(self, word: str) -> int:
        value = self.f(word)
        if len(self) < 100_000 and len(word) < 60:
            self[word] = value
        return value


def shape(word: str) -> str:
    fold = _LETTERS[0].sub(lambda m: "a" if m[0].islower() else "A" if m[0].isupper() and len(m[0]) > 1 else "Aa", word)
    return _LETTERS[2].sub(r"\1+", _LETTERS[1].sub("0", fold))


def _shape_hash(word: str) -> int:
    """Hash of the shape; its last three bits say odd, all capitals, without letters."""
    s = shape(word)
    flags = _ODD * (s not in _PLAIN) | _CAPS * ("A" in s and "Aa" not in s) | _BARE * ("a" not in s and "A" not in s)
    return _hash(s) & ~7 | flags


_WORDS, _SHAPES = _Kept(_hash), _Kept(_shape_hash)
_PLAIN = {"a", "Aa", "A", "a.", "a,", "Aa.", "Aa,"}


def _density(name: int, part: int, whole: int) -> int:
    """Code of a bucket of the share on a log scale: 0, under 1/64, ... 1/2 and over."""
    return 1_000_003 * name + (0 if not part else max(1, 8 + math.floor(math.log2(part / whole))))


def ngrams(text: str) -> np.ndarray:
    """Sorted hashes of a whole text's indicators: words, word pairs, shape pairs, density buckets."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    s = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, n)
    share = [_density(k, int(np.count_nonzero(s & np.uint64(bit))), n) for k, bit in enumerate((_ODD, _CAPS, _BARE))]
    share.append(_density(3, int(np.count_nonzero(w[1:] == w[:-1])), n))
    with np.errstate(over="ignore"):
        return np.unique(np.concatenate([w, w[:-1] * _PAIR + w[1:], s[:-1] * _SHAPE_PAIR + s[1:], np.array(share, np.uint64)]))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Linear hinge-loss weights; rows are (indices, values), y is -1 or 1."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norm = np.array([float(v @ v) for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            if norm[i] == 0:
                continue
            slope = y[i] * float(w[index] @ value) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost)
            if (change := new - alpha[i]) != 0:
                w[index] += change * y[i] * value
                alpha[i] = new
                moved = max(moved, abs(change))
        if moved < 1e-3:
            break
    return w


def fit(ids: list[int], sparse: list[np.ndarray], labels: list[int], index: np.ndarray) -> dict:
    """Sorted n-grams with their weights, bias and the curve; sparse: of each row, its places in the sorted index of n-grams.

    The result does not depend on the order of the rows.
    """
    order = sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], len(sparse[i])))
    sparse, y = [sparse[i] for i in order], np.array([labels[i] for i in order], int)
    none = np.zeros(0)
    if len(set(y.tolist())) < 2 or not len(index):
        return {"grams": none.astype(np.uint64), "pull": none, "norm": none, "bias": 0.0, "slope": 1e-6, "at": 0.0}
    counts = np.ones((2, len(index)))
    for label, row in zip(y, sparse, strict=True):
        counts[label, row] += 1
    ratio = np.log(counts[1] / (1 + (y == 1).sum())) - np.log(counts[0] / (1 + (y == 0).sum()))
    size = len(index) + 1

    def learn(rows: np.ndarray) -> np.ndarray:
        scaled = []
        for i in rows:
            value = np.append(ratio[sparse[i]], 1.0)
            scaled.append((np.append(sparse[i], size - 1), value / max(1e-9, np.linalg.norm(value))))
        return dual_coordinate_descent(scaled, 2.0 * y[rows] - 1, size)

    def margins(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = []
        for i in rows:
            value = ratio[sparse[i]]
            out.append((float(w[sparse[i]] @ value) + w[-1]) / math.sqrt(float(value @ value) + 1))
        return np.array(out)

    part = np.arange(len(y)) % 4
    inner, outer = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
    slope, at = logistic_curve(margins(learn(inner), outer), y[outer], np.ones(len(outer)))
    w = learn(np.arange(len(y)))
    useful = np.abs(ratio) > 1e-4
    return {"grams": index[useful], "pull": (w[:-1] * ratio)[useful], "norm": (ratio**2)[useful], "bias": float(w[-1]), "slope": slope, "at": at}


def _forgotten(texts: Iterator) -> Iterator:
    """texts, and at their end the kept words are dropped, as the worker's memory goes to later stages."""
    yield from texts
    _WORDS.clear()
    _SHAPES.clear()


def _found(grams: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Places in the sorted index of those grams that it holds."""
    if not len(index):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(index, grams), len(index) - 1)
    return at[index[at] == grams]


def score(text: str, model: dict) -> float:
    """P(label = 1) of a text."""
    hits = _found(ngrams(text), model["grams"])
    margin = (float(model["pull"][hits].sum()) + model["bias"]) / math.sqrt(float(model["norm"][hits].sum()) + 1)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, model["slope"] * margin + model["at"]))))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _forgotten(batches):
        grams = [ngrams(t.as_py() or "").view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "label", "grams"])


def trained(docs: DataFrame, labels: DataFrame, target: str, fold: Callable[[Column, int], Column], folds: int, held: int, per_class: int, min_docs: int = 3) -> dict:
    """The model, from a bounded sample of labelled rows outside the held-out fold.

    The sample's n-grams are counted by Spark; the driver gets those of at least min_docs rows, and each row's places among them.
    """
    sample = learning_sample(docs, labels, target, fold, folds, held, per_class)
    rows = written(sample.mapInArrow(lean(_sampled), "doc_id long, label int, grams array<long>"), "sample")
    often = rows.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("gram").toArrow()
    index = np.sort(often.column("gram").to_numpy().view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_found(np.array(x.as_py(), np.int64).view(np.uint64), sent.value).astype(np.int32).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], ["doc_id", "label", "places"])

    known = rows.mapInArrow(lean(places), "doc_id long, label int, places binary").toArrow()  # bounded by per_class
    return fit(known.column("doc_id").to_pylist(), [np.frombuffer(x.as_py(), np.int32) for x in known.column("places")], known.column("label").to_pylist(), index)


def quality_classifier(docs: DataFrame, labels: DataFrame, target: str = "quality", fold: Callable[[Column, int], Column] = crc_fold, folds: int = 4, held: int = 2, threshold: float = 0.7, per_class: int = 3000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; learns outside the held-out fold only."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, target, fold, folds, held, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in _forgotten(batches):
            found = pa.array([score(t.as_py() or "", model) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "text")
    scored = rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, target: str = "quality", fold: Callable[[Column, int], Column] = crc_fold, folds: int = 4, held: int = 2, threshold: float = 0.7, per_class: int = 3000) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; decided in the scan, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, target, fold, folds, held, per_class))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in _forgotten(batches):
            yield batch.filter(pa.array([score(t.as_py() or "", model) >= threshold for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
