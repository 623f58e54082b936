"""Toxicity by weak supervision.

1. Voters look at a text; each fires or abstains: fixed lexicons, patterns, and lexicons of words and stems that tell the labelled
   rows outside the held-out fold apart (no list of words knows every language).
2. Votes of all documents, labelled or not, are counted by pattern: one Spark aggregation, at most 2**voters rows.
3. A generative label model (class-conditional votes) is fitted to these counts by expectation maximisation. It sees no label. It
   estimates the accuracy of each voter, and correlations: pairs of voters that agree more than the class explains, from the
   residual covariance; a correlated group shares its evidence instead of counting it again and again.
4. A linear classifier over word and stem indicators is fitted to the posterior labels of documents outside the held-out fold.
5. Labels come back at the end alone: a curve turns margins into probabilities.

Bounded parameter: about `per_class` labelled rows of each class, and as many documents of either posterior class, are learnt from.
Their words are counted on the executors; the driver gets the telling words and, of each such row, which of these it holds. Scoring
covers every row, whole texts.

Defined results: a null or empty text has no word and gets the bias alone (a low score); repeated rows get equal scores; rows without
a doc_id vote and are scored, but no classifier is fitted to them; without usable labels the fixed lexicons and patterns vote alone;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import crc_fold, learning_sample, logistic_curve, written

# Lexicons of insulting words, by kind.
LEXICONS = {
    "insult": "idiot idiots moron morons stupid dumb fool fools imbecile imbeciles dimwit dunce clown clowns loser losers",
    "contempt": "pathetic worthless disgusting useless vile repulsive disgrace scum filth filthy trash garbage vermin parasite",
    "hostile": "hate despise destroy kill shut hurt punish",
    "german": "idiot idioten dumm dummkopf abschaum trottel arschloch wertlos widerlich versager",
    "french": "idiot imbécile débile ordure minable dégoûtant crétin salaud racaille",
    "spanish": "idiota imbécil estúpido basura asqueroso inútil escoria payaso perdedor",
}
_WORD = re.compile(r"[^\W\d_]+")
_YOU = re.compile(r"\b(?:you|your|you're|du|ihr|tu|vous|tú|usted)\b", re.IGNORECASE)
STEM = 4


def indicators(text: str) -> set[str]:
    """Words, and stems of longer words (marked by a star), of a whole text."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def telling(rows: DataFrame, least_z: float = 6.0, least_ratio: float = 1.5) -> list[str]:
    """Of rows (label between 0 and 1, words), the words whose share of rows differs between the classes beyond chance and by a wide ratio."""
    sums = rows.agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).first()
    n1, n0 = (sums["pos"] or 0) + 1e-9, (sums["neg"] or 0) + 1e-9
    count = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    share = (F.col("a") + F.col("b")) / (n0 + n1)
    z = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) * (1 / n1 + 1 / n0) + 1e-12)
    ratio = F.log((F.col("a") + 0.5) / n1) - F.log((F.col("b") + 0.5) / n0)
    return sorted(r["word"] for r in count.where((z >= least_z) & (ratio >= least_ratio)).select("word").collect())


def learned_lexicons(strong: list[str], parts: int = 4) -> dict[str, frozenset[str]]:
    """Telling words and stems, the words dealt over a few voters by a hash so that none has all."""
    words = {f"learned {i}": frozenset(w for w in strong if w[-1] != "*" and crc32(w.encode()) % parts == i) for i in range(parts)}
    return words | {"learned stems": frozenset(w for w in strong if w[-1] == "*")}


class Voters:
    """The voters; votes(text, indicators) is a bit mask of those that fire."""

    def __init__(self, learned: dict[str, frozenset[str]]):
        self.sets = [frozenset(v.split()) for v in LEXICONS.values()] + [*learned.values()]
        self.names = [*LEXICONS, *learned, "addressed", "repeated"]

    def votes(self, text: str, words: set[str]) -> int:
        fired = [bool(s & words) for s in self.sets]
        strong = sum(fired)
        fired.append(strong > 0 and bool(_YOU.search(text)))
        fired.append(sum(len(s & words) for s in self.sets) > 2)
        return sum(1 << i for i, f in enumerate(fired) if f)


def label_model(patterns: dict[int, int], n_voters: int, steps: int = 60) -> dict:
    """Fit class share, firing rates by class, and groups of correlated voters, on counts of vote patterns alone.

    At the start a voter is taken to fire ten times as often in class 1, which says what class 1 is.
    """
    keys = np.array(sorted(patterns), np.int64)
    x = (keys[:, None] >> np.arange(n_voters)) & 1
    n = np.array([patterns[int(k)] for k in keys], float)
    prior, share = 0.1, np.ones(n_voters)
    usual = (n @ x + 0.5) / (n.sum() + 1)
    rate = np.stack([usual / (1 - prior + 10 * prior), np.minimum(0.9, 10 * usual / (1 - prior + 10 * prior))])

    def posterior() -> np.ndarray:
        r = np.clip(rate, 1e-4, 1 - 1e-4)
        fire = (np.log(r[1]) - np.log(r[0])) * share
        calm = (np.log1p(-r[1]) - np.log1p(-r[0])) * share
        return 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + x @ fire + (1 - x) @ calm, -30, 30)))

    for step in range(steps):
        p = posterior()
        w1, w0 = n * p, n * (1 - p)
        prior = float((w1.sum() + 1) / (w1.sum() + w0.sum() + 10))
        rate = np.stack([(w @ x + 0.5) / (w.sum() + 1) for w in (w0, w1)])
        if step >= 4 and step % 4 == 0:  # correlations: what is left of the covariance within the classes
            left = np.zeros((n_voters, n_voters))
            for w, r in ((w0, rate[0]), (w1, rate[1])):
                d = x - r
                left += (d * w[:, None]).T @ d
            scale = np.sqrt(np.maximum(np.diag(left), 1e-9))
            strength = np.clip(left / np.outer(scale, scale), 0, 1) - np.eye(n_voters)
            share = 1 / (1 + np.where(strength > 0.3, strength, 0).sum(axis=1))
    return {"prior": prior, "rate": rate.tolist(), "share": share.tolist(), "posterior": dict(zip(keys.tolist(), posterior().tolist(), strict=True))}


def fit_linear(rows: list[list[int]], soft: np.ndarray, size: int, epochs: int = 40, ridge: float = 2e-5, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels over sparse indicators, by AdaGrad steps on batches."""
    w, b = np.zeros(size), 0.0
    g2, gb = np.full(size, 1e-6), 1e-6
    order = np.random.default_rng(11)
    flat = [np.array(r, np.int64) for r in rows]
    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(flat)), max(1, len(flat) // 64)):
            index = np.concatenate([flat[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(flat[i]) for i in batch])
            z = np.bincount(owner, w[index], len(batch)) + b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft[batch]) / len(batch)
            grad = np.bincount(index, error[owner], size) + ridge * w
            g2 += grad**2
            w -= rate * grad / np.sqrt(g2)
            gb += error.sum() ** 2
            b -= rate * error.sum() / math.sqrt(gb)
    return w, float(b)


def vote_counts(docs: DataFrame, voters: Voters) -> dict[int, int]:
    """How many documents show each pattern of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                text = t.as_py() or ""
                seen[voters.votes(text, indicators(text))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["mask", "n"])

    counts = docs.select("text").mapInArrow(run, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n"))
    return {r["mask"]: r["n"] for r in counts.collect()}  # at most 2**voters rows


def posterior_sample(docs: DataFrame, voters: Voters, posterior: dict[int, float], counts: dict[int, int], per_class: int) -> DataFrame:
    """label (the posterior) and words of about per_class documents of either posterior class, drawn by a hash; docs: doc_id and text."""
    sides = [sum(n for m, n in counts.items() if (posterior[m] >= 0.5) == side) for side in (False, True)]
    share = [min(1.0, per_class / max(1, n)) for n in sides]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, words = [], []
            for t, draw in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if draw >= max(share):
                    continue
                text = t.as_py() or ""
                found = indicators(text)
                label = posterior.get(voters.votes(text, found), 0.0)
                if draw < share[label >= 0.5]:
                    labels.append(label)
                    words.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    return docs.where("doc_id IS NOT NULL").select("text", draw.alias("draw")).mapInArrow(run, "label double, words array<string>")


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([sorted(indicators(t.as_py() or "")) for t in batch.column(0)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), words], ["label", "words"])


def margin(words: set[str], model: dict) -> float:
    weights = model["weights"]
    return model["bias"] + sum(weights[w] for w in words if w in weights)


def trained(docs: DataFrame, labels: DataFrame, target: str, fold: Callable[[Column, int], Column], folds: int, held: int, per_class: int) -> dict:
    """weights by indicator, bias, the voters' names and the label model."""
    spark = docs.sparkSession
    gold = written(learning_sample(docs, labels, target, fold, folds, held, per_class).select("text", "label").mapInArrow(_with_words, "label double, words array<string>"), "gold")
    voters = Voters(learned_lexicons(telling(gold)))
    counts = vote_counts(docs, voters)
    found = label_model(counts, len(voters.names))
    learnt = docs.where(fold(F.col("doc_id"), folds) != held).select("doc_id", "text")
    rows = written(posterior_sample(learnt, voters, found["posterior"], counts, per_class), "posterior")
    names = sorted({w for v in voters.sets for w in v} | set(telling(rows)))
    index = spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [[i for w in x if (i := index.value.get(w)) is not None] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.list_(pa.int32()))], ["label", "places"])

    taken = rows.mapInArrow(places, "label double, places array<int>").toArrow()  # bounded by per_class
    w, b = np.full(len(names), 3.0), -2.0
    if taken.num_rows:
        order = sorted(zip(taken.column("places").to_pylist(), taken.column("label").to_pylist(), strict=True))
        w, b = fit_linear([p for p, _ in order], np.array([y for _, y in order]), len(names))
    model = {"weights": {x: float(v) for x, v in zip(names, w, strict=True) if abs(v) > 1e-3}, "bias": b, "voters": voters.names, "label_model": found}

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([margin(set(x), model) for x in batch.column(1).to_pylist()], pa.float64())], ["label", "margin"])

    known = gold.mapInArrow(margins, "label double, margin double").toArrow()  # bounded by per_class
    y, z = known.column("label").to_numpy(), known.column("margin").to_numpy()
    if len(y) and 0 < (seen := float(y.mean())) < 1:  # weighted to the classes' shares among all labelled rows
        usable = labels.where(F.col(target).isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
        true = min(max(usable.agg(F.avg(target).alias("share")).first()["share"], 1e-3), 1 - 1e-3)
        slope, at = logistic_curve(z, y, np.where(y == 1, true / seen, (1 - true) / (1 - seen)))
        model["weights"] = {x: v * slope for x, v in model["weights"].items()}
        model["bias"] = b * slope + at
    return model


def score(text: str, model: dict) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, margin(indicators(text), model)))))


def toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", fold: Callable[[Column, int], Column] = crc_fold, folds: int = 5, held: int = 0, threshold: float = 0.5, per_class: int = 3000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; learns outside the held-out fold only."""
    model = trained(docs, labels, target, fold, folds, held, per_class)
    sent = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("weights", "bias")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = pa.array([score(t.as_py() or "", model) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
