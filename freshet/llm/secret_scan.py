"""Secret scan: candidate values from whole texts, kept or dismissed by a random forest.

Candidates are private key blocks, values that follow `name =` or `name:` (blanks and quotes between allowed), and long runs of key
characters. Features of a candidate: length, shares of character classes, entropy, transitions (between classes, and how usual the
pairs of letters are in a dictionary), dictionary coverage (the most letters that words of a public vocabulary can cover), what looks
like a path or an address, and the neighbouring words.

Labelled findings: a table of (doc_id, start, end, label) where the user has one. Otherwise they come from what is not among the
features: the exact format of the value, and the name that the value is assigned to (the neighbouring words are those outside the
assignment). The forest is trained in Spark ML on at most about `max_findings` labelled findings, drawn by a hash: a documented bound.
A format of keys or a secret's name makes a secret whatever its shape; the forest decides on all others, also on those that a harmless
name or format labels for the training, so it dismisses false positives and finds keys of formats and names that no rule knows.

The forest is a small broadcast model, and every verdict falls in the scan of the texts: rows are never joined by an id.

Defined results: a null or empty text has no findings and stays as it is; long texts are scanned whole; repeated rows and rows with
no or equal doc_ids are judged each by its own text; an empty table gives an empty one; without findings of both labels the rules
decide alone; clashing column names do not matter.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import lean, written

_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*?-----END [A-Z ]*PRIVATE KEY-----")
_RUN = re.compile(r"[A-Za-z0-9_\-./+@:%]{16,}={0,2}")
_ASSIGNED = re.compile(r"[=:]>?[ \t]{0,3}[\"'`]?([^\s\"'`]{4,})")
_SPOKEN = re.compile(r"(?i)\b(passwords?|passwd|passphrase|pwd|secret|token|api[ _-]?key)(?: is| was)?[ \t]{1,3}[\"'`]?((?=\S*\d)(?=\S*[A-Za-z])[^\s\"'`=:]{8,})")
_NAME = re.compile(r"([A-Za-z_][A-Za-z0-9_.\-]{0,60})[\])]?[\"'`]?[ \t]{0,3}:?$")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")

# Name parts that announce a secret, and those that announce none.
SECRET_NAMES = set("password passwd passphrase pwd pass secret secrets token apikey key auth bearer credential credentials".split())
HARMLESS_NAMES = set("sha md5 checksum commit digest hash etag uuid guid id revision version url http https".split())

# Formats of known keys.
KNOWN_KEYS = {
    "aws_access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9\-]{10,}",
    "stripe_key": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google_api_key": r"AIza[A-Za-z0-9_\-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*",
}
_KNOWN = [(k, re.compile(v)) for k, v in KNOWN_KEYS.items()]
#: Formats of what is no secret: addresses, numbers, dashed words, paths, versions. They label for training; the forest has the last word.
_HARMLESS = re.compile(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}|(?:https?|ftp)://.*|(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[\d.,:/+\-]+|[A-Za-z][a-z]*(?:[-_./][A-Za-z][a-z]*)+|[A-Za-z]+|(?:[./~]|[A-Za-z]:)?(?:[\w.\-]+/)+[\w.\-]*|v?\d+(?:\.\d+)+(?:[-+]\w+)?")
#: Stand-ins for a value that is not there.
_STAND_IN = re.compile(r".*(?:EXAMPLE|example|xxxx|XXXX|changeme|placeholder|your[-_]|\*{3}).*|[$%]?[{(<\[].*|\$\w+|%[sd]|true|false|null|none|None|undefined|os\.\w.*|process\.\w.*|\w+\(.*")

FEATURES = ["length", "digits", "upper", "lower", "other", "entropy", "class_changes", "longest_run", "distinct", "hex", "letter_pairs", "dictionary", "vowels", "slashes", "dots", "at", "extension", "words_before", "words_after", "known_before", "known_after"]


class Dictionary:
    """Whole words of a public vocabulary, and how usual their pairs of letters are."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            pieces = json.load(f)["model"]["vocab"]
        words = [p[: -len("</w>")] for p in pieces if p.endswith("</w>")]
        self.words = {w for w in words if 3 <= len(w) and w.isascii() and w.isalpha()}
        self.longest = max(map(len, self.words))
        pairs = np.ones((26, 26))
        for w in self.words:
            for a, b in zip(w, w[1:], strict=False):
                pairs[ord(a) - 97, ord(b) - 97] += 1
        self.usual = np.log2(pairs / pairs.sum(axis=1, keepdims=True))

    def coverage(self, token: str) -> float:
        """The share of characters that words of the dictionary can cover together, without overlaps."""
        low, best = token.lower(), [0] * (len(token) + 1)
        for end in range(1, len(low) + 1):
            top = best[end - 1]
            for size in range(3, min(self.longest, end) + 1):
                if best[end - size] + size > top and low[end - size : end] in self.words:
                    top = best[end - size] + size
            best[end] = top
        return best[-1] / max(1, len(token))

    def letter_pairs(self, token: str) -> float:
        """Mean log probability of the token's pairs of letters; 0 without any."""
        low = token.lower()
        found = [self.usual[ord(a) - 97, ord(b) - 97] for a, b in zip(low, low[1:], strict=False) if "a" <= a <= "z" and "a" <= b <= "z"]
        return float(sum(found) / len(found)) if found else 0.0


@cache
def dictionary(path: str | None = None) -> Dictionary:
    """The dictionary of a vocabulary file with word ends, once per worker."""
    import public_tokenizers

    return Dictionary(path or public_tokenizers.path("word_bpe_49k.json"))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(token: str, before: str, after: str, known: Dictionary) -> list[float]:
    """The feature vector of a candidate, in the order of FEATURES; before and after lie outside of its assignment."""
    n = len(token)
    kinds = [_kind(c) for c in token]
    letters = [c for c in token.lower() if c.isalpha()]
    run = longest = 1
    for a, b in zip(kinds, kinds[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    near = [_WORD.findall(before)[-3:], _WORD.findall(after)[:3]]
    return [
        math.log2(n),
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        -sum(c / n * math.log2(c / n) for c in Counter(token).values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        longest / n,
        len(set(token)) / n,
        sum(c in "0123456789abcdefABCDEF" for c in token) / n,
        known.letter_pairs(token),
        known.coverage(token),
        sum(c in "aeiou" for c in letters) / max(1, len(letters)),
        float(token.count("/") + token.count("\\")),
        float(token.count(".")),
        float(token.count("@")),
        float(bool(re.search(r"\.[A-Za-z]{2,4}\d?$", token))),
        float(len(near[0])),
        float(len(near[1])),
        float(sum(w.lower() in known.words for w in near[0])),
        float(sum(w.lower() in known.words for w in near[1])),
    ]


def _parts(name: str) -> set[str]:
    return {p.lower() for p in _NAME_PART.findall(name)}


def rule(token: str, name: str, before: str) -> tuple[str, int | None]:
    """Kind of a candidate and its label by format and name: 1 a secret, 0 harmless, None unknown.

    Formats of keys come first, then the name that a value is given to, and only then the formats of what is no secret.
    """
    for kind, pattern in _KNOWN:
        if pattern.fullmatch(token):
            return kind, 1
    if _STAND_IN.fullmatch(token):
        return "harmless", 0
    parts = _parts(name)
    if parts & SECRET_NAMES and not parts & HARMLESS_NAMES:
        return ("announced", None) if token.isalpha() else ("assigned_secret", 1)
    last = {w.lower() for w in _WORD.findall(before)[-1:]}
    if (parts or last) & HARMLESS_NAMES or _HARMLESS.fullmatch(token):
        return "harmless", 0
    return "unknown", None


def candidates(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, token, name, before, after) of every candidate, in code points, left to right, without overlaps.

    name is what the value is assigned to, or empty; before ends where the assignment starts.
    """
    spans: list[tuple[int, int, int, str]] = [(m.start(), m.end(), m.start(), "") for m in _BLOCK.finditer(text)] if "-----BEGIN" in text else []
    for m in _ASSIGNED.finditer(text):
        named = _NAME.search(text, max(0, m.start() - 64), m.start())
        name = named[1] if named else ""
        value = m[1].rstrip(".,;:)]}>")
        if value.startswith("//") or len(value) < 4:
            continue
        secret = bool(_parts(name) & SECRET_NAMES)
        if secret or name and len(value) >= 8 and any(c.isdigit() for c in value) and re.fullmatch(r"[A-Za-z0-9_\-./+@%]+={0,2}", value):
            spans.append((m.start(1), m.start(1) + len(value), named.start(1), name))
    for m in _SPOKEN.finditer(text):  # a name, a blank and a value of letters and digits
        value = m[2].rstrip(".,;:)]}>")
        if len(value) >= 8:
            spans.append((m.start(2), m.start(2) + len(value), m.start(1), m[1].replace(" ", "_").removesuffix("s")))
    taken, at = sorted(spans), 0
    for m in _RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        token = m[0].rstrip(".:,-")
        if not (token.isalpha() and len(token) < 28) and len(token) >= 8:
            spans.append((m.start(), m.start() + len(token), m.start(), ""))
    out, last = [], 0
    for start, end, first, name in sorted(spans):
        if start >= last:
            out.append((start, end, text[start:end], name, text[max(0, first - 48) : first], text[end : end + 32]))
            last = end
    return out


class Forest:
    """A trained forest as arrays of nodes; a leaf's children are itself."""

    def __init__(self, described: str):
        """described: the text that Spark ML gives of its trees."""
        self.feature, self.bound, self.low, self.high, self.vote = [], [], [], [], []
        self.roots: list[int] = []
        lines = [x.strip() for x in described.splitlines()]
        at = 0

        def node() -> int:
            nonlocal at
            k, line = len(self.feature), lines[at]
            at += 1
            for column, value in ((self.feature, 0), (self.bound, 0.0), (self.low, k), (self.high, k), (self.vote, 0.0)):
                column.append(value)
            if line.startswith("Predict:"):
                self.vote[k] = float(line.split(":")[1])
                return k
            m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
            self.feature[k], self.bound[k] = int(m[1]), float(m[2])
            self.low[k] = node()
            at += 1  # the matching Else
            self.high[k] = node()
            return k

        while at < len(lines):
            if lines[at].startswith("Tree "):
                at += 1
                self.roots.append(node())
            else:
                at += 1
        for name in ("feature", "bound", "low", "high", "vote"):
            setattr(self, name, np.array(getattr(self, name)))

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """Share of trees that vote for a secret, for each row of features."""
        if not len(rows):
            return np.zeros(0)
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                down = np.where(rows[each, self.feature[at]] <= self.bound[at], self.low[at], self.high[at])
                if (down == at).all():
                    break
                at = down
            total += self.vote[at]
        return total / len(self.roots)


def findings(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row per candidate: doc_id, start and end in code points, kind and label by rule, features."""
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for start, end, token, name, before, after in candidates(text.as_py() or ""):
                    kind, label = rule(token, name, before)
                    rows.append({"doc_id": doc_id, "start": start, "end": end, "kind": kind, "label": label, "features": features(token, before, after, known)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, start int, end int, kind string, label int, features array<double>")


def trained(docs: DataFrame, labelled: DataFrame | None = None, max_findings: int = 20_000, trees: int = 20, depth: int = 8, vocabulary: str | None = None) -> Forest | None:
    """The forest, or None without findings of both labels; labelled: doc_id, start, end and label of checked findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    found = findings(docs, vocabulary)
    if labelled is not None:
        found = found.drop("label").join(labelled.select("doc_id", "start", "end", "label"), ["doc_id", "start", "end"])
    known = written(found.where("label IS NOT NULL"), "findings")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    each = F.lit(0.0)
    for label, n in counts.items():
        each = F.when(F.col("label") == label, min(1.0, max_findings / 2 / n)).otherwise(each)
    draw = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(draw < each).select(array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label")).coalesce(2)
    model = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=17, subsamplingRate=0.8).fit(sample)
    return Forest(model.toDebugString)


def judged(text: str | None, forest: Forest | None, known: Dictionary, threshold: float) -> list[tuple[int, int, str, int | None, float, bool]]:
    """(start, end, kind, label, probability, secret) of a text's candidates."""
    found = candidates(text or "")
    named = [rule(token, name, before) for _, _, token, name, before, _ in found]
    rows = np.array([features(token, before, after, known) for _, _, token, _, before, after in found])
    chance = forest.probability(rows) if forest else np.array([float(label == 1) for _, label in named])
    return [(start, end, kind, label, p, label == 1 or (forest is not None and p >= threshold)) for (start, end, *_), (kind, label), p in zip(found, named, chance.tolist(), strict=True)]


def scan(docs: DataFrame, labelled: DataFrame | None = None, max_findings: int = 20_000, threshold: float = 0.5, vocabulary: str | None = None) -> DataFrame:
    """A row per candidate: doc_id, start, end, kind, label, the forest's probability, and the verdict (secret)."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, labelled, max_findings, vocabulary=vocabulary))
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("label", pa.int32()), ("probability", pa.float64()), ("secret", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary(vocabulary)
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in judged(t.as_py(), sent.value, known, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(arrow), arrow.types, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, start int, end int, kind string, label int, probability double, secret boolean")


def summary(docs: DataFrame, labelled: DataFrame | None = None, max_findings: int = 20_000, threshold: float = 0.5, vocabulary: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_candidates, n_secrets, first_start (of a secret), score (the highest) and kinds of its secrets."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, labelled, max_findings, vocabulary=vocabulary))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_candidates", pa.int64()), ("n_secrets", pa.int64()), ("first_start", pa.int32()), ("score", pa.float64()), ("kinds", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary(vocabulary)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = judged(text.as_py(), sent.value, known, threshold)
                secret = [x for x in found if x[5]]
                rows.append((i, len(found), len(secret), secret[0][0] if secret else None, max((x[4] for x in found), default=0.0), ",".join(sorted({x[2] for x in secret}))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(arrow), arrow.types, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_candidates long, n_secrets long, first_start int, score double, kinds string")


def masked(docs: DataFrame, mark: str = "[SECRET]", labelled: DataFrame | None = None, max_findings: int = 20_000, threshold: float = 0.5, vocabulary: str | None = None) -> DataFrame:
    """docs with every secret replaced by mark, in the scan; n_chars follows the new text; all rows and columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, labelled, max_findings, vocabulary=vocabulary))
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def safe(text: str | None, known: Dictionary) -> str | None:
        found = [x for x in judged(text, sent.value, known, threshold) if x[5]]
        for start, end, *_ in reversed(found):
            text = text[:start] + mark + text[end:]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary(vocabulary)
        for batch in batches:
            columns, old = list(batch.columns), batch.column(at).to_pylist()
            new = [safe(t, known) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), old, new, strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)
