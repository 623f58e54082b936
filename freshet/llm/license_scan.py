"""License scan: Aho-Corasick over normalised words, and a shunting-yard parser for licence expressions.

A text is lower-cased (A-Z only) and cut into words of digits, letters and non-ASCII characters; the automaton then runs over
the words joined by blanks, with a blank at each end, so that a phrase matches whole consecutive words only. Identifier tags
(``SPDX-License-Identifier:``) are among its phrases; the expression after one is read from the raw text at that place, parsed and
evaluated.

Defined results: a null or empty text has no words, no labels and score 0; a malformed expression (unclosed, wrapped onto another
line, an operator without a name) yields the labels of the names read up to where it breaks, or of the first one; very long texts are scanned whole; repeated rows give repeated results; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the base contract and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Further notices, with the share of trust that a match gives.
NOTICES = {
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license version 2": ("mpl-2", 0.9),
    "mozilla public license v 2 0": ("mpl-2", 0.9),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl-1", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "bsd 2 clause": ("bsd-2-clause", 0.8),
    "bsd 3 clause": ("bsd-3-clause", 0.8),
    "permission to use copy modify and or distribute this software": ("isc", 0.8),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "licensed under the apache license": ("apache", 0.8),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "cc0 1 0": ("cc0", 0.7),
    "dedicated to the public domain": ("public-domain", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.5),
}

# Licences that a default policy accepts.
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "bsl-1.0"}

#: Words of an identifier tag, and what it is in the raw text with its expression.
TAG_WORDS = "spdx license identifier"
_TAG = re.compile(rb"SPDX-License-Identifier:[ \t]*([^\r\n]+)", re.IGNORECASE)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.\-+:]*")
_RANK = {"or": 1, "and": 2, "with": 3}
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


class Malformed(ValueError):
    """An expression that breaks off or makes no sense; names are the licences read up to there."""

    def __init__(self, why: str, names: set[str]):
        super().__init__(why)
        self.names = names


def parse(expression: str) -> list[str]:
    """The expression in postfix order (shunting-yard); Malformed, with the names so far, if it is none.

    Reading stops at the first name that cannot continue the expression, as prose may follow a tag on its line.
    """
    out: list[str] = []
    stack: list[str] = []
    names: list[str] = []
    operand, excepted = True, False
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK:
            if operand and not names:
                first = [t.lower() for t in _TOKEN.findall(expression) if t.lower() not in _RANK and t not in "()"][:1]
                raise Malformed(f"{token} without a licence before it", set(first))
            if operand:
                raise Malformed(f"{token} without a licence before it", set(names))
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand, excepted = True, low == "with"
        elif token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand:
                raise Malformed("empty brackets", set(names))
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            if not operand:
                break
            out.append(low)
            if not excepted:
                names.append(low)
            operand, excepted = False, False
    if operand:
        raise Malformed("the expression ends early", set(names))
    while stack:
        if (top := stack.pop()) == "(":
            raise Malformed("a bracket is not closed", set(names))
        out.append(top)
    return out


def evaluate(postfix: list[str], accepted: set[str] = PERMISSIVE) -> bool:
    """Whether the accepted licences satisfy the expression; an exception (with) never narrows its licence."""
    stack: list[bool] = []
    for token in postfix:
        if token in _RANK and len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if token == "or" else a if token == "with" else a and b)
        else:
            stack.append(token.removesuffix("+") in accepted)
    return bool(stack and stack[-1])


def licences(postfix: list[str]) -> set[str]:
    """The licence names of a postfix expression, without exceptions."""
    stack: list[set[str]] = []
    for token in postfix:
        if token in _RANK and len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            stack.append(a if token == "with" else a | b)
        else:
            stack.append({token})
    return set().union(*stack)


def normalise(text: str) -> list[bytes]:
    """Lower-cased words of a text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def automaton():
    """Aho-Corasick over all phrases and the tag; a phrase carries its word count, base label, label and trust."""
    import ahocorasick

    found: dict[str, tuple[int, str | None, str, float]] = {p: (len(p.split()), None, label, trust) for p, (label, trust) in NOTICES.items()}
    found |= {p: (len(p.split()), label, label, 1.0) for p, label in BASE_PHRASES.items()}
    found[TAG_WORDS] = (len(TAG_WORDS.split()), None, "", 0.0)  # no label of its own: its expression has them
    a = ahocorasick.Automaton()
    for phrase, value in found.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, *value))
    a.make_automaton()
    return a


def expressions(text: str, tags: list[int]) -> Iterator[str]:
    """The expressions of the tags that the automaton found at these words, left to right, from the raw text."""
    if not tags:
        return
    raw, wanted = text.encode("utf-8", "surrogatepass"), set(tags)
    for k, word in enumerate(_WORD.finditer(raw)):
        if k in wanted and (m := _TAG.match(raw, word.start())):
            yield m[1].decode("utf-8", "surrogatepass")


def scan(text: str | None, auto) -> dict:
    """All findings in one text."""
    text = text or ""
    words = normalise(text)
    line = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
    base: list[int] = []
    base_labels, labels, trust, spans = set(), set(), 0.0, []
    tags: list[int] = []
    places = None
    for end, (size, n, own, label, weight) in auto.iter(line):
        if places is None:  # of the blanks, so that a match's first word is found by search
            places = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        start = int(np.searchsorted(places, end - size + 1))
        if not label:
            tags.append(start)
            continue
        if own:
            base.append(start)
            base_labels.add(own)
        labels.add(label)
        trust = max(trust, weight)
        spans.append((start, n, label))
    allowed = None
    for expression in expressions(text, tags):
        try:
            postfix = parse(expression)
            names, good = licences(postfix), evaluate(postfix)
        except Malformed as e:
            names, good = e.names, False
        labels |= names
        trust = 1.0 if names else trust
        allowed = good if allowed is None else allowed and good
    return {"n_words": len(words), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None), "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": trust, "allowed": allowed, "spans": [{"word": a, "n": b, "label": c} for a, b, c in spans]}


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, allowed boolean, spans array<struct<word: long, n: long, label: string>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("allowed", pa.bool_()), ("spans", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64()), ("label", pa.string())])))])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = automaton()
    for batch in batches:
        rows = [{"doc_id": i, **scan(t, auto)} for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, first and last place, labels, trust, the policy's verdict on tags, and all spans."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan_batches, _SCHEMA)
