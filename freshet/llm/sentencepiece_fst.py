"""SentencePiece encoding and decoding with weighted finite-state transducers.

A model is compiled into machines: the normaliser (the model's character map as a trie of longest matches, then a machine of blanks
to marks), the pieces (a trie whose leaves emit ids), the byte fallback (a path of byte ids for every character outside the
vocabulary) and, for byte-pair models, a pair filter. They are composed lazily with each input, and the tropical-semiring shortest
path through the composition is the encoding. Unigram models weigh a piece by its negative log probability. For byte-pair models a
sequence is the result of the merges exactly if every two neighbouring pieces are the result of merging their own concatenation; the
filter's states are the last pieces, its arcs just these pairs, and each arc costs 1.

Texts are cut where no piece spans a place (the compiler notes which neighbouring characters pieces hold; first before marks, then
inside the parts), and the paths of parts are kept in a bounded table per worker.

Defined results: a null or empty text has no ids; long texts are encoded whole; repeated rows give equal rows; an empty table gives an
empty one; other columns are ignored. Models that treat the mark as a suffix, or words and single characters as pieces, are refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_LEAF = ""
_KEPT = 700_000
_PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: integers, and bytes of what has a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, raw[at : at + n]
            at += n


def character_map(raw: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie over UTF-8, and the replacements, each closed by a zero byte."""
    size = struct.unpack("<I", raw[:4])[0]
    units, texts = np.frombuffer(raw[4 : 4 + size], "<u4").astype(np.int64), raw[4 + size :]
    labels, letters = units & 0x800000FF, np.arange(256)
    offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    found: dict[str, str] = {}
    stack = [(int(offset(units[0])), b"")]
    while stack:
        at, key = stack.pop()
        places = at ^ letters
        inside = places < len(units)
        for c in letters[inside][labels[places[inside]] == letters[inside]].tolist():
            if c == 0:
                continue  # label 0 marks a value
            unit = int(units[at ^ c])
            below = (at ^ c) ^ int(offset(unit))
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                found[(key + bytes([c])).decode()] = texts[start : texts.index(b"\0", start)].decode()
            stack.append((below, key + bytes([c])))
    return found


class Normaliser:
    """The machine in front: longest matches of the character map, then blanks to marks, with a mark in front."""

    def __init__(self, rules: dict[str, str], fixed: list[str], prefix: bool, squeeze: bool):
        """fixed: pieces that the user defined, which no rule changes."""
        self.prefix, self.squeeze = prefix, squeeze
        self.trie: dict = {}
        for key, out in [*rules.items(), *((p.replace(MARK, " "), p.replace(MARK, " ")) for p in fixed if rules)]:
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[_LEAF] = out
        first = "".join(map(re.escape, self.trie))
        self.skip = re.compile(f"[^{first}]+") if first else None

    def mapped(self, text: str) -> str:
        out, at, n = [], 0, len(text)
        while at < n:
            if m := self.skip.match(text, at):
                out.append(m[0])
                at = m.end()
                continue
            node, end, best = self.trie.get(text[at]), at + 1, None
            while node is not None:
                if _LEAF in node:
                    best = (end, node[_LEAF])
                node = node.get(text[end]) if end < n else None
                end += 1
            end, new = best or (at + 1, text[at])
            out.append(new)
            at = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.trie:
            text = self.mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        text = text.replace(" ", MARK)
        return MARK + text if text and self.prefix else text


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        prefix, squeeze, model_type, rules = True, True, 1, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, 1))
            elif number == 2:
                f = dict(_fields(value))
                model_type = f.get(3, 1)
                if f.get(24) or model_type not in (1, 2):
                    raise ValueError("only unigram and byte-pair models with the mark in front are supported")
            elif number == 3:
                f = dict(_fields(value))
                rules = character_map(f[2]) if f.get(2) else {}
                prefix, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        self.bpe, self.prefix = model_type == 2, prefix
        self.users = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 4}
        self.normalise = Normaliser(rules, list(self.users), prefix, squeeze)
        self.unknown = self.kinds.index(2)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 1 or k == 4 and not self.bpe}
        usual = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == 1]
        self.costs = [1.0 if self.bpe else 0.1 - len(p) * max(usual, default=0.0) if k == 4 else -s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True)]
        self.outside = 1.0 if self.bpe else 10.0 - min(usual, default=0.0)
        self.trie: dict = {}
        for p, i in self.ids.items():
            if self.bpe and self.merged(p) != [p]:
                continue  # no result of merges holds it
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[_LEAF] = i
        self.cuts = not any(MARK in p.lstrip(MARK) for p in [*self.ids, *self.users])
        #: In byte-pair models a piece of the user's stands alone before anything merges.
        self.alone_first = re.compile("(" + "|".join(re.escape(p) for p in sorted(self.users, key=len, reverse=True)) + ")") if self.bpe and self.users else None
        self.alone = ["" if k == 3 else p for p, k in zip(self.pieces, self.kinds, strict=True)]
        for b, i in self.bytes.items():
            self.alone[i] = chr(b) if b < 128 else None
        #: Neighbouring characters inside pieces: no path crosses a place between two others but at a state that forgets what was before.
        self.inside = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short string, best piece first, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best[0]):
                    best = (self.scores[j], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def admits(self, left: int, right: int) -> bool:
        """The pair filter's arc: whether the merges keep the two pieces apart and whole."""
        if left < 0 or right < 0:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            known = self.merged(a + b) == [a, b]
            if len(self.pairs) < _KEPT:
                self.pairs[left, right] = known
        return known

    def shortest(self, text: str) -> list[int]:
        """The shortest path of the composition with one part of a normalised text.

        A state is a place with, in byte-pair models, the filter's last piece. States are relaxed from left to right, as every arc
        leads on, and places that no path reaches are passed over; piece -1 is the byte path of one character.
        """
        n, trie, ids, pairs, costs, bpe = len(text), self.trie, self.ids, self.pairs, self.costs, self.bpe
        states: list[dict[int, tuple] | None] = [None] * (n + 1)  # last piece -> (cost, piece, place and last piece before)
        states[0] = {-1: (0.0, -1, 0, -1)}

        def reach(end: int, piece: int, cost: float, at: int, last: int) -> None:
            key, there = piece if bpe else -1, states[end]
            if there is None:
                states[end] = {key: (cost, piece, at, last)}
            elif key not in there or cost < there[key][0]:
                there[key] = (cost, piece, at, last)

        for at in range(n):
            here = states[at]
            if here is None:
                continue
            ways = list(here.items())
            if text[at] not in ids:
                cost, last = min((state[0], last) for last, state in ways)
                reach(at + 1, -1, cost + self.outside, at, last)
            node, end = trie.get(text[at]), at
            while node is not None:
                end += 1
                if (piece := node.get(_LEAF)) is not None:
                    for last, state in ways:
                        if bpe:
                            if (ok := pairs.get((last, piece))) is None:
                                ok = self.admits(last, piece)
                            if not ok:
                                continue
                        reach(end, piece, state[0] + costs[piece], at, last)
                node = node.get(text[end]) if end < n else None
        at, path = n, []
        last = min(states[n], key=lambda k: states[n][k][0])
        while at:
            _, piece, start, before = states[at][last]
            path.append([piece] if piece >= 0 else self.fallback(text[start:at]))
            at, last = start, before
        return [i for found in reversed(path) for i in found]

    def fallback(self, character: str) -> list[int]:
        """Ids of the byte path of a character."""
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        line = self.normalise(text)
        out, kept = [], self.kept
        for stretch in self.alone_first.split(line) if self.alone_first else [line]:
            if stretch in self.users and self.bpe:
                out.append(np.array([self.users[stretch]], "<u4").tobytes())
                continue
            for part in _PARTS.findall(stretch) if self.cuts else [stretch] if stretch else []:
                ids = kept.get(part)
                if ids is None:
                    ids = self._joined_paths(part)
                    if len(kept) < _KEPT and len(part) < 40:
                        kept[part] = ids
                out.append(ids)
        found = b"".join(out)
        if not self.bytes and found:  # unknown characters next to each other are one unknown piece
            ids = np.frombuffer(found, "<u4")
            found = ids[np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))].tobytes()
        return found

    def _joined_paths(self, part: str) -> bytes:
        """Shortest paths of the stretches of a part between places that no piece spans, put together."""
        out, kept, inside, start = [], self.kept, self.inside, 0
        places = [i for i, pair in enumerate(zip(part, part[1:], strict=False), 1) if pair not in inside]
        for end in [*places, len(part)]:
            stretch = part[start:end]
            ids = kept.get(stretch)
            if ids is None:
                ids = np.array(self.shortest(stretch), "<u4").tobytes()
                if places and len(kept) < _KEPT and len(stretch) < 40:
                    kept[stretch] = ids
            out.append(ids)
            start = end
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The inverse machines: pieces, runs of bytes, marks to blanks, without the mark in front."""
        try:  # without bytes of wider characters every id has a text of its own
            text = "".join(map(self.alone.__getitem__, ids))
        except TypeError:
            text = self._joined(ids)
        return (text[1:] if self.prefix and text.startswith(MARK) else text).replace(MARK, " ")

    def _joined(self, ids: list[int]) -> str:
        out, pending = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if self.kinds[i] != 3:
                out.append(self.pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str | None = None) -> Transducer:
    """The machines of a model file, once per worker; the default is the public byte-fallback model."""
    key = path or ""
    if key not in _COMPILED:
        import public_tokenizers

        with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            _COMPILED[key] = Transducer(f.read())
    return _COMPILED[key]


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [np.frombuffer(fst.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fst.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32 and round_trip (decoding gives the text back) of every document."""
    names = ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model)
        bytes_ = np.array(sorted(fst.byte_of), np.uint32)
        lo, hi = (int(bytes_[0]), int(bytes_[-1])) if len(bytes_) else (1, 0)
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for t in batch.column(1):
                text = t.as_py() or ""
                raw = fst.encode(text)
                ids = np.frombuffer(raw, "<u4")
                for column, x in zip(out, (len(ids), int(((ids >= lo) & (ids <= hi)).sum()), zlib.crc32(raw), fst.decode(ids.tolist()) == text), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.bool_())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")
