"""Operators 11 to 13 against plain loops, on made rows with nulls, ties, repeats, extra columns and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from freshet.llm.lexical_search import lexical_search
from freshet.llm.prefix_trie import Parentheses, conversation_trie
from freshet.llm.quality_rules import STOP_WORDS
from freshet.llm.spot_signatures import CHAIN, _block, spot_signatures

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, rank int, item_id string"
TALK = "conv_id long, turn int, role string, text string, node string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ranking(docs, items, k=50):
    tf = [(d, Counter(TERM.findall(low(t)))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    n, total = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(TERM.findall(low(t)))
    out = []
    for i, terms in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        found = []
        for d, c in tf:
            m = 50 + 50 * c.total() * n // total
            score = sum(x * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, x in w.items() if c[t])
            if score > 0:
                found.append((-score, -math.inf if d is None else d, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_a_full_ranking(spark):
    rng = np.random.default_rng(3)
    words = ["the", "Ábc", "abc", "ABC", "x1", "naïve", "x", "end", *(f"w{i}" for i in range(60))]
    text = lambda n: " ".join(rng.choice(words, n)) + "."
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(400, "the the the"), (400, "the the the"), (None, "abc abc"), (401, None), (402, ""), (403, "--- ;"), (404, text(9000)), (405, "abc"), (406, "ABC")]
    items = [(1, "abc, the X1"), (2, None), (3, "zzz"), (4, text(30)), (4, "naïve"), (5, "the the"), (None, "abc")]
    df = spark.createDataFrame([Row(doc_id=d, text=t, rank=7, item_id="x") for d, t in docs], DOCS)
    asked = spark.createDataFrame([Row(item_id=i, text=t, score=1.5) for i, t in items], "item_id long, text string, score double")
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical_search(df, asked).collect()), key=str)
    assert got == ranking(docs, items)
    few = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical_search(df, asked, 3).collect()), key=str)
    assert few == ranking(docs, items, 3)
    assert lexical_search(df.limit(0), asked).count() == 0 and lexical_search(df, asked.limit(0)).count() == 0


def test_search_over_several_segments(spark, monkeypatch):
    """Bounds close segments and strata, results stay whole: segments of a few documents instead of thousands."""
    import freshet.llm.lexical_search as ls

    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(3, 40))) % 90)) for i in range(600)]
    docs += [(600 + i, "rare pair of words w1") for i in range(70)]
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 90, 12)) + " rare pair") for i in range(9)]
    kernel, build = ls._segments, ls.LexicalIndex.build.__func__

    def small(batches):
        ls.SEGMENT_DOCS = 25
        yield from kernel(batches)

    monkeypatch.setattr(ls, "_segments", small)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = build(ls.LexicalIndex, df)
    assert index.index.select("segment").distinct().count() > 20
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in index.search(spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == ranking(docs, items)


def spots(text):
    known = {*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}
    words = TERM.findall(text)
    content = [w for w in words if w not in known]
    out = {" ".join(["^", *content[:CHAIN]])} if words else set()
    for i, w in enumerate(words):
        rest = [x for x in words[i:] if x not in known]
        if w in known and rest:
            out.add(" ".join([w, *rest[:CHAIN]]))
    return " ".join(sorted({hashlib.md5(x.encode()).hexdigest()[:8] for x in out}))


def like(a, b):
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    value = len(x & y) / len(x | y)
    return value if value >= 0.1 else 0.0


def test_fingerprints_equal_plain_loops(spark):
    rng = np.random.default_rng(8)
    words = [*STOP_WORDS[:30], "The", "é1", "ß", *(f"c{i}" for i in range(40))]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(int(i), text(int(rng.integers(0, 80)))) for i in rng.permutation(200) * 3] + [(700, "the"), (701, "the of"), (702, None), (703, " ."), (704, "añb, le der C; x" * 300), (5000, text(20))]
    df = spark.createDataFrame([Row(doc_id=d, text=t, rank=1, item_id="key") for d, t in docs], DOCS)
    rows = sorted(((d, t or "") for d, t in docs), key=lambda x: -x[0])
    want = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        want.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), spots(t), spots(edited), like(spots(t), spots(edited)), like(spots(t), spots(after))))
    got = sorted(tuple(r) for r in spot_signatures(df).collect())
    assert got == sorted(want)
    assert spot_signatures(df.limit(0)).count() == 0
    (one,) = spot_signatures(spark.createDataFrame([(None, "the cat and the dog")], "doc_id long, text string")).collect()
    assert one["doc_id"] is None and one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"the cat anthe cat a").hexdigest()


def test_repeated_ids_are_split_in_order(spark):
    """A doc_id of a third of all rows fills several blocks, and blocks keep the order."""
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("key"), F.xxhash64("id").alias("tie"))
    cuts = sorted((df.agg(F.percentile_approx("key", [i / 30 for i in range(1, 30)], 100000).alias("c")).first()["c"]), reverse=True)
    rows = df.withColumn("b", _block(F.col("key"), F.col("tie"), cuts)).collect()
    blocks = [r["b"] for r in sorted(rows, key=lambda r: (-r["key"], r["tie"]))]
    assert blocks == sorted(blocks) and max(Counter(blocks).values()) < 200


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    full = {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    own_gain = {p: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p, m in nodes.items()}
    leaves, gain = Counter(), Counter()
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            gain[p[:d]] += own_gain[p]
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(p))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], gain[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [1, 9, 1 << 18])
def test_trie_equals_plain_loops(spark, shard):
    rng = np.random.default_rng(11)
    rows = []
    for c in range(0, 130):
        if c in (40, 61):
            continue
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "a b  c" if rng.random() < 0.5 else f"w{int(rng.integers(0, 3))} x"))
    rows += [(200, None, None, None), (200, 0, None, "z"), (200, 0, None, "y"), (200, 0, None, "y"), (None, 0, "user", "lost"), (201, 3, "user", "a b  c")]
    rows += [(1000 + i, t, "system", "same") for i in range(60) for t in range(2)] + [(1100, t, "user", "long chain") for t in range(150)]
    df = spark.createDataFrame([Row(conv_id=c, turn=t, role=r, text=x, node="n") for c, t, r, x in rows], TALK)
    got = sorted((tuple(r) for r in conversation_trie(df, shard).collect()), key=str)
    assert got == trie(rows)
    assert conversation_trie(df.limit(0), shard).count() == 0


def test_closing_parentheses():
    rng = np.random.default_rng(1)
    for n in (1, 5, 64, 300, 5000):
        bits, depth = [], 0
        opened = 0
        while opened < n or depth:
            if opened < n and (depth == 0 or rng.random() < 0.55):
                bits.append(1)
                opened, depth = opened + 1, depth + 1
            else:
                bits.append(0)
                depth -= 1
        bits = [1, *bits, 0]
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        par = Parentheses(np.array(bits, bool))
        opens = np.flatnonzero(par.bits)
        closes = par.findclose(opens)
        assert closes.tolist() == [want[i] for i in opens.tolist()]
        count = [sum(bits[k] and not bits[k + 1] for k in range(a, b)) for a, b in zip(opens, closes, strict=True)] if n <= 300 else None
        assert count is None or par.leaves(opens, closes).tolist() == count


def test_near_duplicates_go_by_row_where_ids_repeat(spark):
    from freshet.llm.minhash_dedup import deduplicated

    a, b = "one two three four five six seven eight nine ten", "alpha beta gamma delta epsilon zeta eta theta iota"
    rows = [(3, a), (7, a), (7, b), (7, b), (8, None), (8, ""), (None, a), (9, b + " kappa"), (10, "solo words that stand here alone now")]
    got = sorted(((r["doc_id"], r["text"]) for r in deduplicated(spark.createDataFrame([Row(doc_id=d, text=t, row=1) for d, t in rows], "doc_id long, text string, row int")).collect()), key=str)
    assert got == sorted([(3, a), (7, b), (8, None), (8, ""), (None, a), (10, "solo words that stand here alone now")], key=str)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYZZZZZZZZKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYZZZZZZZZKEY"),
        ("password: correct-horse-battery", "correct-horse-battery"),
        ("password=12345678 and more", "12345678"),
        ("the password S3cr3t!pass#99 was lost", "S3cr3t!pass#99"),
    ],
)
def test_secret_names_win_over_shapes(spark, text, value):
    from freshet.llm.secret_scan import masked

    rows = [(i, t) for i, t in enumerate([text, "version: 1.2.3-beta", "commit = 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567", "see https://a.org/b/c1/d2e3f4 or path/to/file_12.txt"])]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source="s", n_chars=len(t)) for i, t in rows])
    out = {r["doc_id"]: r["text"] for r in masked(docs).collect()}
    assert value not in out[0] and all(out[i] == t for i, t in rows[1:])


def test_index_rows_leave_a_worker_in_slices(monkeypatch):
    import pyarrow as pa
    import pyspark

    import freshet.llm.lexical_search as ls

    monkeypatch.setattr(ls, "INDEX_ROWS", 4)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    terms = [[f"t{k + i}" for i in range(10)] for k in range(3)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3], pa.int64()), "m": pa.array([50, 50, 60], pa.int32()), "terms": pa.array(terms), "tfs": pa.array([[1] * 10] * 3, pa.list_(pa.int32()))})
    sent = list(ls._segments(iter([batch])))
    assert max(b.num_rows for b in sent) == 4 and sum(b.num_rows for b in sent) == 1 + 12
