"""SpotSigs: fingerprints of chains of content words that follow common-word anchors.

A spot is an anchor (a common function word, or the beginning of the text) with the next content words after it; function words in
between are passed over. The set of a text's spots is its fingerprint: pages that share their prose share spots, whatever frames it.
Spots are made in one pass with array functions: all words before an anchor are anchors or content, so the k-th anchor, at place i,
is followed by the content words from i - k on.

Two fingerprints are compared by Jaccard with the bounds of the method. Sets are parted by their lengths into classes whose bounds grow
by 1 / least: sets of classes that are not neighbours cannot reach `least` and are not compared; nor are those in neighbouring
classes whose lengths alone rule it out; equal sets are not counted either. Only the rest is intersected.

A document's neighbour in order of doc_id comes from one shuffle: ids are cut into even blocks at quantiles (an id that fills several
blocks is split among them by a hash of its texts), each block gets its follower's first row as one more, and a window inside the block
looks one row ahead. No document is joined, and no order runs through a single task.

Defined results: a null text is an empty one, an empty text (or one of separators alone) has an empty fingerprint, which is like
another empty one (1) and like no other (0); rows of one doc_id follow each other by a hash of their texts, equal rows in any order; a
null doc_id comes last; a single document follows itself; an empty table gives an empty result; a text is one row, however long; other
columns are ignored. A likeness below `least` is given as 0.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import written
from freshet.llm.quality_rules import STOP_WORDS

#: Separators of words: ASCII but for letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Content words of a chain.
CHAIN = 3
#: Hexadecimal digits of a spot.
DIGITS = 8
LEAST = 0.1
NULL_ID = -(1 << 63)


def spots(text: Column, anchors: list[str] = STOP_WORDS, chain: int = CHAIN) -> Column:
    """The sorted distinct spots of a text, as an array of short hashes."""
    known = sorted({*anchors, *(w.capitalize() for w in anchors)})
    hashed = lambda *words: F.substring(F.md5(F.concat_ws(" ", *words)), 1, DIGITS)

    def parted(ws: Column) -> Column:
        content = F.filter(ws, lambda w: ~w.isin(known))
        marks = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(known), F.struct(w.alias("w"), i.alias("i")))), lambda a: a.isNotNull())
        return F.struct(content.alias("content"), marks.alias("marks"), F.size(ws).alias("n"))

    def chained(p: Column) -> Column:
        after = lambda a, k: F.when(a["i"] - k < F.size(p["content"]), hashed(a["w"], F.slice(p["content"], a["i"] - k + 1, chain)))
        found = F.filter(F.transform(p["marks"], after), lambda h: h.isNotNull())
        head = F.when(p["n"] > 0, F.array(hashed(F.lit("^"), F.slice(p["content"], 1, chain)))).otherwise(F.array().cast("array<string>"))
        return F.concat(head, found)

    # Each step sees the one before as a lambda's variable, so that it is computed once for a text.
    words = F.array(F.array_remove(F.split(text, GAP), ""))
    return F.sort_array(F.array_distinct(F.flatten(F.transform(F.transform(words, parted), chained))))


def fingerprint(text: Column, anchors: list[str] = STOP_WORDS, chain: int = CHAIN) -> Column:
    """The spots as one string, separated by blanks; empty for a text without words."""
    return F.concat_ws(" ", spots(text, anchors, chain))


def _set(print_: Column) -> Column:
    return F.when(print_ == "", F.array().cast("array<string>")).otherwise(F.split(print_, " "))


def length_class(size: Column, least: float) -> Column:
    """The class of a set's length: classes grow by 1 / least, so that sets as like as `least` lie in the same or in neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / math.log(1 / least) + 1e-9)


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard of two fingerprints, 0 where it lies below least; bounds by the sets' lengths come first."""

    def compared(p: Column) -> Column:
        x, y = F.size(p["a"]), F.size(p["b"])
        far = F.abs(length_class(x, least) - length_class(y, least)) > 1
        short = F.least(x, y) < F.lit(least) * F.greatest(x, y)
        both = F.size(F.array_intersect(p["a"], p["b"]))
        value = both.cast("double") / (x + y - both)
        return F.when(far | short, F.lit(0.0)).otherwise(F.when(value >= least, value).otherwise(F.lit(0.0)))

    one = F.array(F.struct(_set(a).alias("a"), _set(b).alias("b")))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.get(F.transform(one, compared), F.lit(0)))


def _block(key: Column, tie: Column, cuts: list[int]) -> Column:
    """The block of a key among falling cuts; a key that is a cut, once or more, is split among the blocks beside it by tie."""
    step = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    table = F.from_json(F.lit(json.dumps(chunks)), "array<array<bigint>>")
    lasts = F.from_json(F.lit(json.dumps([c[-1] for c in chunks])), "array<bigint>")

    def above(test) -> Column:
        full = F.size(F.filter(lasts, test))
        return full * step + F.size(F.filter(F.coalesce(F.get(table, full), F.array().cast("array<bigint>")), test))

    low = above(lambda x: x > key)
    spread = above(lambda x: x >= key) - low + 1
    share = F.floor((tie / F.lit(2.0**64) + 0.5) * spread)  # falls in the order of ties
    return (low + F.least(share, spread - 1)).cast("int")


def followed(rows: DataFrame, key: str, value: str, derived: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """rows (key long, tie long, value) with the derived columns, and next_<name> of value and derived: those of the next row.

    Rows go by falling key and rising tie; the last one is followed by the first. What is derived is computed once a row.
    """
    spark = rows.sparkSession
    if blocks is None:
        blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = rows.agg(F.percentile_approx(key, shares, max(10_000, 20 * blocks)).alias("c")).first()["c"] if shares else []
    if cuts is None:
        return rows.withColumns(derived).withColumns({f"next_{c}": F.col(c) for c in [value, *derived]}).limit(0)
    placed = rows.withColumn("block", _block(F.col(key), F.col("tie"), sorted(cuts, reverse=True)) if cuts else F.lit(0))
    order = F.struct(F.col(key).alias("k"), F.bitwise_not("tie").alias("t"))
    heads = sorted((r["block"], r["o"]["k"], ~r["o"]["t"]) for r in placed.groupBy("block").agg(F.max(order).alias("o")).collect())  # one row a block
    after = [(b, *heads[(i + 1) % len(heads)][1:]) for i, (b, _, _) in enumerate(heads)]
    wanted = spark.createDataFrame(after, "block int, k long, t long")
    edge = rows.join(F.broadcast(wanted), (F.col(key) == F.col("k")) & (F.col("tie") == F.col("t"))).drop("k", "t")  # as many rows as blocks
    edge = written(edge.groupBy("block").agg(*[F.first(c).alias(c) for c in rows.columns]), "edges")
    laid = placed.withColumn("extra", F.lit(0)).unionByName(edge.withColumn("extra", F.lit(1)))
    by = Window.partitionBy("block").orderBy("extra", F.desc(key), "tie")
    return laid.withColumns(derived).withColumns({f"next_{c}": F.lead(c).over(by) for c in [value, *derived]}).where("extra = 0").drop("extra", "block")


def spot_signatures(docs: DataFrame, anchors: list[str] = STOP_WORDS, chain: int = CHAIN, least: float = LEAST) -> DataFrame:
    """doc_id, n_chars, fingerprint, the digest and fingerprint of the edited text, and likeness to it and to the next document.

    The edited text has the last half of its characters replaced by the first as many of the next document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    pairs = followed(rows, "key", "text", {"fingerprint": fingerprint(F.col("text"), anchors, chain)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.select("key", "fingerprint", "next_fingerprint", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    printed = edited.select("key", "fingerprint", "next_fingerprint", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), anchors, chain).alias("edited_fingerprint"))
    return printed.select(F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), least).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), least).alias("near_next"))
