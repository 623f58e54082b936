"""Rule-based quality filter: a table of thresholds compiled into one projection of built-in functions.

Every figure is computed inside Spark's own expressions; there is no user function, join or shuffle. The repeated-word count
sorts a document's 5-word windows only where two of them are equal, so the usual document costs one pass over its words.

Defined results: a null or empty text has no words (all counts 0, base_failed true); a very long text is one row and is
handled whole; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import WORD_GAP

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of the languages served.
STOP_WORDS = """
the of and to in is was that for on with as it be are this by at an not
der die das und ist nicht ein eine zu von mit den dem auf im sich des
le la les de et un une que qui dans pour est pas en du des au
el los las una y con por se del lo como su para
""".split()


@dataclass(frozen=True)
class Rule:
    """A document passes while low <= metric <= high; documents of fewer than min_words words are exempt."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table of the method; the base rules stand in front of it.
RULES = (
    Rule("n_words", high=10_000_000),
    Rule("mean_word", low=1.5, high=40.0),
    Rule("symbol_ratio", high=0.25),
    Rule("dup_line_ratio", high=0.5),
    Rule("stop_ratio", low=0.004, min_words=50),
)


def _windows(words: Column, n: Column) -> Column:
    at = lambda i, k: F.get(words, i + k)
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort (hash, place), keep the tied, add up the union."""

    def tied(s: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        return F.filter(F.transform(s, lambda x, i: F.when(same(x, i + 1) | F.when(i > 0, same(x, i - 1)).otherwise(False), x["p"])), lambda p: p.isNotNull())

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    places = F.sort_array(F.flatten(F.transform(F.array(ordered), tied)))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")), lambda a: a["sum"])


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one boolean expression."""
    ok = F.lit(True)
    for r in rules:
        x, good = F.col(r.metric), F.lit(True)
        if r.low is not None:
            good = good & (x >= r.low)
        if r.high is not None:
            good = good & (x <= r.high)
        ok = ok & (good | (F.col("n_words") < r.min_words))
    return ok


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """doc_id, the counts, the ratios that the rules read, base_failed and kept; one row per input row."""
    known = [*stop_words, *[w.capitalize() for w in stop_words]]
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.col("t")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select("doc_id", text.alias("t"))
    two = one.select("doc_id", "t", F.array_remove(F.split("t", WORD_GAP), "").alias("words"), lines.alias("lines"), (F.octet_length("t") - F.octet_length(bare)).cast("long").alias("n_symbols"))
    three = two.select("doc_id", "n_symbols", "words", "lines", F.size("words").alias("n"), F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"), F.size(F.filter("words", lambda w: w.isin(known))).alias("n_stop"))
    four = three.select("doc_id", "n_symbols", "word_chars", "n_stop", F.col("n").cast("long").alias("n_words"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _windows(F.col("words"), F.col("n")).alias("w"))
    repeat = F.when(F.size(F.array_distinct("w")) < F.size("w"), _covered(F.col("w"))).otherwise(F.lit(0).cast("long"))
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    five = four.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), per("word_chars", "n_words").alias("mean_word"), per("n_symbols", "word_chars").alias("symbol_ratio"), per("n_dup_lines", "n_lines").alias("dup_line_ratio"), per("n_stop", "n_words").alias("stop_ratio"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return five.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
