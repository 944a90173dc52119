"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression over one text; no user function, no
shuffle.  ``let`` binds an intermediate array once, so nothing is computed
again inside a lambda.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import utf8_words

#: Words so common in running text that a text without two of them is none.
STOP_WORDS = (
    "the be to of and that have with is in it for on as was this are "
    "der die und das ist nicht ein eine mit von zu den auf "
    "le la de et les des un une que est en dans du pour "
    "el los las y del por con una se para"
).split()
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` must hold; an open side is None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are SQL over the counted columns.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.4),
    Rule("bullet_lines", "n_bullet_lines / greatest(n_lines, 1)", None, 0.9),
    Rule("cut_lines", "n_cut_lines / greatest(n_lines, 1)", None, 0.3),
)
#: Base rules, in whole numbers.
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many of ``words``, given as 64-bit hashes, lie in windows of ``width`` words that occur twice or more, the first time included."""

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            hit = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        def length(at: Column) -> Column:
            own = F.transform(at, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - x, F.lit(width))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(pairs, twice), length)

    def count(w: Column) -> Column:  # windows are hashed from their words' hashes: no window holds its words' letters
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))

    return let(words, lambda w: F.when(F.size(w) > width, count(w)).otherwise(F.lit(0).cast("long")))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per row: words, their code points, symbols, repeated lines, repeated windows, stop words and line shapes."""
    t = F.coalesce(F.col(text), F.lit(""))
    inked = lambda line: line.rlike("[^ \\t-\\r]")
    lines = F.filter(F.split(t, "\n"), inked)
    base = docs.select(F.col(key), t.alias("_t"), utf8_words(t).alias("_w"), lines.alias("_l"))
    stops = F.lit(STOP_WORDS)
    long = lambda c: c.cast("long")
    counted = base.select(
        F.col(key),
        long(F.size("_w")).alias("n_words"),
        long(F.length("_t") - F.length(F.regexp_replace("_t", "[^ \\t-\\r]+", ""))).alias("word_chars"),
        long(F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        long(F.size("_l")).alias("n_lines"),
        long(F.size(F.filter("_w", lambda w: F.array_contains(stops, F.lower(w))))).alias("n_stop_words"),
        long(F.size(F.filter("_l", lambda x: x.rlike("^[ \\t]*[-*\u2022]")))).alias("n_bullet_lines"),
        long(F.size(F.filter("_l", lambda x: x.rlike("(\\.\\.\\.|\u2026)[ \\t\\r]*$")))).alias("n_cut_lines"),
    )
    return counted.withColumn("n_repeat_words", repeated_words(F.col("_h"))).drop("_h")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean over the counted columns that holds where every rule does."""
    sides = []
    for r in rules:
        measure = f"({r.measure})"
        sides += [f"{measure} >= {r.low}"] * (r.low is not None) + [f"{measure} <= {r.high}"] * (r.high is not None)
    return reduce(lambda a, b: a & b, (F.expr(s) for s in sides), F.lit(True))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts with ``base_failed`` and ``kept``; null, empty and blank texts have zero words and fail the base rule."""
    counted = measured(docs, key, text)
    failed = F.expr(BASE_FAILED)
    return counted.withColumn("base_failed", failed).withColumn("kept", F.when(failed, F.lit(False)).otherwise(compiled(rules)))
