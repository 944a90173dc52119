"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order models, one of random strings and one of ordinary
identifiers, are counted from labelled samples.  A long token whose
log-likelihood ratio favours the random model is reported beside the
patterns' matches.  Only DataFrame expressions run; positions come from the
lengths of what lies between matches, because no built-in reports them.

Folds over many matches run in blocks and texts are cut through chunks, so
that work stays about linear in the text and its matches.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm.common import private
from echolens.llm.qualityrules import let

#: Fixed patterns of the base scan: kind, pattern, and the group with its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # whole runs of 18 characters or more, as the pattern with + and a length test finds them
HEX = "[0-9a-f]{16,}"  # likewise
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGNED = 12
#: Tokens that the models look at, and what a token must score.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
LEAST_RATIO = 0.6
MASK = "<secret>"
#: Matches that are folded at once, and characters of a chunk.
FOLD, CHUNK = 64, 4096
SPANS = "array<struct<s:bigint,k:int,e:bigint>>"

#: Words of ordinary identifiers for the default labelled sample.
ORDINARY = (
    "account action active address amount array article author balance batch block buffer button cache "
    "category channel client cluster code column comment config content count country create current "
    "customer data date default delete detail device document domain element email entry error event "
    "export field file filter first folder format function group handler header height history image "
    "import index input insert item language last layer length level library limit line link list "
    "local location manager message method model module month name network node number object option "
    "order output owner package page parent partition password path pattern payment person phone "
    "position price process product profile project property query queue random range record region "
    "remote report request resource response result return sample schema search section segment select "
    "server service session setting shipping source start state status storage stream string supplier "
    "system table target template text thread time title total transaction type update user value vector "
    "version view width window worker nicht werden durch haben zwischen gegen immer sprache stadt "
    "toujours maison temps entre avec depuis pendant ciudad siempre tiempo trabajo nuestro"
).split()


def labelled_sample(spark: SparkSession, each: int = 2000, seed: int = 7) -> DataFrame:
    """The default sample, ``each`` strings of either label: ``(token string, is_random boolean)``."""
    rng = random.Random(seed)
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789_-")
    rows = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 60))), True) for _ in range(each)]
    for _ in range(each):
        parts = rng.choices(ORDINARY, k=rng.randint(2, 6))
        style = rng.randrange(6)
        if style == 5:  # rules and fillers of one character
            rows.append((rng.choice(alphabets[1] + "-_=") * rng.randint(20, 60), False))
            continue
        name = "".join(w.title() for w in parts) if style == 0 else ("_", "-", "/", "")[style - 1].join(parts)
        rows.append((name.upper() if rng.random() < 0.1 else name, False))
    return spark.createDataFrame(rows, "token string, is_random boolean")


def ratio_table(sample: DataFrame) -> list[int]:
    """Log-likelihood ratio of each pair of ASCII characters, in thousandths (``128 * 128`` numbers, smoothed by a half).

    Null tokens count for nothing; without a sample every ratio is 0.
    """
    pairs = sample.where("length(token) > 1").select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, 2))).alias("pair"))
    seen = pairs.where(F.col("pair").rlike("^[\\x21-\\x7e]{2}$")).groupBy("pair").agg(F.count_if("is_random").alias("r"), F.count_if(~F.col("is_random")).alias("o")).collect()  # at most 94 * 94 rows
    rows = {True: [0.0] * 128, False: [0.0] * 128}
    counts = {True: {}, False: {}}
    for pair, r, o in seen:
        for label, n in ((True, r), (False, o)):
            counts[label][pair] = n
            rows[label][ord(pair[0])] += n
    table = [0] * (128 * 128)
    if not seen:
        return table
    for a in range(33, 127):
        for b in range(33, 127):
            logs = [math.log((counts[x].get(chr(a) + chr(b), 0) + 0.5) / (rows[x][a] + 0.5 * 66)) for x in (True, False)]
            table[a * 128 + b] = round(1000 * (logs[0] - logs[1]))
    return table


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of the ``array<long>`` what ``combine`` makes of those before it, from 0 on.

    Appending to an array copies it, so blocks of ``FOLD`` are folded apart
    and then moved by what lies before each block.
    """

    def fold(block: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            last = combine(acc["last"], v)
            return F.struct(F.concat(acc["out"], F.array(last)).alias("out"), last.alias("last"))

        zero = F.lit(0).cast("long")
        return F.aggregate(block, F.struct(F.array(zero).alias("out"), zero.alias("last")), step, lambda acc: acc["out"])

    def moved(blocks: Column) -> Column:
        def by(before: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: combine(x, F.get(before, i)))))

        return let(fold(F.transform(blocks, lambda b: F.element_at(b, -1))), by)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLD).cast("int")), lambda b: fold(F.slice(values, b * FOLD + 1, F.lit(FOLD))))
    return F.when(F.size(values) > 0, let(parts, moved)).otherwise(F.array().cast("array<bigint>"))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)`` of a text, from its chunks of ``CHUNK`` characters."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    part = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.substring(part, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """``array<struct<s long, k int, e long>>``: the matches of ``pattern`` whose ``group`` has ``least`` characters or more."""
    none = F.array().cast(SPANS)

    def walk(found: Column) -> Column:
        long = lambda c, i: F.length(F.get(c, i)).cast("long")
        steps = F.transform(found["b"], lambda b, i: long(found["a"], i) + F.length(b))

        def placed(before: Column) -> Column:
            def span(i: Column) -> Column:
                start = F.get(before, i) + long(found["a"], i)
                return F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + long(found["b"], i)).alias("e"))

            at = F.filter(F.sequence(F.lit(0), F.size(found["b"]) - 1), lambda i: F.length(F.get(found["c"], i)) >= least)
            return F.transform(at, span).cast(SPANS)

        return let(running(steps, lambda x, y: x + y), placed)

    rx = F.lit(pattern)
    found = F.struct(F.split(text, pattern, -1).alias("a"), F.regexp_extract_all(text, rx, F.lit(0)).alias("b"), F.regexp_extract_all(text, rx, F.lit(group)).alias("c"))
    return F.when(text.rlike(pattern), let(found, walk)).otherwise(none)


def covered(text: Column, spans: Column, cover: Callable[[Column], Column]) -> Column:
    """``text`` with each stretch that sorted ``spans`` cover replaced: by ``cover`` of its first span, and of each later one by as far as that reaches on."""

    def pieces(x: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            reach = F.get(x["reach"], i)
            return F.concat(F.when(s["s"] >= reach, cut(x["chunks"], reach, s["s"])).otherwise(F.lit("")), cover(F.struct(s["s"].alias("s"), s["e"].alias("e"), reach.alias("reach"))))

        end = F.array_max(F.transform(spans, lambda s: s["e"]))
        return F.concat(F.array_join(F.transform(spans, one), ""), cut(x["chunks"], end, F.greatest(end, F.length(text).cast("long"))))

    found = F.struct(chunked(text).alias("chunks"), running(F.transform(spans, lambda s: s["e"]), F.greatest).alias("reach"))
    return F.when(F.size(spans) > 0, let(found, pieces)).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with a space for each character of sorted ``spans``."""
    return covered(text, spans, lambda s: F.repeat(F.lit(" "), F.greatest(s["e"] - F.greatest(s["s"], s["reach"]), F.lit(0)).cast("int")))


def random_looking(text: Column, spans: Column, table: Column) -> Column:
    """Those of ``spans`` whose token has a mean log-likelihood ratio of ``LEAST_RATIO`` or more a pair."""

    def score(token: Column) -> Column:
        at = lambda i: F.ascii(F.substring(token, i, 1))
        total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.element_at(table, at(i) * 128 + at(i + 1) + 1))
        return total >= LEAST_RATIO * 1000 * (F.length(token) - 1)

    return let(chunked(text), lambda chunks: F.filter(spans, lambda s: let(cut(chunks, s["s"], s["e"]), score)))


def scanned(docs: DataFrame, names: tuple[str, str], sample: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with two more columns: sorted arrays of spans ``(s, k, e)`` in code points, end exclusive, of the patterns and of the models.

    Null and empty texts have no span.  What the patterns matched is taken
    out of a token before the models look at the pieces of it that are left;
    these and tokens count from 20 characters on.
    """
    spark = docs.sparkSession
    table = F.from_json(F.lit(json.dumps(ratio_table(sample if sample is not None else labelled_sample(spark)))), "array<int>")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base, added = names
    docs = docs.withColumn(base, F.array_sort(F.concat(spans_of(t, ASSIGN, 0, 2, LEAST_ASSIGNED), spans_of(t, ACCESS, 1), spans_of(t, HEX, 2))))
    docs = docs.withColumn(added, spans_of(blanked(t, F.col(base)), TOKEN, 3))
    return docs.withColumn(added, F.when(F.size(added) > 0, random_looking(t, F.col(added), table)).otherwise(F.col(added)))


def named_spans(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["s"].cast("string"), s["e"].cast("string"))), ",")


def secret_report(docs: DataFrame, sample: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, n_assign, n_access, n_hex, n_markov, base_sha256, spans)`` for every row of ``docs``.

    A null text counts as empty; rows that repeat a key are rows of their
    own; an empty table gives no rows.
    """
    rows = scanned(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), ("base", "added"), sample)
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return rows.select(
        F.col("key").alias(key),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.size("added").cast("long").alias("n_markov"),
        F.sha2(named_spans(F.col("base")), 256).alias("base_sha256"),
        named_spans(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def masked(docs: DataFrame, sample: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``MASK``; overlapping spans by one.

    Null texts stay null, empty ones empty; an empty table stays empty; other
    columns, whatever their names, are kept.
    """
    names = private(docs, "base", "added")
    rows = scanned(docs, names, sample, text)
    spans = F.array_sort(F.concat(*[F.col(n) for n in names]))
    hidden = covered(F.col(f"`{text}`"), spans, lambda s: F.when(s["s"] >= s["reach"], F.lit(MASK)).otherwise(F.lit("")))
    return rows.withColumn(text, hidden).select(*[F.col(f"`{c}`") for c in docs.columns])
