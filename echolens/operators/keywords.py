"""Keyword match: a row is kept if a positive keyword occurs and no minus keyword does."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions import stem, text


@dataclass(frozen=True)
class Keyword:
    phrase: str
    type: str = "required"
    language: str = "ru"
    manual_forms: Sequence[str] = field(default_factory=tuple)
    is_active: bool = True

    @property
    def literal(self) -> bool:
        """Whether the keyword matches as written: exact phrases, Kazakh, and those with forms of their own."""
        return self.type == "exact_phrase" or self.language == "kk" or bool(self.manual_forms)

    @property
    def forms(self) -> list[str]:
        return [f for f in (self.phrase, *self.manual_forms) if f and f.strip()]


#: Characters of the phrases that one pass over the texts looks for.
BLOCK_CHARACTERS = 250_000
#: Words of a dictionary of terms that are literals of the plan; a larger one is joined.
MOST_TERMS = 4_096


def snapshot(table: DataFrame, minus: bool = True) -> list[Keyword]:
    """The active keywords as of now; a hand-kept table of at most some thousand rows."""
    rows = table.where("is_active").select("phrase", "type", "language", "manual_forms").orderBy("phrase", "type").collect()
    return [Keyword(r[0], r[1], r[2] or "ru", tuple(r[3] or ())) for r in rows if minus or r[1] != "minus"]


def stemmed(hay: Column, phrases: Sequence[str], config: str) -> Column:
    """For each phrase whether all its stems occur; phrases of stop words only never match."""
    wanted = [frozenset(stem.lexemes(p, config)) for p in phrases]

    @F.pandas_udf("array<boolean>")
    def match(s: pd.Series) -> pd.Series:
        found = s.map(lambda t: stem.lexemes(t, config))
        return found.map(lambda have: [bool(w) and w <= have for w in wanted])

    return match(hay)


def with_stem_hits(rows: DataFrame, phrases: Sequence[str], config: str, name: str, title: str = "title", body: str = "text") -> DataFrame:
    """``rows`` with ``name``, for each phrase whether all its stems occur, through a dictionary of terms.

    The different words of the whole table are stemmed once each, and those
    that lead to a stem of some phrase are the dictionary.  Words of each
    text meet the dictionary in the JVM; no text goes to Python, and none is
    shuffled while the dictionary has no more than ``MOST_TERMS`` words.
    """
    wanted = [sorted(stem.lexemes(p, config)) for p in phrases]
    asked = sorted({s for stems in wanted for s in stems})

    @F.pandas_udf("string")
    def stem_of(words: pd.Series) -> pd.Series:
        return words.map(lambda w: next(iter(stem.lexemes(w, config)), None))

    hay = text.haystack(title, body)
    words = F.array_distinct(F.filter(F.split(F.lower(hay), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    terms = rows.select(F.explode(words).alias("word")).distinct().withColumn("stem", stem_of("word")).where(F.col("stem").isin(asked))
    few = terms.limit(MOST_TERMS + 1).collect()
    if len(few) <= MOST_TERMS:
        of = {s: [r["word"] for r in few if r["stem"] == s] for s in asked}
        held = rows.withColumn("_held", F.filter(words, lambda w: w.isin([r["word"] for r in few])))
        any_of = lambda those: F.exists("_held", lambda w: w.isin(those)) if those else F.lit(False)
        there = {s: any_of(of[s]) for s in asked}
        return held.withColumn(name, F.array(*[reduce(lambda a, b: a & b, [there[s] for s in w]) if w else F.lit(False) for w in wanted])).drop("_held")
    keyed = rows.withColumn("_h1", F.xxhash64(hay)).withColumn("_h2", F.xxhash64(F.lit("second"), hay))
    held = keyed.select("_h1", "_h2", F.explode(words).alias("word"))
    found = held.join(terms, "word").groupBy("_h1", "_h2").agg(F.collect_set("stem").alias("_found"))
    every = [F.size(F.array_intersect(F.coalesce("_found", F.array().cast("array<string>")), F.array(*map(F.lit, w)))) == len(w) if w else F.lit(False) for w in wanted]
    return keyed.join(found, ["_h1", "_h2"], "left").withColumn(name, F.array(*every)).drop("_h1", "_h2", "_found")


def matched(rows: DataFrame, keywords: Sequence[Keyword], title: str = "title", body: str = "text", terms: bool = False) -> DataFrame:
    """Adds ``matched`` and ``matched_keywords`` (distinct phrases in keyword order; empty for rejected rows).

    Keywords are literals of the expression, so nothing is joined.  Literal
    ones stay in the JVM; stems are computed once a row for each language, or
    with ``terms`` once for each different word of the table, which pays where
    texts are many and is no column expression any more.
    """
    active = [k for k in keywords if k.is_active]
    hay = text.haystack(title, body)
    hits: dict[int, Column] = {}
    for config in ("russian", "english"):
        group = [i for i, k in enumerate(active) if not k.literal and (k.language == "en") == (config == "english")]
        if group:
            wanted = [active[i].phrase for i in group]
            rows = with_stem_hits(rows, wanted, config, f"_stems_{config}", title, body) if terms else rows.withColumn(f"_stems_{config}", stemmed(hay, wanted, config))
            hits |= {i: F.get(f"_stems_{config}", F.lit(n)) for n, i in enumerate(group)}
    hits |= {i: text.contains_any(hay, k.forms) for i, k in enumerate(active) if k.literal}
    any_of = lambda chosen: reduce(lambda a, b: a | b, chosen, F.lit(False))
    positive = [i for i, k in enumerate(active) if k.type != "minus"]
    vetoed = any_of([hits[i] for i, k in enumerate(active) if k.type == "minus"])
    ok = ~vetoed & (any_of([hits[i] for i in positive]) if positive else F.lit(True))
    ordered = sorted(positive, key=lambda i: (active[i].literal, active[i].language == "en" and not active[i].literal, i))
    names = F.array_compact(F.array(*[F.when(hits[i], F.lit(active[i].phrase)) for i in ordered])) if ordered else F.array().cast("array<string>")
    out = rows.withColumn("matched", ok).withColumn("matched_keywords", F.when(F.col("matched"), F.array_distinct(names)).otherwise(F.array().cast("array<string>")))
    return out.drop("_stems_russian", "_stems_english")


def matched_once(rows: DataFrame, keywords: Sequence[Keyword], title: str = "title", body: str = "text") -> DataFrame:
    """The same for tables in which many rows share a text: each different title and text is searched once.

    Rows are told apart by 128 bits of hash.  Texts that repeat are one row a
    task before they are shuffled; rows get the flags by hash, without texts.
    """
    hay = text.haystack(title, body)
    keyed = rows.withColumn("_h1", F.xxhash64(hay)).withColumn("_h2", F.xxhash64(F.lit("second"), hay))
    distinct = keyed.select("_h1", "_h2", title, body).dropDuplicates(["_h1", "_h2"])
    flags = matched(distinct, keywords, title, body).select("_h1", "_h2", "matched", "matched_keywords")
    return keyed.join(flags, ["_h1", "_h2"]).drop("_h1", "_h2")


def keyword_hits(rows: DataFrame, keywords: DataFrame, key: str) -> DataFrame:
    """``(key, ordinal, phrase)`` for each literal keyword of a table that a row's title and text hold, whatever the case.

    Phrases of ``BLOCK_CHARACTERS`` in all make one automaton, with which each
    text is read once whatever their number; larger tables take a pass for
    each block.  No pair is formed but the hits.  An empty phrase is in every
    row, a null one in none.
    """
    known = keywords.where("phrase is not null").select(F.col("ordinal").cast("long").alias("ordinal"), "phrase", F.lower("phrase").alias("low"))
    characters = known.agg(F.sum(F.length("low") + 8)).first()[0] or 0
    blocks = -(-characters // BLOCK_CHARACTERS)
    hay = rows.select(key, F.lower(text.haystack("title", "text")).alias("hay"))
    schema = f"`{key}` {hay.schema[key].dataType.simpleString()}, ordinal long, phrase string"
    found = rows.sparkSession.createDataFrame([], schema)
    for n in range(blocks):
        chosen = known.where(F.pmod(F.xxhash64("low", "ordinal"), F.lit(blocks)) == n)
        phrases = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in chosen.collect()])  # a block, whatever the table
        found = found.union(hay.mapInArrow(_searcher(phrases, key), schema))
    return found


def keyword_flags(rows: DataFrame, keywords: DataFrame, key: str) -> DataFrame:
    """``(key, ordinal, phrase, hit)``: the same for a hand-kept list, of which each row says for every keyword whether it is there.

    The answer has a line for every row and keyword; ``keyword_hits`` is for tables.
    """
    found = keyword_hits(rows, keywords, key).groupBy(key).agg(F.collect_set("ordinal").alias("_hits"))
    kws = keywords.agg(F.array_sort(F.collect_list(F.struct("ordinal", "phrase"))).alias("_kws")).withColumn("_one", F.lit(1))
    told = rows.select(key).withColumn("_one", F.lit(1)).join(found, key, "left").join(kws, "_one")
    each = told.select(key, F.coalesce("_hits", F.array().cast("array<bigint>")).alias("_hits"), F.explode("_kws").alias("k"))
    return each.select(key, "k.ordinal", "k.phrase", F.array_contains("_hits", F.col("k.ordinal").cast("long")).alias("hit"))


def _searcher(phrases, key: str):  # noqa: ANN001, ANN202
    """A function over batches of ``(key, text)`` that finds a broadcast list of ``(ordinal, phrase, what to look for)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), []
        for n, (_, _, low) in enumerate(phrases.value):
            if not low:
                everywhere.append(n)
            else:
                automaton.add_word(low, [*automaton.get(low, ()), n])
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            at, hit = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t is None:
                    continue
                there = set(everywhere)
                if len(automaton):
                    for _, those in automaton.iter(t):
                        there.update(those)
                at += [i] * len(there)
                hit += sorted(there)
            found = [phrases.value[n] for n in hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], [key, "ordinal", "phrase"])

    return run


def relevance(pages: DataFrame, keywords: Sequence[Keyword]) -> DataFrame:
    """Adds ``relevant``, ``matched_keywords`` and ``reason``: the page itself, else a model's claim checked against the fragments it quotes."""
    base = matched(pages, keywords)
    base = base.withColumnRenamed("matched", "_page").withColumnRenamed("matched_keywords", "_page_keywords")
    quoted = base.withColumn("_quotes", F.array_join(F.coalesce("fragments", F.array().cast("array<string>")), "\n"))
    second = matched(quoted, keywords, "title", "_quotes").withColumnRenamed("matched", "_second").withColumnRenamed("matched_keywords", "_second_keywords")
    claimed = F.coalesce("model_mentioned", F.lit(False)) & (F.size(F.coalesce("fragments", F.array().cast("array<string>"))) > 0)
    out = second.withColumn("relevant", F.col("_page") | (claimed & F.col("_second")))
    out = out.withColumn("matched_keywords", F.when(F.col("_page"), F.col("_page_keywords")).when(F.col("relevant"), F.col("_second_keywords")).otherwise(F.array().cast("array<string>")))
    reason = F.when(F.col("relevant"), F.lit("")).when(claimed, F.lit("модель сообщила об упоминании, но в приведённых фрагментах ключевых слов нет")).otherwise(F.lit("на странице нет активных ключевых слов компании"))
    return out.withColumn("reason", reason).drop("_page", "_page_keywords", "_second", "_second_keywords", "_quotes")


def seeded(existing: Sequence[str], seed: Sequence[str]) -> Column:
    """Forms of a keyword after seeding: what an operator added stays, in order, missing ones follow."""
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.array_union(lit(existing), lit(seed))


def upserted(table: DataFrame, seeds: DataFrame) -> DataFrame:
    """The keyword table with seed rows merged by phrase and type."""
    s = seeds.select("phrase", "type", F.col("language").alias("_l"), F.col("manual_forms").alias("_f"))
    both = table.join(s, ["phrase", "type"], "full_outer")
    none = F.array().cast("array<string>")
    return both.select(
        F.coalesce("id", F.sha2(F.concat_ws(":", F.lit("keyword"), "type", "phrase"), 256)).alias("id"), F.trim("phrase").alias("phrase"), "type",
        F.coalesce("is_active", F.lit(True)).alias("is_active"), F.coalesce("language", "_l", F.lit("ru")).alias("language"),
        F.array_union(F.coalesce("manual_forms", none), F.coalesce("_f", none)).alias("manual_forms"),
    )


def cleanup_flags(mentions: DataFrame, keywords: Sequence[Keyword], terms: Sequence[str]) -> DataFrame:
    """``unrelated`` and ``look_alike`` for each mention; rows that name the brand have neither."""
    brand = [k for k in keywords if k.type != "minus" and not any(t in k.phrase.strip().lower() for t in terms)]
    whole = matched(mentions, keywords).withColumnRenamed("matched", "_any").drop("matched_keywords")
    if brand:
        whole = matched(whole, brand).withColumnRenamed("matched", "_brand").drop("matched_keywords")
    else:
        whole = whole.withColumn("_brand", F.lit(False))
    low = F.lower(text.haystack("title", "text"))
    alike = reduce(lambda a, b: a | b, (low.contains(t) for t in terms))
    return whole.withColumn("unrelated", ~F.col("_brand") & ~F.col("_any")).withColumn("look_alike", ~F.col("_brand") & alike).drop("_any", "_brand")
