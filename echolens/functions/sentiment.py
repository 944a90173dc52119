"""Tone of a text by a pluggable classifier; the built-in one is a small lexicon, so nothing leaves the cluster."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions import text, url

# What the classifier sees, and stems of the built-in lexicon.
INPUT_LIMIT, LEAST_FULL_TEXT = 6000, 400
GOOD = ("успе", "рост", "рекорд", "награ", "побед", "лучш", "развит", "success", "growth", "award", "best", "win", "great", "improve")
BAD = ("скандал", "авари", "убыт", "штраф", "жалоб", "взлом", "утечк", "суд ", "fail", "fraud", "breach", "loss", "worst", "idiot", "stupid", "scam")


def hits(low: Column, stems: tuple[str, ...]) -> Column:
    return sum((F.size(F.split(low, text_literal(s))) - 1 for s in stems), F.lit(0))


def text_literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def by_lexicon(title: str = "title", body: str = "text") -> Column:
    """Positive or negative by which stems occur more, neutral if as often, undefined without any."""
    low = F.lower(F.substring(text.haystack(title, body), 1, INPUT_LIMIT))

    def choose(t: Column) -> Column:
        good, bad = hits(t, GOOD), hits(t, BAD)
        return F.when(good > bad, "positive").when(bad > good, "negative").when(good > 0, "neutral").otherwise("undefined")

    return text.let(low, choose)


def classified(rows: DataFrame, classifier: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """Adds ``tone``: by the given classifier over titles and texts (batches of Arrow columns), else by the lexicon."""
    if classifier is None:
        return rows.withColumn("tone", by_lexicon())

    @F.pandas_udf("string")
    def run(title: pd.Series, body: pd.Series) -> pd.Series:
        return classifier(title.fillna(""), body.fillna("").str.slice(0, INPUT_LIMIT))

    return rows.withColumn("tone", run(F.col("title"), F.col("text")))


def with_cards(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """The tone and summary of a hand-written card win over the computed tone where the address is the same."""
    c = cards.groupBy(url.url_key("url").alias("_key")).agg(F.min_by(F.struct("sentiment", "summary"), "ord").alias("_card"))
    out = rows.withColumn("_key", url.url_key("url")).join(c, "_key", "left")
    return out.withColumn("tone", F.coalesce("_card.sentiment", "tone")).withColumn("summary", F.coalesce("_card.summary", "summary")).drop("_key", "_card")


def needs_full_text() -> Column:
    return F.length(text.trimmed(F.coalesce("text", F.lit("")))) < LEAST_FULL_TEXT


def prompt(words: int | None = None) -> str:
    """The instruction for a model classifier, with a summary of so many words if asked."""
    ask = f" Add a summary of at most {words} words." if words else ""
    return f"Say whether the company is mentioned in a positive, negative or neutral way; answer as JSON with sentiment and reason.{ask}"
