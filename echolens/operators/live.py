"""A live run over feeds as one plan: brand, known cards, date, window, addresses, and what became of every item."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.functions import dates, text, url
from echolens.operators import filters
from echolens.operators.dedup import stored
from echolens.operators.order import first_of

SNIPPET = 350


def judged(items: DataFrame, forms: Sequence[str], cards: DataFrame, start: date | None, end: date, zone: str = dates.ZONE) -> DataFrame:
    """``items`` with ``outcome``, in the order of the tests: ``other`` (no form of the brand), ``known`` (a card's address), ``undated``, ``outside`` of the window, or ``kept``.

    ``items`` have feed, ord, title, text, url, published_at; ``start`` None is
    all time.  Addresses are compared by key; cards without one match nothing.
    """
    known = cards.where("url is not null").select(url.url_key("url").alias("_key"), F.lit(True).alias("_known")).distinct()
    rows = items.withColumn("_key", url.url_key("url")).join(known, "_key", "left")
    day = dates.zoned_date("published_at", zone)
    inside = (day <= F.lit(end)) & (F.lit(True) if start is None else day >= F.lit(start))
    outcome = F.when(~F.coalesce(filters.names_brand(forms), F.lit(False)), "other").when(F.col("_known"), "known").when(filters.undated(), "undated").when(~inside, "outside").otherwise("kept")
    return rows.withColumn("outcome", outcome).drop("_known")


def live_run(items: DataFrame, forms: Sequence[str], cards: DataFrame, start: date | None, end: date, zone: str = dates.ZONE) -> tuple[DataFrame, DataFrame]:
    """The finds of a run, newest first, and its counters by feed.

    Of items at one address the first in the order of feeds stands.  The items
    are judged once, and both results read what was stored of them.
    """
    rows = stored(judged(items, forms, cards, start, end, zone))
    found = first_of(rows.where("outcome = 'kept'"), ["_key"], ["feed", "ord"])
    snippet = text.trimmed(F.substring(F.coalesce("text", F.lit("")), 1, SNIPPET))
    finds = found.select("feed", "ord", "title", "url", "published_at", F.when(snippet != "", snippet).alias("summary"), F.lit("undefined").alias("sentiment")).orderBy(F.desc("published_at"), "feed", "ord")
    sums = rows.groupBy("feed").agg(F.count(F.lit(1)).alias("seen"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("other", "known", "undated", "outside", "kept")])
    told = finds.groupBy("feed").agg(F.count(F.lit(1)).alias("finds"))
    return finds, sums.join(told, "feed", "left").withColumn("finds", F.coalesce("finds", F.lit(0)).cast("long"))
