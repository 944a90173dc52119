"""A pool run over links as one plan: reading, relevance, excerpt, date and the mention that comes of it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions import dates, sentiment, text, url
from echolens.operators import filters, keywords, merge
from echolens.operators.keywords import Keyword
from echolens.operators.order import first_of

# The least text of a page that counts as read, and texts that are stored or shown.
LEAST_PAGE_TEXT = 400
UNREADABLE = "страница не открылась или не содержит текста"
POOL_NAME, UNTITLED = "curated", "Материал из пула"


def page_readings(links: DataFrame, pages: DataFrame, models: DataFrame) -> DataFrame:
    """``links`` with how each was read: the parsed page of its address, or of the address with the closing slash turned, else a model's reading.

    ``pages(url, title, text, published_at)`` are parsed pages, ``models(id,
    title, date, model_mentioned, fragments)`` readings by link.  A page
    counts if it has a title and enough text; of both forms of the address
    the stored one is tried first.
    """
    tries = links.select("id", F.posexplode(url.slash_variants("url")).alias("_turn", "_address"))
    p = pages.select(F.col("url").alias("_address"), F.col("title").alias("_title"), F.col("text").alias("_text"), F.col("published_at").cast("timestamp_ntz").alias("page_date"))
    good = tries.join(p, "_address").where(filters.has_ink("_title") & (F.length(text.trimmed("_text")) >= LEAST_PAGE_TEXT))
    best = first_of(good, ["id"], ["_turn"]).drop("_turn", "_address").withColumn("_parsed", F.lit(True))
    m = models.select("id", F.col("title").alias("_model_title"), F.col("date").cast("timestamp_ntz").alias("_model_date"), "model_mentioned", F.coalesce("fragments", F.array().cast("array<string>")).alias("fragments"))
    rows = links.join(best, "id", "left").join(m, "id", "left")
    parsed = F.coalesce("_parsed", F.lit(False))
    return rows.withColumns({
        "read_via": F.when(parsed, "parser").otherwise("model"),
        "title": F.when(parsed, F.col("_title")).otherwise(F.col("_model_title")),
        "text": F.when(parsed, F.col("_text")).otherwise(F.array_join("fragments", "\n\n")),
        "model_date": F.when(~parsed, F.col("_model_date")),
        "model_mentioned": ~parsed & F.coalesce("model_mentioned", F.lit(False)),
        "fragments": F.when(parsed, F.array().cast("array<string>")).otherwise(F.coalesce("fragments", F.array().cast("array<string>"))),
    }).drop("_parsed", "_title", "_text", "_model_title", "_model_date")


def outcomes(links: DataFrame, pages: DataFrame, models: DataFrame, active: Sequence[Keyword], forms: Sequence[str], now: datetime, earliest: datetime | None = None) -> DataFrame:
    """``links`` with ``result`` (processed, not_relevant, error), ``message``, and what a mention of it would hold.

    A link without title and text is an error; one whose page names no
    keyword, or whose article is known to be older than ``earliest``, is not
    relevant.  The excerpt is taken around ``forms``.
    """
    read = page_readings(links, pages, models)
    judged = keywords.relevance(read, active)
    resolved = judged.withColumn("_date", dates.resolved_date(F.col("page_date"), dates.url_date("url", now).cast("timestamp_ntz"), F.col("model_date"), now))
    blank = (F.coalesce("title", F.lit("")) == "") & (F.coalesce("text", F.lit("")) == "")
    old = filters.before_earliest(earliest, "_date.date")
    result = F.when(blank, "error").when(~F.col("relevant") | old, "not_relevant").otherwise("processed")
    message = F.when(blank, UNREADABLE).when(~F.col("relevant"), F.col("reason")).when(old, F.concat(F.lit("до "), F.lit(f"{earliest:%d.%m.%Y}" if earliest else "")))
    done = result == "processed"
    return resolved.withColumns({
        "result": result,
        "message": message,
        "excerpt": F.when(done, text.mention_context("title", "text", forms)),
        "published_at": F.when(done, F.col("_date.date")),
        "date_source": F.when(done, F.col("_date.source")),
    }).drop("_date", "reason", "relevant")


def upserted_mentions(mentions: DataFrame, done: DataFrame, tone: Column | None = None) -> DataFrame:
    """The mentions after a run: those of processed links with new content, or new and hidden ones.

    A mention that has a tone keeps it; only one without is classified, by
    ``tone`` over title and text.  ``mentions`` has at least the columns
    written here; others of a new mention are null.
    """
    found = done.where("result = 'processed'").select(
        F.col("id").alias("curated_link_id"), "url_hash", "url",
        F.coalesce(F.nullif(F.coalesce("title", F.lit("")), F.lit("")), "group_label", F.lit(UNTITLED)).alias("title"),
        F.col("excerpt").alias("text"), "published_at", F.coalesce("group_label", F.lit(POOL_NAME)).alias("source_label"), F.col("matched_keywords").alias("keywords"),
    )
    fresh = ("title", "text", "published_at", "source_label", "keywords")
    rows = mentions.join(found.select("curated_link_id", *[F.col(c).alias(f"_{c}") for c in fresh], F.lit(True).alias("_hit")), "curated_link_id", "left")
    changed = rows.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fresh})
    tone = sentiment.by_lexicon() if tone is None else tone
    changed = changed.withColumn("sentiment", F.when(F.col("_hit") & (F.coalesce("sentiment", F.lit("undefined")) == "undefined"), tone).otherwise(F.col("sentiment")))
    new = found.join(mentions.select("curated_link_id"), "curated_link_id", "left_anti")
    new = new.withColumns({"hash": text.salted_hash("curated", "url_hash"), "sentiment": tone, "source_type": F.lit("news"), "url_hidden": F.lit(True)}).withColumn("id", F.col("hash"))
    columns = [c for c in mentions.columns if c in new.columns]
    return changed.select(mentions.columns).unionByName(new.select(columns), allowMissingColumns=True)


def processed(links: DataFrame, mentions: DataFrame, done: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """``(links, mentions)`` after a run with these ``outcomes``."""
    after = upserted_mentions(mentions, done)
    ids = after.where("curated_link_id is not null").groupBy("curated_link_id").agg(F.min("id").alias("mention_id"))
    told = done.select("id", "result", "message", "date_source").join(ids.withColumnRenamed("curated_link_id", "id"), "id", "left")
    return merge.after_attempt(links, told, now), after
