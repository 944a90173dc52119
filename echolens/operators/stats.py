"""Dashboard, pool and card aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens import schema
from echolens.functions import dates, url
from echolens.operators import filters, order
from echolens.operators.filters import MentionFilters
from echolens.plans import periods


def share_change(total: Column, previous: Column) -> Column:
    """Change in percent to one decimal, halves upwards; null on a zero base."""
    part = F.try_divide((total - previous).cast("double"), previous.cast("double"))
    return F.floor(part * 1000 + 0.5).cast("double") / 10


def feed(mentions: DataFrame, f: MentionFilters, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the feed, undated mentions first, then newest."""
    ordered = [F.desc_nulls_first("published_at"), F.desc_nulls_first("found_at"), F.asc("id")]
    return order.page(filters.filtered(mentions, f), ordered, limit, offset)


def total(mentions: DataFrame, f: MentionFilters) -> DataFrame:
    return filters.filtered(mentions, f).agg(F.count(F.lit(1)).alias("total"))


def total_change(mentions: DataFrame, f: MentionFilters) -> DataFrame:
    """Both periods' totals and the change, in one pass over the union of their ranges."""
    start, end = periods.previous_range(f.date_from, f.date_to)
    other = MentionFilters(f.sentiment, f.source_id, f.source_type, f.language, f.search, start, f.date_to)
    at = filters.event_time()
    now = F.count_if((at >= F.lit(f.date_from)) & (at <= F.lit(f.date_to))).alias("total")
    before = F.count_if((at >= F.lit(start)) & (at <= F.lit(end))).alias("previous_total")
    return filters.filtered(mentions, other).agg(now, before).withColumn("change_percent", share_change(F.col("total"), F.col("previous_total")))


def by_day(mentions: DataFrame, f: MentionFilters) -> DataFrame:
    return filters.filtered(mentions, f).groupBy(F.to_date(filters.event_time()).alias("day")).agg(F.count(F.lit(1)).alias("count")).orderBy("day")


def filled(counts: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts with a zero for each value of the domain that is missing."""
    all_ = counts.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return F.broadcast(all_).join(counts, column, "left").select(column, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def counts_by(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Zero-filled counts as conditional sums of one pass: one row for each value of the domain."""
    sums = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in domain])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias("count")) for v in domain])).alias("x")).select("x.*")


def by_sentiment(mentions: DataFrame, f: MentionFilters) -> DataFrame:
    return counts_by(filters.filtered(mentions, f), "sentiment", schema.SENTIMENTS)


def with_source_name(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """The registered name of a mention's source, else its own label.  Few sources: Spark broadcasts them if they are small."""
    s = sources.select(F.col("id").alias("_sid"), F.col("name").alias("_name"))
    return mentions.join(s, F.col("source_id") == F.col("_sid"), "left").withColumn("source_name", F.coalesce("_name", "source_label")).drop("_sid", "_name")


def top_sources(mentions: DataFrame, sources: DataFrame, f: MentionFilters, n: int = 10) -> DataFrame:
    """The ``n`` sources with most mentions.  Mentions are counted by source and label first, names are joined to the counts."""
    counts = filters.filtered(mentions, f).groupBy("source_id", "source_label").agg(F.count(F.lit(1)).alias("_n"))
    named = counts.join(sources.select(F.col("id").alias("_sid"), F.col("name").alias("_name")), F.col("source_id") == F.col("_sid"), "left")
    out = named.groupBy("source_id", F.col("_name").alias("_name"), "source_label").agg(F.sum("_n").alias("count"))
    out = out.select("source_id", F.coalesce("_name", "source_label").alias("name"), "count")
    return out.orderBy(F.desc("count"), F.asc_nulls_last("name"), F.asc_nulls_last("source_id")).limit(n)


def source_counts(sources: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions of each source, zero for none."""
    counts = mentions.where(F.col("source_id").isNotNull()).groupBy(F.col("source_id").alias("_sid")).agg(F.count(F.lit(1)).alias("_n"))
    return sources.join(counts, F.col("id") == F.col("_sid"), "left").select("id", "name", F.coalesce("_n", F.lit(0)).alias("mention_count"))


def sentiment_sums(where: Column) -> list[Column]:
    return [F.count_if(where & (F.col("sentiment") == s)).alias(s) for s in schema.SENTIMENTS]


def window_counts(mentions: DataFrame, start: date, end: date, zone: str = dates.ZONE) -> DataFrame:
    """Pool mentions of a period: all, by sentiment, and the undated of the whole pool."""
    inside = filters.in_window(start, end, zone)
    return mentions.where(filters.pooled()).agg(F.count_if(inside).alias("total"), *sentiment_sums(inside), F.count_if(filters.undated()).alias("undated"))


def pool_page(mentions: DataFrame, start: date, end: date, limit: int, offset: int = 0, zone: str = dates.ZONE) -> DataFrame:
    """A page of pool mentions, newest first, without any address; 500 rows at most."""
    rows = filters.page_columns(mentions.where(filters.pooled() & filters.in_window(start, end, zone)))
    return order.page(rows, [F.desc("published_at"), F.asc("id")], min(max(limit, 1), 500), max(offset, 0))


def pool_stats(links: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: links by status, mentions, undated ones, first and last date, last processing."""
    a = links.agg(F.count(F.lit(1)).alias("total_links"), *[F.count_if(F.col("status") == s).alias(s) for s in schema.LINK_STATUSES], F.max("processed_at").alias("last_processed_at"))
    b = mentions.where(filters.pooled()).agg(F.count(F.lit(1)).alias("mentions_total"), F.count_if(filters.undated()).alias("undated_mentions"), F.min("published_at").alias("first_date"), F.max("published_at").alias("last_date"))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def counts_of(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def group_status(links: DataFrame) -> DataFrame:
    """Per group: all links and one column for each status."""
    return links.groupBy("group_label").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in schema.LINK_STATUSES])


def card_breakdown(cards: DataFrame) -> DataFrame:
    """Cards by sentiment, by source and in all, as grouping sets of one pass; ``part`` names the set."""
    cards.createOrReplaceTempView("_echolens_cards")
    return cards.sparkSession.sql(
        """SELECT CASE WHEN grouping(sentiment) = 0 THEN 'sentiment' WHEN grouping(source_name) = 0 THEN 'source' ELSE 'all' END AS part,
                  coalesce(sentiment, source_name) AS value, count(*) AS count
           FROM _echolens_cards GROUP BY GROUPING SETS ((sentiment), (source_name), ())"""
    )


def card_set(cards: DataFrame) -> DataFrame:
    """One row: all, shown and duplicate cards; shown ones by status and sentiment."""
    shown = F.col("status") != "duplicate"
    by_status = [F.count_if(F.col("status") == s).alias(f"status_{s}") for s in schema.CARD_STATUSES if s != "duplicate"]
    return cards.agg(F.count(F.lit(1)).alias("total"), F.count_if(shown).alias("shown"), F.count_if(~shown).alias("duplicates"), *by_status, *sentiment_sums(shown))


def card_period(cards: DataFrame, start: date, end: date) -> DataFrame:
    """One row: visible cards in a period by sentiment, the undated and the whole set."""
    inside = F.coalesce(F.col("published_at").between(F.lit(start), F.lit(end)), F.lit(False))
    return filters.visible_cards(cards).agg(F.count_if(inside).alias("total"), *sentiment_sums(inside), F.count_if(filters.undated()).alias("undated"), F.count(F.lit(1)).alias("pool"))


def card_dates(cards: DataFrame) -> DataFrame:
    return filters.visible_cards(cards).agg(F.min("published_at").alias("first_date"), F.max("published_at").alias("last_date"), F.count_if(filters.undated()).alias("undated"))


def run_tally(outcomes: DataFrame) -> DataFrame:
    """One row: what a run over links did, by status, reading, tone and date source."""
    done = F.col("status") == "processed"
    return outcomes.agg(
        F.count(F.lit(1)).alias("attempted"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in schema.LINK_STATUSES],
        F.count_if(F.col("read_via") == "parser").alias("read_by_parser"),
        F.count_if(F.col("read_via") == "model").alias("read_by_model"),
        *[F.count_if(F.col("sentiment") == s).alias(f"sentiment_{s}") for s in schema.SENTIMENTS],
        F.count_if(done & F.col("date_source").isNotNull()).alias("with_date"),
        F.count_if(done & F.col("date_source").isNull()).alias("without_date"),
        *[F.count_if(done & (F.col("date_source") == s)).alias(f"date_{s}") for s in schema.DATE_SOURCES],
    )


def dated_share(tally: DataFrame) -> DataFrame:
    part = F.try_divide(F.col("with_date") * 100.0, F.col("with_date") + F.col("without_date"))
    return tally.select(F.floor(part + 0.5).cast("int").alias("dated_percent"))


def shares(counts: DataFrame, value: str = "count") -> DataFrame:
    """Share of the largest and of the sum.  Both totals are one-row aggregates, so no task gets all rows."""
    both = counts.agg(F.max(value).alias("_max"), F.sum(value).alias("_sum")).withColumn("_one", F.lit(1))
    out = counts.withColumn("_one", F.lit(1)).join(F.broadcast(both), "_one")
    return out.withColumn("of_max", F.try_divide(F.col(value).cast("double"), F.col("_max"))).withColumn("of_total", F.try_divide(F.col(value).cast("double"), F.col("_sum"))).drop("_one", "_max", "_sum")


def ranked_sources(cards: DataFrame) -> DataFrame:
    return counts_of(cards, "source_name").orderBy(F.desc("count"), "source_name")


def cleanup_counts(flags: DataFrame) -> DataFrame:
    """Sizes of the two reasons to delete and of their union."""
    return flags.agg(F.count(F.lit(1)).alias("mentions"), F.count_if("unrelated").alias("unrelated"), F.count_if("look_alike").alias("look_alike"), F.count_if(F.col("unrelated") | F.col("look_alike")).alias("deleted"))


def cycle_counters(outcomes: DataFrame, by: str | None = None) -> DataFrame:
    """Counters of a collection cycle from the one ``outcome`` of each item."""
    names = {"found": F.lit(True)} | {k: F.col("outcome") == k for k in ("skipped_old", "excluded_domain", "no_keyword", "inserted", "reprint", "duplicate")}
    sums = [F.count_if(c).alias(n) for n, c in names.items()]
    return (outcomes.groupBy(by) if by else outcomes.groupBy()).agg(*sums)


def links_file_counters(lines: DataFrame) -> DataFrame:
    """One row over parsed link-file lines."""
    return lines.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(F.col("kind") == "url").alias("url_lines"),
        F.count_distinct(F.when(~F.col("malformed"), F.col("url_hash"))).alias("unique_urls"),
        (F.count_if((F.col("kind") == "url") & ~F.col("malformed")) - F.count_distinct(F.when(~F.col("malformed"), F.col("url_hash")))).alias("duplicate_urls"),
        F.count_distinct(F.when(F.col("kind") == "heading", F.col("line_text"))).alias("groups"),
        F.count_if(F.col("malformed")).alias("malformed_urls"),
    )


def dashboard(mentions: DataFrame, sources: DataFrame, f: MentionFilters) -> dict[str, DataFrame]:
    """The five parts of the dashboard over one filter."""
    return {"total": total_change(mentions, f), "by_day": by_day(mentions, f), "by_sentiment": by_sentiment(mentions, f), "top_sources": top_sources(mentions, sources, f)}


def period(days: int, now: datetime) -> MentionFilters:
    start, end = periods.preset_range(f"{days}d", None, None, now)
    return MentionFilters(date_from=start, date_to=end)


def tone_counts(rows: DataFrame) -> DataFrame:
    """One row: how many there are and how many of each tone, as after lists have been merged."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in schema.SENTIMENTS])


def feed_counters(items: DataFrame, cutoff: datetime, by: str) -> DataFrame:
    """What a run over feeds did with their items: received, undated, older than the cutoff, kept."""
    at = F.col("published_at")
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("received"), F.count_if(at.isNull()).alias("undated"), F.count_if(at < F.lit(cutoff)).alias("too_old"), F.count_if(at >= F.lit(cutoff)).alias("kept"))


def by_host(cards: DataFrame, sources: DataFrame, domain: str, name: str = "source_id") -> DataFrame:
    """``cards`` with the source of the same host, ``www.`` apart; of several the smallest id."""
    known = sources.groupBy(url.domain_of("url").alias("_host")).agg(F.min(name).alias(name)).where("_host is not null")
    return cards.withColumn("_host", url.domain_of(domain)).join(known, "_host", "left").drop("_host")


def with_domain(counts: DataFrame, cards: DataFrame) -> DataFrame:
    """Outlets with the domain that their cards name, the first in the alphabet if they differ."""
    named = cards.where("source_domain <> ''").groupBy("source_name").agg(F.min("source_domain").alias("domain"))
    return counts.join(named, "source_name", "left")
