"""Sinks and mutations as table rewrites: every function returns the new table, ``save`` writes it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions import text, url
from echolens.operators import dedup, filters
from echolens.operators.order import first_of


def save(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replaces a table: written beside it, then swapped in by renames.

    Readers never see half of a table, but for the moment between the two
    renames they see none and must try again.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to_path = jvm.org.apache.hadoop.fs.Path
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(staged)
    fs = to_path(path).getFileSystem(conf)
    if fs.exists(to_path(path)):
        fs.rename(to_path(path), to_path(old))
    if not fs.rename(to_path(staged), to_path(path)):
        raise OSError(f"cannot move {staged} to {path}")
    fs.delete(to_path(old), True)


def clear(table: DataFrame, path: str) -> None:
    save(table.limit(0), path)


def hashed(items: DataFrame) -> DataFrame:
    """Items with their content hash; the address stands in for an empty text."""
    body = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.col("url")).otherwise(F.col("text"))
    return items.withColumn("hash", text.content_hash("title", body))


def insert_outcomes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` with ``outcome`` (inserted, reprint, duplicate) and ``card_id``, the stored story it belongs to."""
    exact = dedup.exact_duplicates(new, stored)
    best = dedup.closest_reprints(new, stored).select(  # of known rows too: without them the rows would be hashed again for each step
        F.col("new_id").alias("id"), F.col("old_id").alias("reprint_of")
    )
    out = exact.join(best, "id", "left")
    outcome = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("reprint_of").isNotNull(), "reprint").otherwise("inserted")
    return out.withColumn("outcome", outcome).withColumn("card_id", F.coalesce("duplicate_of", "reprint_of")).drop("duplicate_of", "reprint_of")


def inserted(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The table with its new rows; a hash that is new twice enters once, by smallest id."""
    fresh = first_of(outcomes.where("outcome = 'inserted'").drop("outcome", "card_id"), ["hash"], ["id"])
    return stored.unionByName(fresh, allowMissingColumns=True)


def with_reprints(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Stored stories with the addresses of their reprints appended, each address once and never the story's own."""
    found = outcomes.where("outcome <> 'inserted'").groupBy(F.col("card_id").alias("id")).agg(F.collect_set(F.struct("url", "source_id", "found_at")).alias("_new"))
    rows = stored.join(found, "id", "left")
    known = F.transform("reprints", lambda r: r["url"])
    fresh = F.filter(F.array_sort("_new"), lambda r: (r["url"] != F.col("url")) & ~F.coalesce(F.array_contains(known, r["url"]), F.lit(False)))
    distinct = F.filter(fresh, lambda r, i: ~F.exists(F.slice(fresh, 1, i), lambda q: q["url"] == r["url"]))
    kind = stored.schema["reprints"].dataType.simpleString()
    return rows.withColumn("reprints", F.when(F.col("_new").isNull(), F.col("reprints")).otherwise(F.concat(F.coalesce("reprints", F.array().cast(kind)), distinct.cast(kind)))).select(stored.columns)


def published(finds: DataFrame, found_at: datetime) -> DataFrame:
    """The fact table that a search result replaces: one row for each address, those without one left out."""
    kept = finds.where(text.trimmed(F.coalesce("url", F.lit(""))) != "").withColumn("_key", url.url_key("url"))
    rows = first_of(kept, ["_key"], ["ord"])
    body = F.coalesce("summary", "snippet", F.lit("")) if "snippet" in finds.columns else F.coalesce("summary", F.lit(""))
    return rows.select(
        F.col("id"), "title", body.alias("text"), F.when(body != "", body).alias("summary"), "url", "published_at",
        F.lit(found_at).alias("found_at"), F.lit(None).cast("string").alias("source_id"), F.lit("news").alias("source_type"), "source_label", "sentiment",
        F.lit(True).alias("sentiment_manual"), text.salted_hash("dashboard", "id").alias("hash"), F.lit(True).alias("notification_sent"),
        F.lit(True).alias("is_backfill"), F.lit(False).alias("url_hidden"), F.lit(None).cast("string").alias("curated_link_id"),
    )


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those of the same key, others stay."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def set_setting(settings: DataFrame, key: str, value: str, now: datetime) -> DataFrame:
    return upserted(settings, settings.sparkSession.createDataFrame([(key, value, now)], settings.schema), "key")


def imported_links(links: DataFrame, parsed: DataFrame, excluded: Sequence[str], now: datetime) -> DataFrame:
    """The pool with links that are not in it yet, those of excluded hosts as ``excluded``."""
    new = parsed.join(links.select("url_hash"), "url_hash", "left_anti")
    status = F.when(url.excluded("host", excluded), "excluded").otherwise("pending")
    rows = new.select(F.col("url_hash").alias("id"), "url", "url_hash", "host", "group_label", status.alias("status"), F.lit(0).alias("attempts"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return links.unionByName(rows, allowMissingColumns=True)


def card_actions(cards: DataFrame, mentions: DataFrame, links: DataFrame) -> DataFrame:
    """What merging cards into mentions does: ``(card_id, mention_id, link_id, action, closes_link)``.

    An address that is stored is updated (or unchanged), else inserted, unless
    its title and summary are stored under another address (skipped).
    """
    c = first_of(cards.withColumn("_key", url.url_key("url")).withColumn("_dup", (F.col("status") == "duplicate").cast("int")), ["_key"], ["_dup", "ord"])
    c = c.withColumn("_hash", text.content_hash("title", "summary"))
    m = mentions.withColumn("_key", url.url_key("url")).groupBy("_key").agg(F.max_by(F.struct("id", "title", "text", "summary", "sentiment", "sentiment_manual", "published_at", "url_hidden", "curated_link_id"), "id").alias("m"))
    known = links.withColumn("_key", url.url_key("url")).groupBy("_key").agg(F.max_by(F.struct("id", "status", "mention_id"), "id").alias("l"))
    hashes = mentions.select(F.col("hash").alias("_hash"), F.lit(True).alias("_seen")).distinct()
    rows = c.join(m, "_key", "left").join(known, "_key", "left").join(hashes, "_hash", "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    unchanged = (
        same("m.title", "title") & same("m.text", "summary") & same("m.summary", "summary") & same("m.sentiment", "sentiment") & F.coalesce("m.sentiment_manual", F.lit(False))
        & (F.col("published_at").isNull() | F.col("m.published_at").cast("date").eqNullSafe(F.col("published_at")))
        & (F.col("l.id").isNull() | (same("m.curated_link_id", "l.id") & F.coalesce("m.url_hidden", F.lit(False))))
    )
    action = F.when(F.col("m.id").isNotNull() & unchanged, "unchanged").when(F.col("m.id").isNotNull(), "updated").when(F.coalesce("_seen", F.lit(False)), "skipped").otherwise("inserted")
    closes = F.col("l.id").isNotNull() & (action != "skipped") & ((F.col("l.status") != "processed") | ~same("l.mention_id", "m.id"))
    return rows.select(F.col("id").alias("card_id"), F.col("m.id").alias("mention_id"), F.col("l.id").alias("link_id"), action.alias("action"), closes.alias("closes_link"))


def after_attempt(links: DataFrame, outcomes: DataFrame, now: datetime, most_attempts: int = filters.MOST_ATTEMPTS) -> DataFrame:
    """Links after a run: processed, not relevant, or one failed attempt more (failed for good at the limit).

    ``outcomes(id, result, message, mention_id, date_source)`` has a result of
    ``processed``, ``not_relevant`` or ``error`` for each link that was tried.
    """
    o = outcomes.select("id", "result", F.col("message").alias("_message"), F.col("mention_id").alias("_mention"), F.col("date_source").alias("_source"))
    rows = links.join(o, "id", "left")
    tried, error = F.col("result").isNotNull(), F.col("result") == "error"
    attempts = F.col("attempts") + F.when(tried, 1).otherwise(0)
    status = F.when(error & (attempts >= most_attempts), "failed").when(error, "pending").when(tried, F.col("result")).otherwise(F.col("status"))
    done = F.col("result") == "processed"
    changes = {
        "status": status,
        "attempts": attempts,
        "last_error": F.when(done, F.lit(None)).when(tried, F.col("_message")).otherwise(F.col("last_error")),
        "last_attempt_at": F.when(tried, F.lit(now)).otherwise(F.col("last_attempt_at")),
        "processed_at": F.when(tried & ~error, F.lit(now)).otherwise(F.col("processed_at")),
        "mention_id": F.when(done, F.col("_mention")).otherwise(F.col("mention_id")),
        "date_source": F.when(done, F.col("_source")).otherwise(F.col("date_source")),
    }
    return rows.withColumns({k: v for k, v in changes.items() if k in links.columns}).select(links.columns)


def reset_preview(links: DataFrame, mentions: DataFrame, hosts: Sequence[str] = ()) -> DataFrame:
    chosen = links.where(F.col("host").isin(*hosts)) if hosts else links
    hit = mentions.join(chosen.select(F.col("id").alias("curated_link_id")), "curated_link_id", "left_semi")
    a = chosen.agg(F.count(F.lit(1)).alias("links")).withColumn("_one", F.lit(1))
    return a.join(hit.agg(F.count(F.lit(1)).alias("mentions")).withColumn("_one", F.lit(1)), "_one").drop("_one")


def reset(links: DataFrame, mentions: DataFrame, hosts: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Links back to pending and the mentions without those that they produced."""
    mine = F.col("host").isin(*hosts) if hosts else F.lit(True)
    mine = F.coalesce(mine, F.lit(False))
    kept = mentions.join(links.where(mine).select(F.col("id").alias("curated_link_id")), "curated_link_id", "left_anti").select(mentions.columns)
    blank = {"status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string"), "processed_at": F.lit(None).cast("timestamp"), "mention_id": F.lit(None).cast("string")}
    return links.withColumns({k: F.when(mine, v).otherwise(F.col(k)) for k, v in blank.items() if k in links.columns}), kept


def without_flagged(mentions: DataFrame, flags: DataFrame) -> DataFrame:
    """The table without rows that either clean-up reason flags."""
    return mentions.join(flags.where("unrelated or look_alike").select("id"), "id", "left_anti").select(mentions.columns)


def classified(mentions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Automatic tones written back where no person has set one; a summary only where one came."""
    v = verdicts.select("id", F.col("sentiment").alias("_s"), F.col("summary").alias("_y"))
    rows = mentions.join(v, "id", "left")
    free = ~F.coalesce("sentiment_manual", F.lit(False)) & F.col("_s").isNotNull()
    return rows.withColumns({"sentiment": F.when(free, F.col("_s")).otherwise(F.col("sentiment")), "summary": F.when(free & (F.coalesce("_y", F.lit("")) != ""), F.col("_y")).otherwise(F.col("summary"))}).select(mentions.columns)


def edited(mentions: DataFrame, edits: DataFrame) -> DataFrame:
    """Tones that people set: they win over everything and stay."""
    rows = mentions.join(edits.select("id", F.col("sentiment").alias("_s")), "id", "left")
    hit = F.col("_s").isNotNull()
    return rows.withColumns({"sentiment": F.coalesce("_s", "sentiment"), "sentiment_manual": hit | F.coalesce("sentiment_manual", F.lit(False))}).select(mentions.columns)


def refreshed(mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """New content of pool mentions (hidden rows only); the tone stays."""
    rows = mentions.join(pages.select("id", *[F.col(c).alias(f"_{c}") for c in ("title", "text", "published_at")]), "id", "left")
    mine = F.coalesce("url_hidden", F.lit(False)) & F.col("_title").isNotNull()
    return rows.withColumns({c: F.when(mine, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in ("title", "text", "published_at")}).select(mentions.columns)


def claimed(mentions: DataFrame, ids: DataFrame, sent: bool = True) -> DataFrame:
    """The notification flag taken before sending, or given back after a failure."""
    rows = mentions.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    return rows.withColumn("notification_sent", F.when(F.col("_hit"), F.lit(sent)).otherwise(F.col("notification_sent"))).select(mentions.columns)


def stamped(sources: DataFrame, outcomes: DataFrame, now: datetime) -> DataFrame:
    """Source health after a cycle from ``outcomes(id, ok, message, deep)``."""
    o = outcomes.select("id", F.col("ok").alias("_ok"), F.col("message").alias("_m"), F.col("deep").alias("_d"))
    rows = sources.join(o, "id", "left")
    on = F.col("status") != "disabled"
    return rows.withColumns({
        "status": F.when(F.col("_ok") & on, "active").when(~F.col("_ok") & on, "error").otherwise(F.col("status")),
        "last_success_at": F.when(F.col("_ok"), F.lit(now)).otherwise(F.col("last_success_at")),
        "last_error": F.when(F.col("_ok"), F.lit(None)).when(~F.col("_ok"), F.col("_m")).otherwise(F.col("last_error")),
        "last_deep_scan_at": F.when(F.col("_d"), F.lit(now)).otherwise(F.col("last_deep_scan_at")),
    }).select(sources.columns)


def with_blacklist(sources: DataFrame, domains: Sequence[str]) -> DataFrame:
    return sources.withColumn("status", F.when(url.excluded("url", domains), "disabled").otherwise(F.col("status")))


def removed_source(sources: DataFrame, mentions: DataFrame, source_id: object) -> tuple[DataFrame, DataFrame]:
    """Without a source; its mentions stay and lose the reference."""
    gone = F.col("source_id") == F.lit(source_id)
    return sources.where(F.col("id") != F.lit(source_id)), mentions.withColumn("source_id", F.when(~gone, F.col("source_id")))


def ensured_source(sources: DataFrame, row: DataFrame) -> DataFrame:
    """With the row, unless its address is there."""
    return sources.unionByName(row.join(sources.select("url"), "url", "left_anti"), allowMissingColumns=True)


def classification_dump(mentions: DataFrame) -> DataFrame:
    """What is exported after a classification run; no address of hidden rows."""
    return mentions.select("id", "title", F.when(~F.coalesce("url_hidden", F.lit(False)), F.col("url")).alias("url"), "sentiment", "summary")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def outcome_of(items: DataFrame, now: datetime, days: int, excluded: Sequence[str], matched: Column) -> DataFrame:
    """One ``outcome`` for each item in the order of a cycle's tests: too old, excluded domain, no keyword, else ``candidate``."""
    outcome = F.when(filters.too_old_for_backfill(now, days), "skipped_old").when(url.excluded("url", excluded), "excluded_domain").when(~matched, "no_keyword").otherwise("candidate")
    return items.withColumn("outcome", outcome)


def setting(spark: SparkSession, settings: DataFrame, key: str, usual: str | None = None) -> str | None:
    row = settings.where(F.col("key") == key).select("value").limit(1).collect()
    return row[0][0] if row else usual
