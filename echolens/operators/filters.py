"""Predicates over mentions, items, links and cards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.functions import dates, text, url
from echolens.operators.dedup import stored

# Terms that mark look-alikes of the brand, and retention defaults.
LOOK_ALIKES = ("астан", "медицин", "astana", "medic")
BACKFILL_DAYS = 60
MOST_ATTEMPTS = 3
PAGE_COLUMNS = ("id", "title", "text", "summary", "published_at", "found_at", "source_id", "source_label", "sentiment", "curated_link_id")


@dataclass(frozen=True)
class MentionFilters:
    """Optional predicates of feed and dashboard, all of which must hold."""

    sentiment: str | None = None
    source_id: object = None
    source_type: str | None = None
    language: str | None = None
    search: str | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None


def event_time() -> Column:
    return F.coalesce("published_at", "found_at")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filtered(mentions: DataFrame, f: MentionFilters) -> DataFrame:
    """``%`` and ``_`` of a search keep their meaning; instants are inclusive, an undated mention counts as found."""
    conditions = [F.col(c) == getattr(f, c) for c in ("sentiment", "source_id", "source_type", "language") if getattr(f, c) is not None]
    if f.search:
        conditions.append(F.col("title").ilike(f"%{f.search}%") | F.col("text").ilike(f"%{f.search}%"))
    if f.date_from is not None:
        conditions.append(event_time() >= F.lit(f.date_from))
    if f.date_to is not None:
        conditions.append(event_time() <= F.lit(f.date_to))
    return mentions.where(all_of(conditions))


def in_window(start: date, end: date, zone: str = dates.ZONE) -> Column:
    """Calendar days of the publication in a zone; undated mentions are outside every window."""
    return F.coalesce(dates.zoned_date("published_at", zone).between(F.lit(start), F.lit(end)), F.lit(False))


def pooled() -> Column:
    return F.col("curated_link_id").isNotNull()


def undated() -> Column:
    return F.col("published_at").isNull()


def selected_links(links: DataFrame, statuses: Sequence[str] = (), hosts: Sequence[str] = (), most_attempts: int | None = None, limit: int | None = None) -> DataFrame:
    """Links to process, oldest first."""
    conditions = []
    if statuses:
        conditions.append(F.col("status").isin(*statuses))
    if hosts:
        conditions.append(F.col("host").isin(*hosts))
    if most_attempts is not None:
        conditions.append(F.col("attempts") < most_attempts)
    out = links.where(all_of(conditions)).orderBy("created_at", "id")
    return out.limit(limit) if limit else out


def retryable(most_attempts: int = MOST_ATTEMPTS) -> Column:
    return F.col("status").isin("pending", "failed") & (F.col("attempts") < most_attempts)


def polled_sources(sources: DataFrame, kind: str) -> DataFrame:
    """Sources of a kind that are not disabled; failing ones are polled on."""
    return sources.where((F.col("type") == kind) & (F.col("status") != "disabled"))


def visible_cards(cards: DataFrame) -> DataFrame:
    return cards.where(F.col("status") != "duplicate")


def cards_in_window(cards: DataFrame, start: date, end: date) -> DataFrame:
    return cards.where(F.col("published_at").between(F.lit(start), F.lit(end)))


def names_brand(forms: Sequence[str], title: str = "title", body: str = "text") -> Column:
    return text.contains_any(text.haystack(title, body), forms)


def brand_forms(raw: str | None, usual: Sequence[str]) -> list[str]:
    """Forms of a comma-separated setting, distinct; the usual ones if it names none."""
    return list(dict.fromkeys(x.strip() for x in (raw or "").split(",") if x.strip())) or list(usual)


def too_old_for_backfill(now: datetime, days: int = BACKFILL_DAYS, first_run: Column | None = None) -> Column:
    """Dated items from before the backfill window of a source that never succeeded."""
    first = F.col("is_backfill") if first_run is None else first_run
    return first & F.coalesce(F.col("published_at") < F.lit(now - timedelta(days=days)), F.lit(False))


def before_earliest(earliest: datetime | None, c: str = "published_at") -> Column:
    """Strictly before the configured earliest date; undated articles are not."""
    return F.lit(False) if earliest is None else F.coalesce(F.col(c) < F.lit(earliest), F.lit(False))


def earliest_date(raw: str | None) -> datetime | None:
    """A configured ``YYYY-MM-DD``, or None for anything else."""
    try:
        return datetime.strptime((raw or "").strip(), "%Y-%m-%d")  # noqa: DTZ007
    except ValueError:
        return None


def looks_alike(term: str) -> Column:
    return F.lower(text.haystack("title", "text")).contains(term)


def brand_keywords(keywords: DataFrame, terms: Sequence[str] = LOOK_ALIKES) -> DataFrame:
    """Positive keywords whose phrase is none of the look-alike terms."""
    phrase = F.lower(F.trim("phrase"))
    return keywords.where(F.col("type").isin("required", "exact_phrase") & ~reduce(lambda a, b: a | b, (phrase.contains(t) for t in terms)))


def worth_reading(start: date | None, now: datetime) -> Column:
    """Links whose URL does not date them before the window."""
    if start is None:
        return F.lit(True)
    day = dates.url_date("url", now)
    return day.isNull() | (day >= F.lit(start))


def has_ink(*columns: str) -> Column:
    return all_of([F.coalesce(text.trimmed(c) != "", F.lit(False)) for c in columns])


def page_columns(mentions: DataFrame) -> DataFrame:
    """What a closed pool's page may read: never the address or the reprints."""
    return mentions.select(*[c for c in PAGE_COLUMNS if c in mentions.columns])


def redacted(rows: DataFrame, expose: bool = False) -> DataFrame:
    """Rows flagged ``url_hidden`` (or ``urlHidden``) without address and reprints, links in their texts masked; others as they are."""
    flag = next((c for c in ("url_hidden", "urlHidden") if c in rows.columns), None)
    if expose or flag is None:
        return rows
    hidden = F.coalesce(F.col(flag), F.lit(False))
    changes: dict[str, Column] = {}
    for c, kind in rows.dtypes:
        if c == "url":
            changes[c] = F.when(~hidden, F.col(c))
        elif c == "reprints":
            changes[c] = F.when(hidden, F.array().cast(kind)).otherwise(F.col(c))
        elif c in ("text", "summary", "title"):
            changes[c] = F.when(hidden, text.without_links(c)).otherwise(F.col(c))
        elif c in ("curated_link_id", "curatedLinkId"):
            changes[c] = F.when(~hidden, F.col(c))
    return rows.withColumns(changes)


def redacted_value(value: object, depth: int = 0, most: int = 8) -> object:
    """The same for nested JSON-like values outside a table, ``most`` levels deep."""
    import re

    if depth > most:
        return value
    if isinstance(value, list):
        return [redacted_value(x, depth + 1, most) for x in value]
    if not isinstance(value, dict):
        return value
    hidden = value.get("urlHidden") is True or value.get("url_hidden") is True
    out = {}
    for k, v in value.items():
        if hidden and k in ("text", "summary", "title"):
            out[k] = re.sub(r"(?i)https?://\S+", text.LINK_MARK, v) if isinstance(v, str) else v
        elif not (hidden and k in ("url", "reprints", "curatedLinkId", "curated_link_id")):
            out[k] = redacted_value(v, depth + 1, most)
    return out | ({"url": None, "reprints": []} if hidden else {})


#: Characters after a slash by which links and bodies meet, and of the pieces by which links without a slash do.
KEY, PIECE = 16, 3


def leaks(bodies: DataFrame, links: DataFrame) -> DataFrame:
    """``(body_id, link_id)`` wherever a body contains a link: its address, its path with query, or its host with path (a path of a slash alone says nothing).

    Case does not count, nor that JSON may write a slash as ``\\/``.  What
    stands after each slash of a link, ``KEY`` characters at most, stands after
    a slash of every body that contains the link; only its last part may go on
    there.  How many bodies have each such part is counted, and a link meets
    bodies by its rarest one, so a part that very many share (``/news``) is met
    only by links that have nothing else.  What has met is tested for
    containment.
    """
    plain = lambda c: F.lower(F.replace(F.col(c), F.lit("\\/"), F.lit("/")))
    b = bodies.select("body_id", plain("body").alias("_body"))
    part = lambda i: F.regexp_extract(F.lower(F.trim("url")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)([^#]*)", i)
    shapes = F.array(F.lower("url"), F.when(F.length(F.concat(part(2), part(3))) > 1, F.concat(part(2), part(3))), F.when(F.length(part(2)) > 1, F.concat(part(1), part(2))))
    needles = links.select("link_id", F.explode(F.array_distinct(F.array_compact(shapes))).alias("needle")).where("needle <> ''")
    parts_of = lambda c: F.regexp_extract_all(c, F.lit(f"(?s)(?=(/[^/]{{0,{KEY}}}))"), F.lit(1))
    trimmed = F.regexp_replace("needle", "/+$", "")
    last = F.regexp_extract(trimmed, f"(?s)(/[^/]{{0,{KEY}}})[^/]*$", 1)
    whole = parts_of(F.regexp_extract(trimmed, "(?s)^(.*)/[^/]*$", 1))
    keyed = needles.withColumn("_all", F.concat(F.transform(F.filter(whole, lambda p: F.length(p) > 1), lambda p: F.concat(F.lit("="), p)), F.array_compact(F.array(F.when(last != "", F.concat(F.lit("^"), last))))))
    spread = stored(keyed.select("link_id", "needle", F.explode("_all").alias("key")))
    lengths = [r[0] for r in spread.where("key like '^%'").select((F.length("key") - 1).alias("n")).distinct().collect()]  # KEY + 1 numbers at most
    starts = F.flatten(F.transform(F.col("_parts"), lambda p: F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(p)), lambda n: F.concat(F.lit("^"), F.substring(p, F.lit(1), n)))))
    both = F.array_distinct(F.concat(F.transform("_parts", lambda p: F.concat(F.lit("="), p)), starts))
    met = b.select("body_id", F.array_distinct(parts_of(F.col("_body"))).alias("_parts")).select("body_id", F.explode(both).alias("key"))
    met = stored(met.join(spread.select("key").distinct(), "key", "left_semi"))
    often = met.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    ranked = spread.join(often, "key", "left").groupBy("link_id", "needle").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "key")).alias("rarest"))
    chosen = ranked.where("rarest.often > 0").select("link_id", "needle", F.col("rarest.key").alias("key"))
    pairs = met.join(chosen, "key").select("body_id", "link_id", "needle")
    odd = keyed.where(F.size("_all") == 0).select("link_id", "needle", F.substring("needle", 1, PIECE).alias("key"))
    if odd.limit(1).count():
        pieces = b.select("body_id", F.explode(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("_body", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, PIECE + 1)])))).alias("key"))
        pairs = pairs.union(pieces.join(odd, "key").select("body_id", "link_id", "needle"))
    return pairs.distinct().join(b, "body_id").where(F.contains("_body", "needle")).select("body_id", "link_id").distinct()


def has_public_url(url_column: str = "url") -> Column:
    """Rows that show an address."""
    return F.coalesce(text.trimmed(url_column) != "", F.lit(False))


def article_urls(urls: DataFrame, c: str = "url") -> DataFrame:
    return urls.where(url.article_like(c))


def finds_in_period(finds: DataFrame, start: date | None, end: date, zone: str = dates.ZONE) -> DataFrame:
    """Dated finds in a window, newest first, one for each address; ``start`` None is all time."""
    from echolens.operators.order import first_of

    day = dates.zoned_date("published_at", zone)
    kept = finds.where(F.col("published_at").isNotNull() & (day <= F.lit(end)) & (F.lit(True) if start is None else day >= F.lit(start)))
    return first_of(kept.withColumn("_key", url.url_key("url")), ["_key"], ["ord"]).drop("_key").orderBy(F.desc("published_at"), "ord")
