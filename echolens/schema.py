"""Table schemas and value domains; unknown values are rejected at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domains of the enumerated columns.
SENTIMENTS = ("positive", "negative", "neutral", "undefined")
SOURCE_TYPES = ("news", "social", "telegram", "reviews", "other", "social_search")
SOURCE_KINDS = ("rss", "telegram", "parser", "search_api", "social_api", "social_search_api", "curated")
KEYWORD_TYPES = ("required", "minus", "exact_phrase")
SOURCE_STATUSES = ("active", "disabled", "error")
LINK_STATUSES = ("pending", "processed", "not_relevant", "failed", "excluded")
DATE_SOURCES = ("page", "url", "model")
CARD_STATUSES = ("verified", "partial", "unverified", "duplicate")


#: Table schemas as DDL, which every reader takes.
REPRINT = "struct<url:string,source_id:string,found_at:timestamp>"
MENTION = (
    "id string, title string, text string, url string, published_at timestamp, found_at timestamp, source_id string, "
    "source_type string, language string, sentiment string, sentiment_manual boolean, hash string, keywords array<string>, "
    f"reprints array<{REPRINT}>, notification_sent boolean, is_backfill boolean, source_label string, summary string, "
    "url_hidden boolean, curated_link_id string, created_at timestamp"
)
SOURCE = ("id string, name string, url string, type string, status string, last_success_at timestamp, last_error string, created_by string, created_at timestamp, updated_at timestamp, last_deep_scan_at timestamp")
KEYWORD = ("id string, phrase string, type string, is_active boolean, language string, manual_forms array<string>")
SETTING = ("key string, value string, updated_at timestamp")
LINK = ("id string, url string, url_hash string, host string, group_label string, status string, attempts int, last_error string, date_source string, mention_id string, last_attempt_at timestamp, processed_at timestamp, created_at timestamp, updated_at timestamp")
CARD = ("id string, sourceName string, sourceDomain string, title string, url string, publishedAt date, publishedAtText string, summary string, sentiment string, sentimentNote string, status string, duplicateOf string")
ITEM = ("title string, text string, url string, published_at timestamp, hash string, source_label string")
FIND = ("title string, url string, published_at timestamp, source_name string, domain string, summary string, sentiment string")


def require(value: str | None, domain: tuple[str, ...], what: str) -> str | None:
    """``value`` if it is in ``domain`` or empty; anything else is an error naming the choices."""
    if value in (None, "") or value in domain:
        return value or None
    raise ValueError(f"{what} must be one of {', '.join(domain)}: {value!r}")


def in_domain(col: Column, domain: tuple[str, ...]) -> Column:
    return col.isin(*domain)
