"""Payloads already fetched → items.  Every function maps a table of raw payloads to the item columns."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens import schema
from echolens.functions import dates, text, url
from echolens.operators.keywords import Keyword
from echolens.operators.merge import hashed
from echolens.operators.order import first_of
from echolens.session import small_batches

ITEM = "title string, text string, url string, published_at timestamp_ntz, source_label string"
NEWS_JSON = "struct<articles:array<struct<title:string,description:string,content:string,url:string,publishedAt:string>>>"
POSTS_JSON = "struct<response:struct<items:array<struct<id:bigint,owner_id:bigint,text:string,date:bigint>>>>"
ANSWER_JSON = "struct<output:array<struct<type:string,content:array<struct<type:string,text:string,annotations:array<struct<type:string,url:string,title:string,start_index:int,end_index:int>>>>>>>"
FINDS_JSON = "struct<items:array<struct<title:string,url:string,publishedAt:string,publication:string,summary:string,sentiment:string>>>"
STORED_JSON = "struct<savedAt:string,finds:array<struct<title:string,url:string,publishedAt:string,sourceName:string,domain:string,summary:string,sentiment:string>>>"


def _text(node: ET.Element, *names: str) -> str | None:
    """The first of the child elements that is there, by local name."""
    for name in names:
        for child in node:
            if child.tag.rpartition("}")[2] == name and (child.text or "").strip():
                return child.text.strip()
    return None


def _moment(value: str | None) -> pd.Timestamp | None:
    if not value:
        return None
    try:
        got = pd.Timestamp(value)
    except ValueError:
        try:
            got = pd.Timestamp(parsedate_to_datetime(value))
        except (ValueError, TypeError):
            return None
    return got.tz_convert("UTC").tz_localize(None) if got.tzinfo else got


def feed_entries(xml: str) -> list[tuple]:
    """``(title, text, url, published_at)`` of an RSS or Atom document; entries without title or link are left out, a broken document has none."""
    import re

    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out = []
    for node in (n for n in root.iter() if n.tag.rpartition("}")[2] in ("item", "entry")):
        links = [c for c in node if c.tag.rpartition("}")[2] == "link"]
        link = next(((c.text or "").strip() or c.get("href", "") for c in links if c.get("rel", "alternate") == "alternate"), "")
        title = _text(node, "title")
        body = _text(node, "description", "encoded", "content", "summary") or ""
        body = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", body)).strip()
        if title and link:
            out.append((title, body, link, _moment(_text(node, "published", "date", "pubDate", "updated"))))
    return out


def feed_items(payloads: DataFrame) -> DataFrame:
    """Items of ``payloads(source_id, payload)`` that hold feeds."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for s, p in zip(pdf["source_id"], pdf["payload"], strict=True):  # one feed's items at a time
                rows = [(s, *e, None) for e in feed_entries(p or "")]
                yield pd.DataFrame(rows, columns=["source_id", "title", "text", "url", "published_at", "source_label"])

    small_batches(payloads.sparkSession)
    kind = payloads.schema["source_id"].dataType.simpleString()
    return hashed(payloads.select("source_id", "payload").mapInPandas(run, f"source_id {kind}, {ITEM}"))


def news_items(payloads: DataFrame) -> DataFrame:
    """Articles of a news search's JSON; an empty description does not fall through to the content."""
    a = payloads.select("source_id", F.explode(F.from_json("payload", NEWS_JSON)["articles"]).alias("a"))
    rows = a.select("source_id", text.trimmed(F.coalesce("a.title", F.lit(""))).alias("title"), text.trimmed(F.coalesce("a.description", "a.content", F.lit(""))).alias("text"), text.trimmed(F.coalesce("a.url", F.lit(""))).alias("url"), dates.iso_instant("a.publishedAt").alias("published_at"), F.lit(None).cast("string").alias("source_label"))
    return hashed(rows.where("title <> '' and url <> ''"))


def post_items(payloads: DataFrame) -> DataFrame:
    """Posts of a social network's JSON; the first 200 characters are the title."""
    p = payloads.select("source_id", F.explode(F.from_json("payload", POSTS_JSON)["response"]["items"]).alias("p"))
    body = text.trimmed(F.coalesce("p.text", F.lit("")))
    rows = p.select("source_id", F.substring(body, 1, 200).alias("title"), body.alias("text"), F.format_string("https://vk.com/wall%d_%d", "p.owner_id", "p.id").alias("url"), F.when(F.col("p.date") != 0, F.timestamp_seconds("p.date")).alias("published_at"), F.lit(None).cast("string").alias("source_label"))
    return hashed(rows.where("text <> ''"))


def citation_snippet(t: Column, start: Column, end: Column) -> Column:
    """The line around a citation without link marks; the citation itself if that is too short."""
    low = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0))
    high = F.least(F.length(t), F.coalesce(end, F.length(t)))
    plain = lambda c: text.collapsed(F.regexp_replace(c, r"\(?\[[^\]]*\]\([^)]*\)\)?", ""))
    raw = F.when(low < high, F.substring(t, low + 1, high - low)).otherwise(t)
    line = F.concat(F.substring_index(F.substring(t, F.lit(1), low), "\n", -1), F.substring(t, low + 1, F.greatest(high - low, F.lit(0))), F.substring_index(F.substring(t, F.greatest(low, high) + 1, F.length(t)), "\n", 1))
    return F.when(F.length(plain(line)) >= 20, plain(line)).when(F.length(plain(raw)) >= F.length(plain(line)), plain(raw)).otherwise(text.trimmed(raw))


def cited_items(payloads: DataFrame) -> DataFrame:
    """One item for each cited address of a web search's answer, the first citation of an address."""
    answer = F.from_json("payload", ANSWER_JSON)
    o = payloads.select("source_id", F.posexplode(answer["output"]).alias("i", "o")).where("o.type = 'message'")
    c = o.select("source_id", "i", F.posexplode("o.content").alias("j", "c")).where("c.type = 'output_text' and c.text <> ''")
    a = c.select("source_id", "i", "j", F.col("c.text").alias("t"), F.posexplode("c.annotations").alias("k", "a")).where("a.type = 'url_citation' and a.url <> ''")
    snippet = citation_snippet(F.col("t"), F.col("a.start_index"), F.col("a.end_index"))
    nonempty = lambda c: F.when(c != "", c)
    rows = a.select("source_id", "i", "j", "k", snippet.alias("text"), F.col("a.url").alias("url"), text.trimmed(F.coalesce("a.title", F.lit(""))).alias("label"))
    rows = first_of(rows, ["source_id", "url"], ["i", "j", "k"])
    out = rows.select("source_id", F.coalesce(nonempty(F.col("label")), nonempty(F.substring("text", 1, 120)), F.col("url")).alias("title"), "text", "url", F.lit(None).cast("timestamp_ntz").alias("published_at"), F.coalesce(url.url_host("url"), "url").alias("source_label"))
    return hashed(out)


def tone(c: Column) -> Column:
    return F.when(c.isin(*schema.SENTIMENTS), c).otherwise(F.lit("undefined"))


def structured_finds(payloads: DataFrame) -> DataFrame:
    """Finds of a structured news answer; no find without title and a web address, a date only as a whole day (at noon)."""
    answer = F.from_json("payload", ANSWER_JSON)
    texts = F.flatten(F.transform(F.filter(answer["output"], lambda o: o["type"] == "message"), lambda o: F.transform(F.filter(o["content"], lambda c: c["type"] == "output_text"), lambda c: c["text"])))
    f = payloads.select("source_id", F.posexplode(F.from_json(F.array_join(texts, ""), FINDS_JSON)["items"]).alias("ord", "f"))
    host = url.url_host("f.url")
    day = F.when(F.col("f.publishedAt").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("f.publishedAt", "yyyy-MM-dd"))
    label = text.trimmed(F.coalesce("f.publication", F.lit("")))
    summary = text.trimmed(F.coalesce("f.summary", F.lit("")))
    rows = f.where(F.lower(F.trim("f.url")).rlike("^https?://") & host.isNotNull() & (F.col("f.title") != ""))
    return rows.select("source_id", "ord", text.trimmed("f.title").alias("title"), text.trimmed("f.url").alias("url"), dates.card_instant(day).alias("published_at"), F.when(label != "", label).otherwise(host).alias("source_name"), host.alias("domain"), F.when(summary != "", summary).alias("summary"), tone(F.col("f.sentiment")).alias("sentiment"))


def stored_finds(payloads: DataFrame) -> DataFrame:
    """Finds of the stored JSON, element by element: one without title or address, or with a broken date, is left out."""
    whole = F.from_json("payload", STORED_JSON)
    f = payloads.select("key", dates.iso_instant(whole["savedAt"]).alias("saved_at"), F.posexplode(whole["finds"]).alias("ord", "f"))
    at = dates.iso_instant("f.publishedAt")
    ok = (text.trimmed(F.coalesce("f.url", F.lit(""))) != "") & F.col("f.title").isNotNull() & (F.col("f.publishedAt").isNull() | at.isNotNull())
    return f.where(ok).select("key", "saved_at", "ord", "f.title", "f.url", at.alias("published_at"), F.coalesce("f.sourceName", F.lit("")).alias("source_name"), F.coalesce("f.domain", F.lit("")).alias("domain"), "f.summary", tone(F.col("f.sentiment")).alias("sentiment"))


def finds_json(finds: DataFrame, saved_at: Column, key: str = "key") -> DataFrame:
    """The stored form of each key's finds."""
    moment = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    one = F.struct("ord", "title", "url", moment(F.col("published_at")).alias("publishedAt"), F.col("source_name").alias("sourceName"), "domain", "summary", "sentiment")
    lists = finds.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("f"))
    return lists.select(key, F.to_json(F.struct(moment(saved_at).alias("savedAt"), F.transform("f", lambda x: x.dropFields("ord")).alias("finds")), {"ignoreNullFields": "false"}).alias("value"))


def find_views(finds: DataFrame) -> DataFrame:
    """Finds in the form of all other results."""
    return finds.select(F.concat_ws(":", F.lit("live"), "domain", "url").alias("id"), "title", F.col("source_name").alias("source_label"), "published_at", "sentiment", "summary", F.lit(None).cast("string").alias("snippet"), "url")


def verdicts(payloads: DataFrame) -> DataFrame:
    """``(id, sentiment, reason, summary)`` of classifier answers; unusable ones are left out."""
    v = F.from_json("payload", "struct<sentiment:string,reason:string,summary:string>")
    rows = payloads.select("id", F.lower(F.trim(v["sentiment"])).alias("sentiment"), F.trim(F.coalesce(v["reason"], F.lit(""))).alias("reason"), F.trim(F.coalesce(v["summary"], F.lit(""))).alias("summary"))
    return rows.where(F.col("sentiment").isin(*schema.SENTIMENTS))


def page_reads(payloads: DataFrame) -> DataFrame:
    """``(id, title, date, model_mentioned, fragments)`` of a model's page readings."""
    v = F.from_json("payload", "struct<title:string,date:string,mentioned:boolean,fragments:array<string>>")
    return payloads.select("id", F.trim(v["title"]).alias("title"), dates.iso_instant(v["date"]).alias("date"), F.coalesce(v["mentioned"], F.lit(False)).alias("model_mentioned"), F.coalesce(v["fragments"], F.array().cast("array<string>")).alias("fragments"))


def channel_name(c: Column | str) -> Column:
    """Name of a channel from its link, ``@name`` or the bare name; null for other links."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    linked = F.regexp_extract(t, r"(?i)^(?:https?://)?t\.me/(?:s/)?([A-Za-z0-9_]+)", 1)
    bare = F.regexp_extract(t, r"^@?([A-Za-z0-9_]{4,})$", 1)
    return F.coalesce(F.nullif(linked, F.lit("")), F.nullif(bare, F.lit("")))


def source_kind(c: Column | str) -> Column:
    """``struct<type, resolved_url>`` as far as the address itself tells: channel, feed by its ending, else a page to parse."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    name = channel_name(t)
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    kind = F.when(name.isNotNull(), "telegram").when(full.rlike(r"(?i)\.(xml|rss)(\?|$)"), "rss").otherwise("parser")
    return F.struct(kind.alias("type"), F.when(name.isNotNull(), F.concat(F.lit("https://t.me/"), name)).otherwise(full).alias("resolved_url"))


def _quoted(phrase: str) -> str:
    return f'"{phrase}"' if " " in phrase else phrase


def boolean_query(keywords: Sequence[Keyword]) -> str | None:
    """``(a OR "b c") NOT d`` for a search that takes operators; None without a positive keyword."""
    active = [k for k in keywords if k.is_active]
    positive = [_quoted(k.phrase) for k in active if k.type == "required"] + [f'"{k.phrase}"' for k in active if k.type == "exact_phrase"]
    if not positive:
        return None
    head = f"({' OR '.join(positive)})" if len(positive) > 1 else positive[0]
    return " ".join([head, *(f"NOT {_quoted(k.phrase)}" for k in active if k.type == "minus")])


def single_query(keywords: Sequence[Keyword]) -> str | None:
    """The first positive phrase, for a search without operators."""
    return next((k.phrase for k in keywords if k.is_active and k.type != "minus"), None)


def forms_query(keywords: Sequence[Keyword]) -> str | None:
    """All forms of positive keywords, quoted where needed and joined by OR."""
    forms = dict.fromkeys(f for k in keywords if k.is_active and k.type != "minus" for f in (k.phrase, *k.manual_forms) if f)
    return " OR ".join(map(_quoted, forms)) or None


def merged_channels(first: DataFrame, second: DataFrame, key: str = "url") -> DataFrame:
    """Rows of both, those of ``first`` for an address that both have."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return first_of(both, [key], ["_from", "title"]).drop("_from")


def deep_scan(sources: DataFrame, now, hours: int = 24, back_days: int = 60, look_back_days: int = 7) -> DataFrame:  # noqa: ANN001
    """``deep_due``, ``deep_cutoff`` and ``deep_pages`` for each source: all of the backfill on the first pass, a week later on."""
    first = F.col("last_success_at").isNull() | F.col("last_deep_scan_at").isNull()
    due = first | (F.lit(now) - F.expr(f"interval {hours} hours") > F.col("last_deep_scan_at"))
    cutoff = F.lit(now) - F.when(first, F.expr(f"interval {back_days} days")).otherwise(F.expr(f"interval {look_back_days} days"))
    return sources.withColumn("deep_due", due).withColumn("deep_cutoff", F.when(due, cutoff)).withColumn("deep_pages", F.when(due, F.when(first, 25).otherwise(5)))


def strategy(due: Column, sitemap_items: Column, page_items: Column, failed: Column) -> Column:
    """How a deep pass found its articles."""
    return F.when(~due, "skipped").when(failed, "error").when(sitemap_items > 0, "sitemap").when(page_items > 0, "html-pagination").otherwise("none")
