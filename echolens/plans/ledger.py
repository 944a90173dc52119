"""Registered queries over ingest, state, sources, dates and rendering, with their SQL twins."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions import dates, render, sentiment, text, url
from echolens.operators import filters, keywords, merge, order, records, stats
from echolens.operators.keywords import Keyword
from echolens.plans import periods, views
from echolens.plans.catalog import ALMATY_DAY, AT, BRAND, IDENTITY, KEYED, REPRINTS, STORIES, TONES, URL_KEY, _stories, query, trim_sql, with_
from echolens.plans.views import CARDS, LINKS, MENTIONS, NOW, SOURCES, read
from echolens.sources import files, html, payloads

HASH = "sha256(lower({0}) || '|' || lower({1}))"
NONE = "CAST(NULL AS VARCHAR)"
SENDS = "CASE WHEN {0} THEN '2024-01-0' || CAST(doc_id % 9 + 1 AS VARCHAR) || '{1}' END"


def none(kind: str):  # noqa: ANN201
    return F.lit(None).cast(kind)


def label(prefix: str, c: str):  # noqa: ANN201
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# Sinks and state

SPLIT = """, hashed AS (SELECT id, title, text, published_at, sha256(lower(TITLE) || '|' || lower(TEXT)) AS hash FROM stories),
    ex AS (SELECT n.id, min(o.id) AS duplicate_of FROM (SELECT * FROM hashed WHERE id % 5 = 0) n LEFT JOIN (SELECT * FROM hashed WHERE id % 5 <> 0) o ON o.hash = n.hash GROUP BY 1),
    best AS (SELECT new_id, arg_min(old_id, (-(title_sim + text_sim), old_id)) AS old_id FROM pairs WHERE new_id % 5 = 0 AND old_id % 5 <> 0 GROUP BY 1)
    SELECT ex.id, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN old_id IS NOT NULL THEN 'reprint' ELSE 'inserted' END AS outcome, coalesce(duplicate_of, old_id) AS card_id FROM ex LEFT JOIN best ON best.new_id = ex.id""".replace("TITLE", trim_sql("title")).replace("TEXT", trim_sql("text"))  # fmt: skip


def _hashed_stories(spark: SparkSession, d: str) -> DataFrame:
    return _stories(spark, d).withColumn("hash", text.content_hash("title", "text"))


@query(with_(STORIES) + REPRINTS + SPLIT)
def story_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth story against all others: known by hash, a reprint, or new."""
    s = _hashed_stories(spark, d)
    return merge.insert_outcomes(s.where("id % 5 = 0"), s.where("id % 5 <> 0")).select("id", "outcome", "card_id")


@query(f"SELECT page_id AS id, hash, summary FROM (SELECT min(page_id) AS page_id, sha256('dashboard:' || CAST(min(page_id) AS VARCHAR)) AS hash, nullif(arg_min(left_html, page_id), '') AS summary FROM (SELECT *, {URL_KEY} AS address, substring(html, 1, 40) AS left_html FROM {KEYED}) GROUP BY address)")
def published_facts(spark: SparkSession, d: str) -> DataFrame:
    """The fact table after a search has found all pages: one row for each address."""
    finds = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("ord"), F.lit("t").alias("title"), "url", F.substring("html", 1, 40).alias("summary"), none("timestamp").alias("published_at"), F.lit("s").alias("source_label"), F.lit("neutral").alias("sentiment"))
    return merge.published(finds, NOW).select("id", "hash", "summary")


@query("SELECT 'k' || CAST(item_id AS VARCHAR) AS key, CASE WHEN item_id = 3 THEN 'set' ELSE text END AS value FROM benchmark UNION ALL SELECT 'brand', 'ouen'")
def settings_set(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "benchmark").select(label("k", "item_id").alias("key"), F.col("text").alias("value"), F.lit(NOW).alias("updated_at"))
    return merge.set_setting(merge.set_setting(table, "k3", "set", NOW), "brand", "ouen", NOW).select("key", "value")


@query(f"SELECT url_hash, CASE WHEN known THEN 'processed' WHEN host = 'example0.com' OR ends_with(host, '.example0.com') OR ends_with(host, '.net') THEN 'excluded' ELSE 'pending' END AS status FROM (SELECT sha256(identity) AS url_hash, any_value(host) AS host, bool_or(page_id % 2 = 0) AS known FROM {IDENTITY} GROUP BY 1)")
def imported_pool(spark: SparkSession, d: str) -> DataFrame:
    """The pool of every second page after all pages have been imported."""
    p = read(spark, d, "pages").select("page_id", F.lit("f").alias("file"), F.col("page_id").alias("line"), F.col("url").alias("value"))
    links = files.links_of(p.where("page_id % 2 = 0")).select(F.col("url_hash").alias("id"), "url", "url_hash", F.lit("processed").alias("status"))
    return merge.imported_links(links, files.links_of(p), ["example0.com", "net"], NOW).select("url_hash", "status")


@query(with_(MENTIONS) + "SELECT id, title, CASE WHEN NOT url_hidden THEN 'https://m.example/' || CAST(id AS VARCHAR) END AS url, sentiment FROM mentions")
def exported_classification(spark: SparkSession, d: str) -> DataFrame:
    m = views.mentions(spark, d).withColumn("url", label("https://m.example/", "id")).withColumn("summary", none("string"))
    return merge.classification_dump(m).drop("summary")


@query("SELECT '{\"n_nationkey\":' || CAST(n_nationkey AS VARCHAR) || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def exported_json(spark: SparkSession, d: str) -> DataFrame:
    return merge.json_rows(read(spark, d, "nation").select("n_nationkey", "n_name"))


@query("SELECT phrase, type, array_to_string(forms, '|') AS forms FROM (SELECT 'p' || CAST(item_id AS VARCHAR) AS phrase, 'required' AS type, CASE WHEN item_id % 2 = 0 THEN ['own', 'seed'] ELSE ['own'] END AS forms FROM benchmark UNION ALL SELECT 'q' || CAST(n_nationkey AS VARCHAR), 'minus', ['seed'] FROM nation)")
def seeded_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Forms that an operator has added stay, those of the seed follow; new phrases come in."""
    b = read(spark, d, "benchmark")
    table = b.select(F.col("item_id").cast("string").alias("id"), label("p", "item_id").alias("phrase"), F.lit("required").alias("type"), F.lit(True).alias("is_active"), F.lit("en").alias("language"), F.array(F.lit("own")).alias("manual_forms"))
    seed = b.where("item_id % 2 = 0").select(label("p", "item_id").alias("phrase"), F.lit("required").alias("type"))
    seed = seed.unionByName(read(spark, d, "nation").select(label("q", "n_nationkey").alias("phrase"), F.lit("minus").alias("type")))
    merged = keywords.upserted(table, seed.withColumn("language", F.lit("ru")).withColumn("manual_forms", F.array(F.lit("seed"))))
    return merged.select("phrase", "type", F.array_join("manual_forms", "|").alias("forms"))


@query(with_(MENTIONS) + "SELECT id, CASE WHEN source_id <> 3 THEN source_id END AS source_id FROM mentions")
def source_removed(spark: SparkSession, d: str) -> DataFrame:
    return merge.removed_source(views.sources(spark, d), views.mentions(spark, d), 3)[1].select("id", "source_id")


@query("SELECT h.id, count(DISTINCT n.url) FILTER (WHERE n.url <> h.url) AS reprints FROM (SELECT min(id) AS id, 'https://s.example/' || CAST(min(id) % 50 AS VARCHAR) AS url, hash FROM H WHERE id % 5 <> 0 GROUP BY hash) h LEFT JOIN (SELECT hash, 'https://s.example/' || CAST(id % 50 AS VARCHAR) AS url FROM H WHERE id % 5 = 0) n ON n.hash = h.hash GROUP BY 1".replace("H WHERE", "(SELECT doc_id AS id, sha256(text) AS hash FROM documents) WHERE"))
def reprints_listed(spark: SparkSession, d: str) -> DataFrame:
    """Stored stories with the addresses of new copies: each once, never the story's own."""
    kind = "array<struct<url:string,source_id:string,found_at:timestamp>>"
    s = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"), F.concat(F.lit("https://s.example/"), (F.col("doc_id") % 50).cast("string")).alias("url"))
    stored = order.first_of(s.where("id % 5 <> 0"), ["hash"], ["id"])
    new = s.where("id % 5 = 0").join(stored.select("hash", F.col("id").alias("card_id")), "hash", "left")
    outcomes = new.select("id", "url", F.lit("s").alias("source_id"), F.lit(NOW).cast("timestamp").alias("found_at"), F.when(F.col("card_id").isNull(), "inserted").otherwise("duplicate").alias("outcome"), "card_id")
    listed = merge.with_reprints(stored.withColumn("reprints", F.array().cast(kind)), outcomes)
    return listed.select("id", F.size("reprints").cast("long").alias("reprints"))


@query(with_(MENTIONS) + "SELECT id, id % 7 = 2 AS sent FROM mentions")
def notifications_claimed(spark: SparkSession, d: str) -> DataFrame:
    """Rows taken before sending; every other one is given back after a failure."""
    m = views.mentions(spark, d).select("id", F.lit(False).alias("notification_sent"))
    taken = merge.claimed(m, m.where("id % 7 in (2, 3)").select("id"))
    return merge.claimed(taken, m.where("id % 7 = 3").select("id"), sent=False).select("id", F.col("notification_sent").alias("sent"))


@query(with_(MENTIONS) + "SELECT id, CASE WHEN url_hidden AND id % 2 = 0 THEN 'new ' || CAST(id AS VARCHAR) ELSE title END AS title, sentiment FROM mentions")
def contents_refreshed(spark: SparkSession, d: str) -> DataFrame:
    m = views.mentions(spark, d)
    pages = m.where("id % 2 = 0").select("id", label("new ", "id").alias("title"), none("string").alias("text"), none("timestamp").alias("published_at"))
    return merge.refreshed(m, pages).select("id", "title", "sentiment")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN 'disabled' WHEN n_nationkey % 3 = 0 THEN 'active' WHEN n_nationkey % 3 = 1 THEN 'error' ELSE 'active' END AS status, CASE WHEN n_nationkey % 3 = 1 THEN 'HTTP 500' END AS last_error FROM nation")
def sources_stamped(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 == 4, "disabled").otherwise("active").alias("status"), none("timestamp_ntz").alias("last_success_at"), none("string").alias("last_error"), none("timestamp_ntz").alias("last_deep_scan_at"))
    told = s.where("id % 3 < 2").select("id", (F.col("id") % 3 == 0).alias("ok"), F.lit("HTTP 500").alias("message"), F.lit(False).alias("deep"))
    return merge.stamped(s, told, NOW).select("id", "status", "last_error")


@query(f"SELECT page_id AS id, CASE WHEN h = 'example0.com' OR ends_with(h, '.example0.com') OR ends_with(h, '.org') THEN 'disabled' ELSE 'active' END AS status FROM (SELECT page_id, host AS h FROM {IDENTITY})")
def sources_blacklisted(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.lit("active").alias("status"))
    return merge.with_blacklist(s, ["example0.com", "org"]).select("id", "status")


@query(with_(SOURCES) + "SELECT id FROM sources WHERE id % 3 <> 1 AND id % 2 = 0")
def polled(spark: SparkSession, d: str) -> DataFrame:
    s = views.sources(spark, d).select("id", F.when(F.col("id") % 2 == 0, "rss").otherwise("parser").alias("type"), F.when(F.col("id") % 3 == 1, "disabled").when(F.col("id") % 3 == 2, "error").otherwise("active").alias("status"))
    return filters.polled_sources(s, "rss").select("id")


# Predicates

PAGE = "SELECT page_id AS id, page_id AS ord, url, TIMESTAMP '2024-01-31 10:00:00' - to_days(CAST(page_id % 40 AS INT)) AS published_at FROM pages"


def _finds(spark: SparkSession, d: str) -> DataFrame:
    at = F.expr("timestamp_ntz'2024-01-31 10:00:00' - make_dt_interval(cast(page_id % 40 as int))")
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("ord"), "url", at.alias("published_at"))


@query(with_(MENTIONS) + f"SELECT id, coalesce(published_at < TIMESTAMP '2024-01-10 00:00:00', false) AS early FROM mentions")
def before_the_earliest(spark: SparkSession, d: str) -> DataFrame:
    return views.mentions(spark, d).select("id", filters.before_earliest(datetime(2024, 1, 10)).alias("early"))  # noqa: DTZ001


@query("SELECT doc_id, strpos(u, '/2019/') = 0 AS worth FROM (SELECT doc_id, 'https://w.example/' || CASE doc_id % 3 WHEN 0 THEN '2024/01/' ELSE CASE doc_id % 3 WHEN 1 THEN '2019/07/' ELSE 'story/' END END || 'n' || chr(CAST(97 + doc_id % 26 AS INT)) AS u FROM documents)")
def worth_reading(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    u = F.concat(F.lit("https://w.example/"), F.when(k == 0, "2024/01/").when(k == 1, "2019/07/").otherwise("story/"), F.lit("n"), F.expr("chr(97 + doc_id % 26)"))
    return read(spark, d, "documents").select("doc_id", u.alias("url")).select("doc_id", filters.worth_reading(date(2023, 6, 1), NOW).alias("worth"))


@query(f"SELECT min(id) AS id FROM (SELECT p.*, {URL_KEY} AS address FROM ({PAGE}) p JOIN {KEYED} u ON u.page_id = p.id) WHERE CAST(published_at + INTERVAL 5 HOUR AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY address")
def period_finds(spark: SparkSession, d: str) -> DataFrame:
    """Dated finds of three weeks in a zone five hours ahead, one for each address."""
    return filters.finds_in_period(_finds(spark, d), date(2024, 1, 5), date(2024, 1, 25), "Etc/GMT-5").select("id")


@query(f"SELECT doc_id, coalesce({trim_sql('text')} <> '', false) AND coalesce({trim_sql('source')} <> '', false) AS inked FROM documents")
def with_ink(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", filters.has_ink("text", "source").alias("inked"))


@query(with_(MENTIONS) + "SELECT id, title, text, published_at, found_at, source_id, source_label, sentiment, curated_link_id FROM mentions WHERE curated_link_id IS NOT NULL")
def closed_page(spark: SparkSession, d: str) -> DataFrame:
    return filters.page_columns(views.mentions(spark, d).where(filters.pooled()).withColumn("url", F.lit("x")))


@query("WITH b AS (SELECT page_id, replace(html, '\\/', '/') AS h FROM pages), l AS (SELECT page_id, lower(url) AS u, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^#]*)', 1)) AS p, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) || lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)) AS q, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)) AS r FROM pages) SELECT b.page_id AS body_id, l.page_id AS link_id FROM b JOIN l ON contains(lower(b.h) || lower(CASE WHEN b.page_id % 3 = 0 THEN (SELECT max(u) FROM l x WHERE x.page_id = b.page_id) ELSE '' END), l.u) OR (length(l.p) > 1 AND contains(lower(b.h) || lower(CASE WHEN b.page_id % 3 = 0 THEN (SELECT max(u) FROM l x WHERE x.page_id = b.page_id) ELSE '' END), l.p)) OR (length(l.r) > 1 AND contains(lower(b.h) || lower(CASE WHEN b.page_id % 3 = 0 THEN (SELECT max(u) FROM l x WHERE x.page_id = b.page_id) ELSE '' END), l.q))")
def leaked_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose source shows a link of the pool; every third one also names its own address, escaped and in capitals."""
    p = read(spark, d, "pages")
    own = F.when(F.col("page_id") % 3 == 0, F.replace(F.upper("url"), F.lit("/"), F.lit("\\/"))).otherwise(F.lit(""))
    bodies = p.select(F.col("page_id").alias("body_id"), F.concat("html", own).alias("body"))
    return filters.leaks(bodies, p.select(F.col("page_id").alias("link_id"), "url"))


@query(with_(MENTIONS) + "SELECT id FROM mentions WHERE NOT url_hidden")
def public_rows(spark: SparkSession, d: str) -> DataFrame:
    m = views.mentions(spark, d).withColumn("url", F.when(~F.col("url_hidden"), label("https://m.example/", "id")).otherwise(F.lit(" ")))
    return m.where(filters.has_public_url()).select("id")


# Aggregates and orders

RUN = "SELECT id, status, CASE WHEN id % 3 = 0 THEN 'parser' WHEN id % 3 = 1 THEN 'model' END AS read_via, CASE id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'undefined' END AS sentiment, CASE id % 5 WHEN 0 THEN 'page' WHEN 1 THEN 'url' WHEN 2 THEN 'model' END AS date_source FROM links"


@query(with_(LINKS) + f"SELECT count(*) AS attempted, count(*) FILTER (WHERE status = 'processed') AS status_processed, count(*) FILTER (WHERE status = 'failed') AS status_failed, count(*) FILTER (WHERE read_via = 'parser') AS read_by_parser, count(*) FILTER (WHERE read_via = 'model') AS read_by_model, count(*) FILTER (WHERE sentiment = 'positive') AS sentiment_positive, count(*) FILTER (WHERE status = 'processed' AND date_source IS NOT NULL) AS with_date, count(*) FILTER (WHERE status = 'processed' AND date_source IS NULL) AS without_date, count(*) FILTER (WHERE status = 'processed' AND date_source = 'url') AS date_url FROM ({RUN})")
def pool_run_tally(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    rows = views.links(spark, d).select("id", "status", F.when(i % 3 == 0, "parser").when(i % 3 == 1, "model").alias("read_via"), F.when(i % 4 == 0, "positive").when(i % 4 == 1, "negative").otherwise("undefined").alias("sentiment"), F.when(i % 5 == 0, "page").when(i % 5 == 1, "url").when(i % 5 == 2, "model").alias("date_source"))
    return stats.run_tally(rows).select("attempted", "status_processed", "status_failed", "read_by_parser", "read_by_model", "sentiment_positive", "with_date", "without_date", "date_url")


@query(f"SELECT count(*) AS total_lines, count(*) FILTER (WHERE page_id % 9 <> 0 AND page_id % 10 <> 4) AS url_lines, count(DISTINCT identity) FILTER (WHERE page_id % 9 <> 0 AND page_id % 10 <> 4) AS unique_urls, count(*) FILTER (WHERE page_id % 9 <> 0 AND page_id % 10 <> 4) - count(DISTINCT identity) FILTER (WHERE page_id % 9 <> 0 AND page_id % 10 <> 4) AS duplicate_urls, count(DISTINCT CASE WHEN page_id % 9 = 0 THEN page_id % 4 END) AS groups, 0 AS malformed_urls FROM {IDENTITY}")
def links_file_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    value = F.when(k % 9 == 0, F.concat(F.lit("Group "), (k % 4).cast("string"))).when(k % 10 == 4, "").otherwise(F.col("url"))
    return stats.links_file_counters(files.link_lines(read(spark, d, "pages").select(F.lit("f").alias("file"), k.alias("line"), value.alias("value")))).withColumn("malformed_urls", F.col("malformed_urls").cast("int"))


@query(with_(MENTIONS) + f"SELECT count(*) AS total, {TONES.format('true')} FROM mentions WHERE source_type <> 'reviews'")
def merged_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals counted again after two lists are merged by address, over what is shown."""
    m = views.mentions(spark, d).where("source_type <> 'reviews'").select("id", "sentiment", F.col("id").cast("string").alias("title"), "source_type")
    return stats.tone_counts(payloads.merged_channels(m.where("source_type in ('news', 'social')"), m.where("source_type <> 'news'"), "id"))


FEED_RUN = "SELECT id, published_at, id % 6 = 5 AS failed FROM mentions"


@query(with_(MENTIONS) + f"SELECT source_id, count(*) AS received, count(*) FILTER (WHERE published_at IS NULL) AS undated, count(*) FILTER (WHERE published_at < {AT} - INTERVAL 20 DAY) AS too_old, count(*) FILTER (WHERE published_at >= {AT} - INTERVAL 20 DAY) AS kept FROM mentions GROUP BY 1")
def feed_run_counters(spark: SparkSession, d: str) -> DataFrame:
    return stats.feed_counters(views.mentions(spark, d), NOW - timedelta(days=20), "source_id")


@query("SELECT c.item_id AS card, n.n_nationkey AS source_id FROM benchmark c LEFT JOIN nation n ON n.n_nationkey = c.item_id % 30")
def card_sources(spark: SparkSession, d: str) -> DataFrame:
    """Cards with the source of the same host."""
    cards = read(spark, d, "benchmark").select(F.col("item_id").alias("card"), F.concat(F.lit("WWW.s"), (F.col("item_id") % 30).cast("string"), F.lit(".kz")).alias("source_domain"))
    known = read(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), F.concat(F.lit("https://s"), F.col("n_nationkey").cast("string"), F.lit(".kz/news")).alias("url"))
    return stats.by_host(cards, known, "source_domain").select("card", "source_id")


@query(with_(CARDS) + "SELECT source_name, count(*) AS count, source_name || ' — ' || CAST(count(*) AS VARCHAR) || CASE WHEN source_name <> 'outlet3' THEN ' (<code>' || source_name || '.kz</code>)' ELSE '' END AS line FROM cards GROUP BY 1")
def outlet_lines(spark: SparkSession, d: str) -> DataFrame:
    c = views.cards(spark, d)
    domains = c.where("source_name <> 'outlet3'").select("source_name", F.concat("source_name", F.lit(".kz")).alias("source_domain"))
    return render.source_lines(stats.with_domain(stats.counts_of(c, "source_name"), domains)).select("source_name", "count", "line")


@query(with_(LINKS) + "SELECT id, host_id FROM links WHERE status = 'failed' ORDER BY host_id, id")
def problem_links(spark: SparkSession, d: str) -> DataFrame:
    rows = views.links(spark, d).withColumn("host", F.col("host_id").cast("string"))
    return order.problems_first(rows.where("status = 'failed'")).select("id", "host_id")


# Addresses, dates, texts

@query(f"SELECT page_id, host AS domain FROM {IDENTITY}")
def domains(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", url.domain_of("url").alias("domain"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN u || '|' || u || '/' WHEN doc_id % 3 = 1 THEN u || '/|' || u ELSE u || '?q' END AS both FROM (SELECT doc_id, 'https://v.example/p' || CAST(doc_id AS VARCHAR) AS u FROM documents)")
def address_variants(spark: SparkSession, d: str) -> DataFrame:
    k, u = F.col("doc_id") % 3, label("https://v.example/p", "doc_id")
    shown = F.when(k == 0, u).when(k == 1, F.concat(u, F.lit("/"))).otherwise(F.concat(u, F.lit("?q")))
    return read(spark, d, "documents").select("doc_id", F.array_join(url.slash_variants(shown), "|").alias("both"))


@query("SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 4 <> 3 AS real FROM orders")
def calendar_dates(spark: SparkSession, d: str) -> DataFrame:
    """Written days; every fourth one is not in the calendar."""
    shown = F.when(F.col("o_orderkey") % 4 == 3, F.concat(F.year("o_orderdate").cast("string"), F.lit("-02-30"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.to_date(dates.iso_instant(shown)).alias("day"), dates.is_calendar_date(shown).alias("real"))


@query("SELECT order_id, CASE order_id % 4 WHEN 0 THEN day WHEN 1 THEN CAST(date_trunc('month', day) AS DATE) END AS found FROM (SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS day FROM orders)")
def sitemap_dates(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("day"))
    k, show = F.col("order_id") % 4, lambda p: F.date_format("day", p)
    u = F.concat(F.lit("https://s.example/"), F.when(k == 0, F.concat(show("yyyy/MM/dd"), F.lit("/x"))).when(k == 1, F.concat(show("yyyy-M"), F.lit("/slug"))).when(k == 2, F.concat(F.lit("a"), show("yyyy/MM/dd"), F.lit("/x"))).otherwise(show("yyyy")))
    return o.select("order_id", dates.sitemap_url_date(u).alias("found"))


@query(f"SELECT id, CASE WHEN id % 2 = 0 AND page_ok THEN page WHEN id % 3 = 0 THEN url WHEN id % 5 = 0 THEN model END AS date, CASE WHEN id % 2 = 0 AND page_ok THEN 'page' WHEN id % 3 = 0 THEN 'url' WHEN id % 5 = 0 THEN 'model' END AS source FROM (SELECT event_id AS id, ts AS page, event_id % 4 <> 0 AS page_ok, TIMESTAMP '2020-05-01 00:00:00' AS url, TIMESTAMP '2021-06-01 00:00:00' AS model FROM events)")
def resolved_dates(spark: SparkSession, d: str) -> DataFrame:
    """Page before address before model, each only if plausible: some pages are dated ten years ahead."""
    i = F.col("event_id")
    page = F.when(i % 4 == 0, F.col("ts") + F.expr("interval 10 years")).otherwise(F.col("ts"))
    e = read(spark, d, "events").select(i.alias("id"), F.when(i % 2 == 0, page).cast("timestamp_ntz").alias("page"), F.when(i % 3 == 0, F.lit(datetime(2020, 5, 1))).cast("timestamp_ntz").alias("url"), F.when(i % 5 == 0, F.lit(datetime(2021, 6, 1))).cast("timestamp_ntz").alias("model"))  # noqa: DTZ001
    return e.select("id", dates.resolved_date(F.col("page"), F.col("url"), F.col("model"), datetime(2025, 1, 1)).alias("r")).select("id", "r.date", "r.source")  # noqa: DTZ001


@query("SELECT o_orderkey AS order_id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS noon, strftime(CAST(o_orderdate AS DATE), '%d.%m.%Y') AS shown FROM orders")
def card_instants(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), dates.card_instant(F.col("o_orderdate").cast("date")).alias("noon"))
    return o.select("order_id", "noon", dates.displayed("noon").alias("shown"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST('2024-01-0' || CAST(doc_id % 9 + 1 AS VARCHAR) AS DATE) END AS day FROM documents")
def only_date_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that write one day twice, two days, or none."""
    n = (F.col("doc_id") % 9 + 1).cast("string")
    one = F.concat(F.lit("on 0"), n, F.lit(".01.2024 and again "), n, F.lit(" января 2024 "))
    shown = F.when(F.col("doc_id") % 3 == 0, one).when(F.col("doc_id") % 3 == 1, F.concat(one, F.lit(" or 2020-02-03"))).otherwise(F.lit("no day 2024-02-31"))
    return html.only_dates(read(spark, d, "documents").select("doc_id", shown.alias("t")), "doc_id", "t")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'страница недоступна: HTTP 404 (h.kz)' WHEN 1 THEN 'доступ к странице закрыт (h.kz)' WHEN 2 THEN 'превышено время ожидания (h.kz)' ELSE 'broken at <ссылка h.kz> here' END AS said FROM documents")
def failure_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, "HTTP 404 for https://h.kz/a").when(k == 1, "HTTP 403").when(k == 2, "request TIMEOUT").otherwise("broken at https://h.kz/b here")
    return read(spark, d, "documents").select("doc_id", text.error_text(raw, F.lit("h.kz")).alias("said"))


# Payloads

NEWS = f"SELECT doc_id AS source_id, {trim_sql('source')} AS title, {trim_sql('text')} AS text, 'https://n.example/' || CAST(doc_id AS VARCHAR) AS url, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-05 10:00:00' END AS published_at FROM documents"


@query(f"SELECT source_id, title, text, url, published_at, {HASH.format('title', 'text')} AS hash FROM (SELECT source_id, title, CASE WHEN text = '' THEN url ELSE text END AS b, text, url, published_at FROM ({NEWS})) WHERE title <> ''")
def news_payloads(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.col("source").alias("title"), F.col("text").alias("description"), F.lit("unused").alias("content"), label("https://n.example/", "doc_id").alias("url"), F.when(F.col("doc_id") % 2 == 0, "2024-01-05T10:00:00Z").alias("publishedAt"))
    p = read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.to_json(F.struct(F.array(one).alias("articles"))).alias("payload"))
    return payloads.news_items(p).select("source_id", "title", "text", "url", "published_at", "hash")


@query(f"SELECT doc_id AS source_id, substring(t, 1, 200) AS title, t AS text, 'https://vk.com/wall-7_' || CAST(doc_id AS VARCHAR) AS url FROM (SELECT doc_id, {trim_sql('text')} AS t FROM documents) WHERE t <> ''")
def post_payloads(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.col("doc_id").alias("id"), F.lit(-7).cast("long").alias("owner_id"), "text", F.lit(1_700_000_000).cast("long").alias("date"))
    p = read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.to_json(F.struct(F.struct(F.array(one).alias("items")).alias("response"))).alias("payload"))
    return payloads.post_items(p).select("source_id", "title", "text", "url")


@query("SELECT doc_id AS source_id, 'https://c' || CAST(doc_id % 7 AS VARCHAR) || '.example/x' AS url, 'c' || CAST(doc_id % 7 AS VARCHAR) || '.example' AS source_label, CASE WHEN doc_id % 2 = 0 THEN 'Label' ELSE substring(t, 1, 120) END AS title, t AS text FROM (SELECT doc_id, 'before this ' || CAST(doc_id AS VARCHAR) || ' was said at length' AS t FROM documents)")
def cited_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Answers that cite one address twice; the line around the first citation, without link marks, is the text."""
    line = F.concat(F.lit("before this "), F.col("doc_id").cast("string"), F.lit(" was said ([mark](https://x.example)) at length"))
    address = F.concat(F.lit("https://c"), (F.col("doc_id") % 7).cast("string"), F.lit(".example/x"))
    cite = lambda a, b: F.struct(F.lit("url_citation").alias("type"), address.alias("url"), F.when(F.col("doc_id") % 2 == 0, " Label ").otherwise("").alias("title"), F.lit(a).alias("start_index"), F.lit(b).alias("end_index"))
    body = F.struct(F.lit("output_text").alias("type"), F.concat(F.lit("first line\n"), line, F.lit("\nlast line that is long enough")).alias("text"), F.array(cite(14, 20), cite(0, 4)).alias("annotations"))
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(body).alias("content"))).alias("output")))
    p = read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), payload.alias("payload"))
    return payloads.cited_items(p).select("source_id", "url", "source_label", "title", "text")


FIND = f"SELECT doc_id AS source_id, {trim_sql('source')} AS title, 'https://www.f' || CAST(doc_id % 5 AS VARCHAR) || '.example/' || CAST(doc_id AS VARCHAR) AS url, 'f' || CAST(doc_id % 5 AS VARCHAR) || '.example' AS domain, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-05 12:00:00' END AS published_at, CASE WHEN lang IN ('de', 'en') THEN 'positive' ELSE 'undefined' END AS sentiment FROM documents"


@query(FIND)
def structured_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A model's finds: whole days only, unknown tones undefined, no find without a web address."""
    i = F.col("doc_id")
    address = F.concat(F.lit("https://www.f"), (i % 5).cast("string"), F.lit(".example/"), i.cast("string"))
    one = lambda u: F.struct(F.col("source").alias("title"), u.alias("url"), F.when(i % 3 == 0, "2024-01-05").otherwise("2024-01").alias("publishedAt"), F.lit("").alias("publication"), F.lit("").alias("summary"), F.when(F.col("lang").isin("de", "en"), "positive").otherwise("glad").alias("sentiment"))
    inner = F.to_json(F.struct(F.array(one(address), one(F.lit("ftp://f.example/x"))).alias("items")))
    body = F.struct(F.lit("output_text").alias("type"), inner.alias("text"))
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(body).alias("content"))).alias("output")))
    p = read(spark, d, "documents").select(i.alias("source_id"), "source", payload.alias("payload"))
    return payloads.structured_finds(p).select("source_id", "title", "url", "domain", "published_at", "sentiment")


@query("SELECT doc_id AS key, source AS title, 'live:s.example:https://s.example/' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 = 1 THEN TIMESTAMP '2024-01-05 12:00:00' END AS published_at FROM documents WHERE doc_id % 4 <> 3")
def finds_stored_and_read(spark: SparkSession, d: str) -> DataFrame:
    """Finds written to their stored form and read back; one without an address is left out."""
    i = F.col("doc_id")
    finds = read(spark, d, "documents").select(i.alias("key"), i.alias("ord"), F.col("source").alias("title"), F.when(i % 4 == 3, "").otherwise(label("https://s.example/", "doc_id")).alias("url"), F.when(i % 4 == 1, F.lit(datetime(2024, 1, 5, 12))).cast("timestamp").alias("published_at"), F.lit("s").alias("source_name"), F.lit("s.example").alias("domain"), none("string").alias("summary"), F.lit("neutral").alias("sentiment"))  # noqa: DTZ001
    stored = payloads.finds_json(finds, F.lit(NOW).cast("timestamp")).select("key", F.col("value").alias("payload"))
    read_back = payloads.stored_finds(stored)
    return payloads.find_views(read_back.withColumn("k", F.col("key"))).select("id", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at")).withColumn("key", F.regexp_extract("id", "([0-9]+)$", 1).cast("long"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'telegram' WHEN regexp_matches(u, '(?i)\\.(xml|rss)(\\?|$)') THEN 'rss' ELSE 'parser' END AS type, CASE WHEN page_id % 3 = 0 THEN 'https://t.me/chan' || CAST(page_id AS VARCHAR) ELSE u END AS resolved_url FROM (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'https://f.example/' || CAST(page_id AS VARCHAR) || '.xml' ELSE trim(url) END AS u FROM pages)")
def source_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    shown = F.when(k % 3 == 0, label("@chan", "page_id")).when(k % 3 == 1, F.concat(label("https://f.example/", "page_id"), F.lit(".xml"))).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", payloads.source_kind(shown).alias("s")).select("page_id", "s.type", "s.resolved_url")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'name_' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'abcd' || CAST(doc_id AS VARCHAR) WHEN 2 THEN 'Chan' END AS name FROM documents")
def channel_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    shown = F.when(k == 0, F.concat(label("https://t.me/s/name_", "doc_id"), F.lit("?x"))).when(k == 1, label("@abcd", "doc_id")).when(k == 2, "T.me/Chan").otherwise("https://x.example/a")
    return read(spark, d, "documents").select("doc_id", payloads.channel_name(shown).alias("name"))


@query("SELECT n_nationkey AS id, n_nationkey % 3 <> 1 AS deep_due, CASE n_nationkey % 3 WHEN 0 THEN 25 WHEN 2 THEN 5 END AS deep_pages, CASE n_nationkey % 3 WHEN 0 THEN TIMESTAMP '2023-12-02 00:00:00' WHEN 2 THEN TIMESTAMP '2024-01-24 00:00:00' END AS deep_cutoff FROM nation")
def deep_passes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    s = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(k != 0, F.lit(NOW)).alias("last_success_at"), F.when(k == 1, F.lit(NOW - timedelta(hours=3))).when(k == 2, F.lit(NOW - timedelta(days=2))).alias("last_deep_scan_at"))
    return payloads.deep_scan(s, NOW).select("id", "deep_due", "deep_pages", F.col("deep_cutoff").cast("timestamp_ntz").alias("deep_cutoff"))


POSTS = "SELECT doc_id AS source_id, replace(replace(replace(substring(t, 1, 300), '&', 'and'), '<', ' '), '>', ' ') AS body FROM (SELECT doc_id, 'Post ' || CAST(doc_id AS VARCHAR) || ' says ' || source AS t FROM documents)"


@query(f"SELECT source_id, substring(body, 1, 200) AS title, body AS text, 'https://t.me/c/' || CAST(source_id AS VARCHAR) AS url, TIMESTAMP '2024-01-05 05:00:00' AS published_at FROM ({POSTS})")
def channel_payloads(spark: SparkSession, d: str) -> DataFrame:
    said = F.regexp_replace(F.regexp_replace(F.concat(label("Post ", "doc_id"), F.lit(" says "), F.col("source")), "&", "and"), "[<>]", " ")
    page = F.concat(F.lit('<div class="tgme_widget_message_wrap x"><div class="tgme_widget_message_text">'), said, F.lit('</div><a class="tgme_widget_message_date" href="https://t.me/c/'), F.col("doc_id").cast("string"), F.lit('"><time class="time" datetime="2024-01-05T10:00:00+05:00">10:00</time></a></div><div class="tgme_widget_message_wrap"><a class="tgme_widget_message_date" href="https://t.me/c/none"></a></div>'))
    p = read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), page.alias("html"))
    return html.channel_items(p).select("source_id", "title", "text", "url", "published_at")


@query("SELECT page_id, u || s AS sitemap FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://[^/]+', 0)) AS u FROM pages WHERE page_id % 2 = 1), (VALUES ('/sitemap.xml'), ('/sitemap_index.xml'), ('/wp-sitemap.xml')) v(s) UNION ALL SELECT page_id, 'https://r.example/' || CAST(page_id AS VARCHAR) || '.xml' FROM pages WHERE page_id % 2 = 0")
def robots_named(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps that robots files name; the usual places where they name none."""
    p = read(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[A-Za-z]+://[^/]+", 0)).alias("url"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("User-agent: *\nSitemap: "), label("https://r.example/", "page_id"), F.lit(".xml\n"))).otherwise("User-agent: *\n").alias("text"))
    keyed = p.withColumn("url", F.concat(F.col("url"), F.lit("/#"), F.col("page_id").cast("string")))
    return html.robots_sitemaps(keyed).select(F.regexp_extract("url", "#([0-9]+)$", 1).cast("long").alias("page_id"), "sitemap")


@query("SELECT page_id, 'https://l.example/' || CAST(page_id + 1 AS VARCHAR) AS next_url, CASE WHEN page_id % 2 = 0 THEN 'https://l.example/feed' END AS feed_url FROM pages")
def pagination(spark: SparkSession, d: str) -> DataFrame:
    feed = F.when(F.col("page_id") % 2 == 0, '<link rel="alternate" type="application/rss+xml" href="/feed">').otherwise("")
    page = F.concat(F.lit("<html><head>"), feed, F.lit('</head><body><a href="/0">first</a><a href="/'), (F.col("page_id") + 1).cast("string"), F.lit('">Next page</a></body></html>'))
    return html.next_pages(read(spark, d, "pages").select("page_id", page.alias("html"), F.lit("https://l.example/list").alias("url")))


@query("""WITH s AS (SELECT n_nationkey AS source_id FROM nation),
    m AS (SELECT page_id % 25 AS source_id, 'https://m.example/news/' || CAST(page_id AS VARCHAR) AS link, row_number() OVER (PARTITION BY page_id % 25 ORDER BY page_id DESC) AS n FROM pages WHERE page_id % 25 % 3 = 0),
    l AS (SELECT page_id % 25 AS source_id, 'https://l.example/news/' || CAST(page_id AS VARCHAR) AS link, row_number() OVER (PARTITION BY page_id % 25 ORDER BY page_id) AS n FROM pages WHERE page_id % 25 % 3 = 1 AND page_id // 25 < 5)
    SELECT s.source_id, coalesce(f.strategy, 'none') AS strategy, link FROM s LEFT JOIN (SELECT source_id, 'sitemap' AS strategy, link FROM m WHERE n <= 4 UNION ALL SELECT source_id, 'html-pagination', link FROM l WHERE n <= 3) f ON f.source_id = s.source_id""")
def deep_collection(spark: SparkSession, d: str) -> DataFrame:
    """A third of the sources have sitemaps, a third listing pages only, a third neither."""
    p, k = read(spark, d, "pages"), F.col("page_id")
    of = (k % 25).alias("source_id")
    mapped = p.where("page_id % 25 % 3 = 0").select(of, label("https://m.example/news/", "page_id").alias("link"), F.timestamp_seconds(k * 60).alias("at"))
    page = F.concat(F.lit('<a href="/about">about</a><a href="/news/'), k.cast("string"), F.lit('">one</a><a href="/news/'), k.cast("string"), F.lit('">again</a>'))
    lists = p.where("page_id % 25 % 3 = 1").select(of, F.floor(k / 25).cast("int").alias("page"), F.lit("https://l.example/").alias("url"), page.alias("html"))
    sources = read(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"))
    return html.deep_collected(sources, mapped, html.listing_articles(lists, 5, 3), 4)


# Records of a pool run

POOL = f"SELECT doc_id AS id, text, lower(source || chr(10) || text) AS h, length({trim_sql('text')}) >= 400 AS long FROM documents"
DONE = "CASE WHEN NOT long AND id % 2 = 1 THEN 'error' WHEN (long AND (contains(h, 'the') OR contains(h, 'ouen'))) OR (NOT long AND contains(h0, 'the')) THEN CASE WHEN id % 3 = 0 THEN 'not_relevant' ELSE 'processed' END ELSE 'not_relevant' END"


def _pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, i = read(spark, d, "documents"), F.col("doc_id")
    links = docs.select(i.alias("id"), label("https://p.example/n", "doc_id").alias("url"), F.sha2(i.cast("string"), 256).alias("url_hash"), F.lit("g").alias("group_label"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), none("string").alias("last_error"), none("timestamp").alias("last_attempt_at"), none("timestamp").alias("processed_at"), none("string").alias("mention_id"), none("string").alias("date_source"))
    day = F.when(i % 3 == 0, F.lit(datetime(2019, 1, 1))).when(i % 3 == 1, F.lit(datetime(2024, 1, 5)))  # noqa: DTZ001
    pages = docs.select(F.concat(label("https://p.example/n", "doc_id"), F.when(i % 4 == 0, "/").otherwise("")).alias("url"), F.col("source").alias("title"), "text", day.alias("published_at"))
    models = docs.where("doc_id % 2 = 0").select(i.alias("id"), F.lit("model title").alias("title"), F.when(i % 3 == 0, F.lit(datetime(2019, 1, 1))).alias("date"), F.lit(True).alias("model_mentioned"), F.array(F.lit("it names the company"), F.lit("twice")).alias("fragments"))  # noqa: DTZ001
    return links, pages, models


@query(
    f"""WITH p AS (SELECT *, 'it names the company' AS h0 FROM ({POOL}))
    SELECT id, {DONE} AS result, CASE WHEN long THEN 'parser' ELSE 'model' END AS read_via, CASE WHEN {DONE} = 'processed' AND long AND id % 3 = 1 THEN 'page' END AS date_source FROM p"""
)
def pool_records(spark: SparkSession, d: str) -> DataFrame:
    """All documents as pages of a pool: read, tested for keywords, dated, and cut off before 2020."""
    links, pages, models = _pool(spark, d)
    active = (Keyword("the", type="exact_phrase"), Keyword("ouen", type="exact_phrase"))
    done = records.outcomes(links, pages, models, active, BRAND, NOW, datetime(2020, 1, 1))  # noqa: DTZ001
    return done.select("id", "result", "read_via", "date_source")


@query(
    f"""WITH p AS (SELECT *, 'it names the company' AS h0 FROM ({POOL}))
    SELECT sha256('curated:' || sha256(CAST(id AS VARCHAR))) AS id, id AS curated_link_id, CASE WHEN long AND id % 3 = 1 THEN TIMESTAMP '2024-01-05 00:00:00' END AS published_at, true AS url_hidden FROM p WHERE {DONE} = 'processed' AND id % 5 <> 0
    UNION ALL SELECT 'm' || CAST(id AS VARCHAR), id, CASE WHEN {DONE} <> 'processed' THEN TIMESTAMP '2001-01-01 00:00:00' WHEN long AND id % 3 = 1 THEN TIMESTAMP '2024-01-05 00:00:00' END, true FROM p WHERE id % 5 = 0"""
)
def pool_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The mentions after that run: those of every fifth link were there before and are refreshed."""
    links, pages, models = _pool(spark, d)
    active = (Keyword("the", type="exact_phrase"), Keyword("ouen", type="exact_phrase"))
    done = records.outcomes(links, pages, models, active, BRAND, NOW, datetime(2020, 1, 1))  # noqa: DTZ001
    old = links.where("id % 5 = 0").select(label("m", "id").alias("id"), F.col("id").alias("curated_link_id"), F.lit("old").alias("title"), F.lit("old").alias("text"), F.lit(datetime(2001, 1, 1)).cast("timestamp_ntz").alias("published_at"), F.lit("g").alias("source_label"), F.array().cast("array<string>").alias("keywords"), F.lit("positive").alias("sentiment"), F.lit(True).alias("url_hidden"))  # noqa: DTZ001
    return records.processed(links, old, done, NOW)[1].select("id", "curated_link_id", "published_at", "url_hidden")


# Rendering

MARKS = "CASE {0} WHEN 'positive' THEN '🟢 Позитив' WHEN 'negative' THEN '🔴 Негатив' WHEN 'neutral' THEN '🟡 Нейтрал' ELSE '⚪ Не определена' END"
SHORT = "CASE WHEN length({0}) > 200 THEN regexp_replace(substring({0}, 1, 200), '[\\s\\p{{Z}}\\x{{feff}}]+$', '') || '…' ELSE {0} END".format(trim_sql("title"))
SNIPPET = "CASE WHEN length({0}) > 350 THEN regexp_replace(substring({0}, 1, 350), '[\\s\\p{{Z}}\\x{{feff}}]+$', '') || '…' ELSE {0} END".format(trim_sql("text"))
SAFE = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
DAY = f"coalesce(strftime({ALMATY_DAY}, '%d.%m.%Y'), 'дата не определена')"


@query(
    with_(MENTIONS)
    + f"""SELECT id, n || ' · ' || {SAFE.format(SHORT)} || chr(10) || {SAFE.format('source_label')} || ' · ' || {DAY} || chr(10) || {SAFE.format(SNIPPET)} || CASE WHEN url_hidden THEN '' ELSE chr(10) || '🔗 https://m.example/a&amp;b' END AS message,
    n || ' ' || {DAY} || ' · ' || {SAFE.format('source_label')} || chr(10) || {SAFE.format(SHORT)} AS line FROM (SELECT *, CAST(id AS VARCHAR) || '. ' || {MARKS.format('sentiment')} AS n FROM mentions)"""
)
def rendered_items(spark: SparkSession, d: str) -> DataFrame:
    m = views.mentions(spark, d).withColumn("summary", none("string")).withColumn("snippet", text.truncated("text", 350)).withColumn("url", F.when(~F.col("url_hidden"), "https://m.example/a&b"))
    return m.select("id", render.item_message(F.col("id")).alias("message"), render.title_line(F.col("id")).alias("line"))


@query(with_(CARDS) + f"SELECT count(*) || ' · 🟢 ' || count(*) FILTER (WHERE sentiment = 'positive') || ' · 🔴 ' || count(*) FILTER (WHERE sentiment = 'negative') || ' · 🟡 ' || count(*) FILTER (WHERE sentiment = 'neutral') || ' · ⚪ ' || count(*) FILTER (WHERE sentiment = 'undefined') AS said FROM cards".replace("SELECT count(*) ||", "SELECT '<b>Упоминания за месяц &amp; день</b> (с 01.01.2024 по 31.01.2024)' || chr(10) || 'Всего: ' || count(*) ||"))
def period_header(spark: SparkSession, d: str) -> DataFrame:
    totals = stats.tone_counts(views.cards(spark, d))
    return totals.select(render.header("месяц & день", date(2024, 1, 1), date(2024, 1, 31)).alias("said"))


TOTALS = "SELECT 'Всего: <b>' || count(*) || '</b>' || chr(10) || '🟩 Позитив: ' || count(*) FILTER (WHERE sentiment = 'positive') || chr(10) || '🟨 Нейтрал: ' || count(*) FILTER (WHERE sentiment = 'neutral') || chr(10) || '🟥 Негатив: ' || count(*) FILTER (WHERE sentiment = 'negative') AS head FROM cards"


@query(with_(CARDS) + f"SELECT '<b>Проверенные карточки упоминаний</b>' || chr(10) || chr(10) || head || chr(10) || chr(10) || '<b>Издания (' || n || ')</b>' || chr(10) || lines || chr(10) || chr(10) || 'Карточки одного издания: <code>/curated &lt;домен&gt;</code>' AS message FROM ({TOTALS}), (SELECT count(*) AS n, string_agg(source_name || ' — ' || c || ' (<code>' || source_name || '.kz</code>)', chr(10) ORDER BY c DESC, source_name) AS lines FROM (SELECT source_name, count(*) AS c FROM cards GROUP BY 1))")
def card_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = views.cards(spark, d)
    outlets = stats.counts_of(c, "source_name").withColumn("domain", F.concat("source_name", F.lit(".kz")))
    return render.card_statistics(stats.tone_counts(c), outlets)


@query(with_(CARDS) + f"SELECT n AS number, CAST(n AS VARCHAR) || '. ' || {MARKS.format('sentiment')} || ' · ' || {SAFE.format(trim_sql('title'))} || chr(10) || source_name || ' · ' || strftime(published_at, '%d.%m.%Y') || chr(10) || {SAFE.format('summary')} || chr(10) || '🔗 https://c.example/' || id AS message FROM (SELECT *, CAST(row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) AS INT) AS n FROM cards) WHERE n BETWEEN 6 AND 9")
def one_by_one(spark: SparkSession, d: str) -> DataFrame:
    """The second batch of single-article messages: four from the sixth on."""
    c = views.cards(spark, d).withColumn("snippet", none("string")).withColumn("source_label", F.col("source_name")).withColumn("url", F.concat(F.lit("https://c.example/"), "id")).withColumn("published_at", F.col("published_at").cast("timestamp"))
    return render.batch_messages(c, order.newest_first(), 5, 4, "UTC")


@query(with_(MENTIONS) + "SELECT id, CASE source_type WHEN 'news' THEN 'news' WHEN 'social' THEN 'other' WHEN 'telegram' THEN 'telegram' ELSE 'other' END AS kind FROM mentions")
def mention_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("source_type") == "news", "rss").otherwise(F.col("source_type"))
    return views.mentions(spark, d).select("id", render.mention_type(kind).alias("kind"))


@query(
    """SELECT order_id, CASE WHEN order_id % 5 = 0 THEN 'Начало отрезка позже конца' END AS error, CASE WHEN order_id % 5 <> 0 THEN strftime(a, '%Y-%m-%d') || '~' || strftime(b, '%Y-%m-%d') END AS code,
    CASE WHEN order_id % 5 <> 0 THEN b - a + 1 END AS days, CASE WHEN order_id % 5 <> 0 THEN strftime(a, '%d.%m.%Y') || ' — ' || strftime(b, '%d.%m.%Y') END AS shown
    FROM (SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2024-01-31' ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 + 1 AS INT) END AS b FROM orders)"""
)
def typed_periods(spark: SparkSession, d: str) -> DataFrame:
    """Periods as people type them for each order: from its day to some days on or until today; every fifth the wrong way round."""
    k, a = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    end = F.expr("date_add(cast(o_orderdate as date), cast(o_orderkey % 40 + 1 as int))")
    until = F.when(k % 3 == 0, F.lit(NOW.date())).otherwise(end)
    one, two = F.date_format(a, "d/M/yyyy"), F.date_format(until, "yyyy-MM-dd")
    typed = F.when(k % 5 == 0, F.concat(two, F.lit(" "), one)).when(k % 3 == 0, one).otherwise(F.concat(F.lit("c "), one, F.lit(" по "), two))

    def read_all(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            out = []
            for order, raw in zip(pdf["order_id"], pdf["typed"], strict=True):
                try:
                    p = periods.parse_range(raw, NOW, "UTC")
                except periods.PeriodError as e:
                    out.append((order, str(e).split(":")[0], None, None, None))
                    continue
                assert periods.decode(periods.encode(p)) == p
                first, last = periods.bounds(p, NOW, "UTC")
                out.append((order, None, periods.encode(p), periods.span_days(p), f"{periods.show(first)} — {periods.show(last)}"))
            yield pd.DataFrame(out, columns=["order_id", "error", "code", "days", "shown"]).astype({"days": "Int64"})

    orders = read(spark, d, "orders").select(k.alias("order_id"), typed.alias("typed"))
    return orders.mapInPandas(read_all, "order_id long, error string, code string, days long, shown string")


@query("SELECT doc_id, lang IN ('en') OR source = 'x' AS relevant FROM documents".replace("lang IN ('en') OR source = 'x'", "contains(lower(source || chr(10) || text), 'anly') OR (doc_id % 2 = 0 AND doc_id % 3 = 0)"))
def relevant_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that name a keyword, or whose model reading quotes one; a claim without such a quotation does not count."""
    i = F.col("doc_id")
    pages = read(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text", (i % 2 == 0).alias("model_mentioned"), F.array(F.when(i % 3 == 0, "they say Anly twice").otherwise("they say nothing")).alias("fragments"))
    return keywords.relevance(pages, (Keyword("anly", type="exact_phrase"),)).select("doc_id", "relevant")


@query("SELECT doc_id, CASE WHEN g > b THEN 'positive' WHEN b > g THEN 'negative' WHEN g > 0 THEN 'neutral' ELSE 'undefined' END AS tone FROM (SELECT doc_id, G AS g, B AS b FROM (SELECT doc_id, substring(lower(source || chr(10) || text), 1, 6000) AS t FROM documents))".replace("G AS", " + ".join(f"len(string_split(t, '{s}')) - 1" for s in sentiment.GOOD) + " AS").replace("B AS", " + ".join(f"len(string_split(t, '{s}')) - 1" for s in sentiment.BAD) + " AS"))
def lexicon_tone(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.classified(read(spark, d, "documents").withColumn("title", F.col("source"))).select("doc_id", "tone")
