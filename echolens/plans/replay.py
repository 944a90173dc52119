"""Registered queries over a replayed collection, documents sent as three batches of files through the cycle, and over work in passes, with their SQL twins."""

from __future__ import annotations

import uuid

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions import url
from echolens.operators import dedup, live, stats, work
from echolens.plans.catalog import BRAND, IDENTITY, KEYWORDS, query, trim_sql
from echolens.plans.views import NOW, read
from echolens.sources import html
from echolens.streaming.ingest import OUTCOMES, Cycle, start

BATCHES = 3
#: Files of a drop at most; the cycle takes a hundred at once, and a drop is one batch.
FILES = 96
TAIL = " the quick brown fox jumps over the lazy dog and runs far away"
_done: dict[tuple[str, str], Cycle] = {}


def records(docs: DataFrame) -> DataFrame:
    """``(batch, value)``: every document as a record, every fifth once more with another title, some that are no records, and the report of a source that failed."""
    k = F.col("doc_id")
    name = F.lpad(k.cast("string"), 12, "0")
    site = F.when(k % 13 == 0, "https://bad.example/").otherwise("https://good.example/")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(TAIL))
    title = F.sha2(F.coalesce("text", F.lit("")), 256)
    at = F.when(k % 11 == 0, "2023-01-01T00:00:00Z")

    def line(end: str, more_title: str, more: str):  # noqa: ANN202
        parts = {"id": F.concat(name, F.lit(end)), "source_id": F.concat(F.lit("s"), (k % 7).cast("string")), "title": F.concat(title, F.lit(more_title)), "text": F.concat(body, F.lit(more)), "url": F.concat(site, name, F.lit(end)), "published_at": at}
        return F.to_json(F.struct(*[v.alias(n) for n, v in parts.items()]))

    lines = F.array_compact(F.array(line("", "", ""), F.when(k % 5 == 0, line("x", " again", " more")), F.when(k % 17 == 0, F.concat(F.lit('{"id": "'), name)), F.when(k % 19 == 0, F.concat(F.lit('{"id": "'), name, F.lit('", "url": "https://good.example/x"}')))))
    sent = docs.select((k % BATCHES).alias("batch"), F.explode(lines).alias("value"))
    return sent.union(docs.sparkSession.createDataFrame([(0, '{"source_id": "s3", "error": "timeout"}')], "batch long, value string"))


def replayed(spark: SparkSession, d: str) -> Cycle:
    """The cycle after all batches have come, one file drop after another; run once a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _done:
        root = f"{dedup.shared_folder(spark)}/cycle-{uuid.uuid4().hex}"
        keyword_table = spark.createDataFrame([(k.phrase, k.type, True, k.language, list(k.manual_forms)) for k in KEYWORDS], "phrase string, type string, is_active boolean, language string, manual_forms array<string>")
        cycle = Cycle(spark, f"{root}/table", lambda: NOW, lambda: keyword_table, ["bad.example"])
        sent = records(read(spark, d, "documents"))
        for batch in range(BATCHES):
            sent.where(F.col("batch") == batch).select("value").coalesce(FILES).write.mode("append").text(f"{root}/in")
            start(cycle, f"{root}/in", f"{root}/checkpoint").awaitTermination()
        _done[key] = cycle
    return _done[key]


HELD = f"lower(sha256(coalesce(text, '')) || chr(10) || coalesce(text, '') || '{TAIL}')"
SENT = f"""sent AS (SELECT doc_id, doc_id % {BATCHES} AS batch, 's' || CAST(doc_id % 7 AS VARCHAR) AS source_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, sha256(coalesce(text, '')) AS story,
    CASE WHEN doc_id % 11 = 0 AND (doc_id % {BATCHES} = 0 OR doc_id % {BATCHES} = 1 AND doc_id % 7 = 3) THEN 'skipped_old' WHEN doc_id % 13 = 0 THEN 'excluded_domain'
    WHEN contains(h, 'idiot') OR contains(h, 'zzz') OR NOT (contains(h, 'anly') OR contains(h, 'heing') OR contains(h, 'tion the') OR contains(h, 'eaux')) THEN 'no_keyword' ELSE 'candidate' END AS outcome
    FROM (SELECT *, {HELD} AS h FROM documents)),
first AS (SELECT story, first(id ORDER BY batch, id) AS card_id FROM sent WHERE outcome = 'candidate' GROUP BY story),
told AS (SELECT sent.id, source_id, CASE WHEN outcome <> 'candidate' THEN outcome WHEN sent.id = card_id THEN 'inserted' ELSE 'duplicate' END AS outcome, CASE WHEN outcome = 'candidate' THEN card_id END AS card_id FROM sent LEFT JOIN first ON first.story = sent.story
    UNION ALL SELECT sent.id || 'x', source_id, CASE WHEN outcome <> 'candidate' THEN outcome ELSE 'reprint' END, CASE WHEN outcome = 'candidate' THEN card_id END FROM sent LEFT JOIN first ON first.story = sent.story WHERE doc_id % 5 = 0)"""


@query(f"WITH {SENT} SELECT id, source_id, outcome, card_id FROM told")
def cycle_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What became of every item, and the story that it belongs to."""
    return replayed(spark, d).tables["outcomes"].read().select("id", "source_id", "outcome", "card_id")


@query(f"WITH {SENT} SELECT source_id, count(*) AS found, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{k}') AS {k}" for k in OUTCOMES) + " FROM told GROUP BY 1")
def cycle_counters(spark: SparkSession, d: str) -> DataFrame:
    return stats.cycle_counters(cycle_outcomes(spark, d), "source_id")


@query(f"WITH {SENT} SELECT card_id AS id, count(*) FILTER (WHERE outcome <> 'inserted') AS reprints FROM told WHERE card_id IS NOT NULL GROUP BY 1")
def cycle_cards(spark: SparkSession, d: str) -> DataFrame:
    """Stories with the number of addresses that they were found under again."""
    return replayed(spark, d).cards().select("id", F.size("reprints").cast("long").alias("reprints"))


@query(f"SELECT doc_id % {BATCHES} AS batch, reason, count(*) AS records FROM (SELECT doc_id, 'does not parse' AS reason FROM documents WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 'no title' FROM documents WHERE doc_id % 19 = 0) GROUP BY 1, 2")
def cycle_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return replayed(spark, d).tables["dead"].read().groupBy("batch", "reason").agg(F.count(F.lit(1)).alias("records"))


@query(f"SELECT DISTINCT 's' || CAST(doc_id % 7 AS VARCHAR) AS id, 'active' AS status, TIMESTAMP '2024-01-31 00:00:00' AS last_success_at FROM documents")
def cycle_sources(spark: SparkSession, d: str) -> DataFrame:
    """The state of each source after the last batch; the one that failed at first has succeeded since."""
    return replayed(spark, d).sources().select("id", "status", F.col("last_success_at").cast("timestamp_ntz").alias("last_success_at"))


# Work in passes


@query(
    f"""WITH RECURSIVE items AS (SELECT page_id, coalesce(host, '') AS host, page_id % 3 + 1 AS cost FROM {IDENTITY}),
    t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS turn FROM items),
    c AS (SELECT *, sum(cost) OVER (ORDER BY turn, md5(host)[1:2], host) AS upto FROM t WHERE turn <= 4)
    SELECT items.page_id, CASE WHEN upto <= 150 OR upto = c.cost THEN CAST(turn AS INT) END AS turn FROM items LEFT JOIN c ON c.page_id = items.page_id"""
)
def host_turns(spark: SparkSession, d: str) -> DataFrame:
    """The pages that the next pass reads: hosts take turns, four pages each at most, within a budget; what has no turn is left for later."""
    pages = read(spark, d, "pages").select("page_id", url.url_host("url").alias("host"), (F.col("page_id") % 3 + 1).alias("cost"))
    return work.host_pass(pages, 150, 4, "page_id").select("page_id", "turn")


@query(
    """SELECT r.event_id, (SELECT max(s.event_id) FROM events s WHERE s.event_type = 'purchase' AND s.user_id = r.user_id AND s.event_id % 7 <> 0 AND s.ts = (SELECT max(m.ts) FROM events m WHERE m.event_type = 'purchase' AND m.user_id = r.user_id AND m.event_id % 7 <> 0 AND m.ts <= r.ts)) AS result_id
    FROM events r WHERE r.event_type = 'view'"""
)
def results_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each request with the newest result of its key that was saved by then."""
    e = read(spark, d, "events")
    results = e.where("event_type = 'purchase' and event_id % 7 <> 0").groupBy("user_id", "ts").agg(F.max("event_id").alias("result_id"))
    requests = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    found = work.as_of(requests, results, "user_id", "ts", "ts", F.date_trunc("week", F.col("_at")))
    return found.select("event_id", F.col("found.result_id").alias("result_id"))


CUTOFF = datetime(2023, 4, 1)  # noqa: DTZ001


def _sitemap_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of sitemaps made of the pages: leaves of five addresses, indexes of ten leaves and of the next index, some without dates."""
    k = F.col("page_id")
    p = read(spark, d, "pages").select(k, F.expr("page_id div 5").alias("leaf"), F.expr("page_id div 50").alias("top"))
    name = lambda kind, c: F.concat(F.lit(f"https://s.example/{kind}-"), F.lpad(c.cast("string"), 9, "0"), F.lit(".xml"))
    entry = F.concat(F.lit("<url><loc>https://s.example/news/p-"), k.cast("string"), F.lit("</loc></url>"))
    leaves = p.groupBy(name("leaf", F.col("leaf")).alias("url")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("x")).select("url", F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("text"))
    dated = F.when(F.col("top") % 4 != 3, F.concat(F.lit("<lastmod>2023-0"), (F.col("leaf") % 9 + 1).cast("string"), F.lit("-15</lastmod>"))).otherwise(F.lit(""))
    sub = F.concat(F.lit("<sitemap><loc>"), name("leaf", F.col("leaf")), F.lit("</loc>"), dated, F.lit("</sitemap>"))
    following = F.concat(F.lit("<sitemap><loc>"), name("index", F.expr("(top + 1) % 3")), F.lit("</loc>"), F.when(F.col("top") % 4 != 3, F.lit("<lastmod>2023-09-01</lastmod>")).otherwise(F.lit("")), F.lit("</sitemap>"))
    of = p.select("top", "leaf").distinct().groupBy("top").agg(F.array_join(F.sort_array(F.collect_list(sub)), "").alias("x"))
    indexes = of.select(name("index", F.col("top")).alias("url"), F.concat(F.lit("<sitemapindex>"), following, "x", F.lit("</sitemapindex>")).alias("text"))
    return leaves.unionByName(indexes)


@query(
    """WITH RECURSIVE l AS (SELECT DISTINCT page_id // 5 AS leaf, page_id // 50 AS top FROM pages),
    e AS (SELECT 'index-' || lpad(CAST(top AS VARCHAR), 9, '0') AS f, 'leaf-' || lpad(CAST(leaf AS VARCHAR), 9, '0') AS t FROM (SELECT *, row_number() OVER (PARTITION BY top ORDER BY leaf DESC) AS last FROM l)
        WHERE CASE WHEN top % 4 <> 3 THEN leaf % 9 + 1 >= 4 ELSE last <= 3 END
        UNION SELECT 'index-' || lpad(CAST(top AS VARCHAR), 9, '0'), 'index-' || lpad(CAST((top + 1) % 3 AS VARCHAR), 9, '0') FROM l WHERE top % 4 <> 3),
    w(site, f) AS (SELECT DISTINCT top, 'index-' || lpad(CAST(top AS VARCHAR), 9, '0') FROM l UNION SELECT w.site, e.t FROM w JOIN e ON e.f = w.f)
    SELECT site, count(*) FILTER (WHERE f LIKE 'index-%') AS indexes, count(*) FILTER (WHERE f LIKE 'leaf-%') AS leaves, CAST(sum((SELECT count(*) FROM pages WHERE f = 'leaf-' || lpad(CAST(page_id // 5 AS VARCHAR), 9, '0'))) AS BIGINT) AS urls
    FROM w WHERE f LIKE 'leaf-%' OR f IN (SELECT 'index-' || lpad(CAST(top AS VARCHAR), 9, '0') FROM l) GROUP BY 1"""
)
def sitemaps_walked(spark: SparkSession, d: str) -> DataFrame:
    """What a walk over each site's sitemaps reads of the files that were fetched, through nested indexes, circles and indexes without dates."""
    rows = dedup.stored(html.sitemap_rows(_sitemap_files(spark, d)))
    roots = read(spark, d, "pages").select(F.expr("page_id div 50").alias("site")).distinct().withColumn("sitemap", F.concat(F.lit("https://s.example/index-"), F.lpad(F.col("site").cast("string"), 9, "0"), F.lit(".xml")))
    walk = work.sitemap_walk(roots, rows, CUTOFF)
    known = rows.select(F.col("url").alias("sitemap")).distinct()
    walk = dedup.stored(walk.join(known, "sitemap"))
    files = walk.groupBy("site").agg(F.count_if(F.col("sitemap").contains("/index-")).alias("indexes"), F.count_if(F.col("sitemap").contains("/leaf-")).alias("leaves"))
    urls = work.walked_urls(walk, rows, CUTOFF).groupBy("site").agg(F.count(F.lit(1)).alias("urls"))
    return files.join(urls, "site", "left")


# A live run over feeds

LIVE = f"""items AS (SELECT doc_id % 17 AS feed, doc_id AS ord, doc_id % 400 AS address, CASE WHEN doc_id % 9 <> 0 THEN TIMESTAMP '2024-01-01 20:00:00' + to_days(CAST(doc_id % 40 AS INT)) END AS published_at,
    lower(split_part(text, '\n', 1) || chr(10) || text) AS h, text FROM documents),
judged AS (SELECT *, CASE WHEN NOT ({' OR '.join(f"contains(h, '{b}')" for b in BRAND)}) THEN 'other' WHEN address IN (SELECT item_id FROM benchmark WHERE item_id % 2 = 0) THEN 'known' WHEN published_at IS NULL THEN 'undated'
    WHEN CAST(published_at + INTERVAL 5 HOUR AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' THEN 'kept' ELSE 'outside' END AS outcome FROM items),
finds AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY feed, ord) AS n FROM judged WHERE outcome = 'kept')"""


def _live(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("doc_id")
    at = F.when(k % 9 != 0, F.expr("timestamp_ntz'2024-01-01 20:00:00' + make_dt_interval(cast(doc_id % 40 as int))"))
    address = F.concat(F.lit("https://www.Live.example/n"), (k % 400).cast("string"), F.when(k % 2 == 0, "?utm_source=feed").otherwise("/"))
    items = read(spark, d, "documents").select((k % 17).alias("feed"), k.alias("ord"), F.substring_index("text", "\n", 1).alias("title"), "text", address.alias("url"), at.alias("published_at"))
    cards = read(spark, d, "benchmark").where("item_id % 2 = 0").select(F.concat(F.lit("http://live.example/n"), F.col("item_id").cast("string")).alias("url"))
    return live.live_run(items, BRAND, cards, date(2024, 1, 5), date(2024, 1, 25), "Etc/GMT-5")


@query(f"WITH {LIVE} SELECT feed, ord, published_at, nullif({trim_sql('substring(text, 1, 350)')}, '') AS summary FROM finds WHERE n = 1")
def live_finds(spark: SparkSession, d: str) -> DataFrame:
    """The finds of a live run over all feeds: of the brand, no known card, dated within three weeks, one for each address."""
    return _live(spark, d)[0].select("feed", "ord", "published_at", "summary")


@query(f"WITH {LIVE} SELECT feed, count(*) AS seen, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("other", "known", "undated", "outside", "kept")) + ", (SELECT count(*) FROM finds WHERE n = 1 AND finds.feed = judged.feed) AS finds FROM judged GROUP BY feed")
def live_counters(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d)[1]
