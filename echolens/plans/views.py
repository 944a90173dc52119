"""The library's tables as views over a folder of plain tables, in both engines' terms.

``MENTIONS`` is the SQL of the mention view; ``mentions`` builds the same
rows from DataFrames.  ``NOW`` is the fixed clock of all registered queries.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions import text

NOW = datetime(2024, 1, 31)  # noqa: DTZ001
KINDS = {"view": "news", "click": "social", "signup": "telegram", "purchase": "reviews"}

MENTIONS = """mentions AS (
  SELECT e.event_id AS id, substring(split_part(d.text, '\n', 1), 1, 200) AS title, d.text AS text,
         CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE e.ts END AS published_at, e.ts AS found_at,
         CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE CAST(e.user_id % 25 AS INT) END AS source_id,
         CASE e.event_type WHEN 'view' THEN 'news' WHEN 'click' THEN 'social' WHEN 'signup' THEN 'telegram'
                           WHEN 'purchase' THEN 'reviews' ELSE 'other' END AS source_type,
         d.lang AS language,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
              WHEN l.quality = 0 THEN 'neutral' ELSE 'undefined' END AS sentiment,
         d.source AS source_label, e.event_id % 5 = 0 AS url_hidden,
         CASE WHEN e.event_id % 3 = 0 THEN e.event_id % 97 ELSE NULL END AS curated_link_id
  FROM (SELECT ev.*, ev.event_id % nd.n AS did
        FROM events ev CROSS JOIN (SELECT count(*) AS n FROM documents) nd) e
  JOIN documents d ON d.doc_id = e.did LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

SOURCES = "sources AS (SELECT CAST(n_nationkey AS INT) AS id, n_name AS name FROM nation)"

LINKS = """links AS (
  SELECT page_id AS id, url, CASE WHEN page_id % 4 = 0 THEN 'pending' WHEN page_id % 4 = 1 THEN 'processed'
         WHEN page_id % 4 = 2 THEN 'failed' ELSE 'not_relevant' END AS status, CAST(page_id % 4 AS INT) AS attempts,
         'group' || CAST(page_id % 7 AS VARCHAR) AS group_label, page_id % 10 AS host_id FROM pages)"""

CARDS = """cards AS (
  SELECT item_id AS ord, 'c' || CAST(item_id AS VARCHAR) AS id, 'outlet' || CAST(item_id % 6 AS VARCHAR) AS source_name,
         CASE WHEN item_id % 9 = 0 THEN NULL ELSE DATE '2024-01-31' - CAST(item_id * 3 AS INT) END AS published_at,
         CASE item_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment,
         CASE item_id % 8 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'partial' WHEN 2 THEN 'unverified' ELSE 'verified' END AS status,
         substring(text, 1, 60) AS title, text AS summary FROM benchmark)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str, told: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The mentions; ``told`` adds columns to the documents, by title and text, that their mentions then have too."""
    events, docs, labels = (read(spark, sf_dir, t) for t in ("events", "documents", "labels"))
    n = docs.count()  # from file footers
    docs = docs.withColumn("title", F.substring(F.substring_index("text", "\n", 1), 1, 200))
    plain = docs.columns
    docs = told(docs) if told else docs
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")], F.lit("other"))
    tone = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "neutral").otherwise("undefined")
    e = events.withColumn("doc_id", F.pmod("event_id", F.lit(max(n, 1))))
    rows = e.join(docs, "doc_id").join(labels, "doc_id", "left")
    return rows.select(
        F.col("event_id").alias("id"),
        "title",
        "text",
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("published_at"),
        F.col("ts").alias("found_at"),
        F.when(F.col("event_id") % 11 != 0, (F.col("user_id") % 25).cast("int")).alias("source_id"),
        kind.alias("source_type"),
        F.col("lang").alias("language"),
        tone.alias("sentiment"),
        F.col("source").alias("source_label"),
        (F.col("event_id") % 5 == 0).alias("url_hidden"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 97).alias("curated_link_id"),
        *[c for c in docs.columns if c not in plain],
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    status = F.when(k == 0, "pending").when(k == 1, "processed").when(k == 2, "failed").otherwise("not_relevant")
    return p.select(F.col("page_id").alias("id"), "url", status.alias("status"), k.cast("int").alias("attempts"), F.concat(F.lit("group"), (F.col("page_id") % 7).cast("string")).alias("group_label"), (F.col("page_id") % 10).alias("host_id"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, i = read(spark, sf_dir, "benchmark"), F.col("item_id")
    tone = F.when(i % 3 == 0, "positive").when(i % 3 == 1, "neutral").otherwise("negative")
    status = F.when(i % 8 == 0, "duplicate").when(i % 8 == 1, "partial").when(i % 8 == 2, "unverified").otherwise("verified")
    day = F.when(i % 9 != 0, F.date_sub(F.lit("2024-01-31").cast("date"), (i * 3).cast("int")))
    return b.select(i.alias("ord"), F.concat(F.lit("c"), i.cast("string")).alias("id"), F.concat(F.lit("outlet"), (i % 6).cast("string")).alias("source_name"), day.alias("published_at"), tone.alias("sentiment"), status.alias("status"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("summary"))


def hashes(df: DataFrame) -> DataFrame:
    return df.withColumn("hash", text.content_hash("title", "text"))
