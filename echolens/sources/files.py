"""Files: link lists, source lists, card and feed registries, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens import schema
from echolens.functions import text, url
from echolens.operators.order import carried, first_of

#: Lines of a file that are worked on at once.
LINES = 1000


def link_lines(lines: DataFrame) -> DataFrame:
    """``lines(file, line, value)`` of link lists with kind, group, normal form and hash.

    A line that is no link is a heading and names the group of the links
    after it, up to the next heading of its file.
    """
    t = lines.withColumn("line_text", text.trimmed("value"))
    is_url = F.col("line_text").rlike("(?i)^https?://")
    kind = F.when(F.col("line_text") == "", "blank").when(is_url, "url").otherwise("heading")
    marked = t.withColumn("kind", kind)
    heading = F.when(F.col("kind") == "heading", F.col("line_text"))
    grouped = carried(marked, heading, ["file"], "line", F.floor(F.col("line") / LINES), "group_label")
    out = grouped.withColumn("norm_url", F.when(F.col("kind") == "url", url.url_identity("line_text")))
    return out.withColumn("url_hash", F.sha2("norm_url", 256)).withColumn("host", url.url_host("norm_url")).withColumn("malformed", (F.col("kind") == "url") & F.col("norm_url").isNull())


def links_of(lines: DataFrame) -> DataFrame:
    """Parsed links, the first line of each address."""
    parsed = link_lines(lines).where("kind = 'url' and not malformed")
    return first_of(parsed, ["url_hash"], ["file", "line"]).select(F.col("norm_url").alias("url"), "url_hash", "host", "group_label", "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)`` of text files, one file a row at first, so that numbers are exact."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def source_urls(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(text.trimmed("value").alias("url"))
    return lines.where("url <> '' and not startswith(url, '#')")


def cards(spark: SparkSession, path: str) -> DataFrame:
    """Card JSON; unknown tones become ``undefined``."""
    raw = spark.read.schema(schema.CARD).option("multiLine", True).json(path)
    tone = F.when(F.col("sentiment").isin(*schema.SENTIMENTS), F.col("sentiment")).otherwise(F.lit("undefined"))
    return raw.select("id", F.col("sourceName").alias("source_name"), F.col("sourceDomain").alias("source_domain"), "title", "url", F.col("publishedAt").alias("published_at"), F.col("publishedAtText").alias("published_at_text"), "summary", tone.alias("sentiment"), F.col("sentimentNote").alias("sentiment_note"), "status", F.col("duplicateOf").alias("duplicate_of"))


def feeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, domain string, url string").option("multiLine", True).json(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
