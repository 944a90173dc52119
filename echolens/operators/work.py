"""Work in passes: shares by host, what is left for the next pass, results as of a moment, sitemaps level by level."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolens.operators.dedup import stored
from echolens.operators.order import carried, first_n


def host_pass(items: DataFrame, budget: float, share: int, key: str = "id", host: str = "host", cost: str = "cost") -> DataFrame:
    """``items`` with ``turn`` for those of the next pass; the others, null there, are what the pass after it resumes with.

    Hosts take turns: first every host's first item (by ``key``), then every
    second one, ``share`` of them at most, and within a turn by host.  The pass
    ends before the item whose cost would bring the sum above ``budget``; its
    first item is always in it, so that every pass gets on.  Items without a
    host share one.  No host is sorted as a whole: a pass looks at its first
    ``share`` items, found by each task among its own first.
    """
    rows = stored(items.withColumn("_host", F.coalesce(F.col(host), F.lit(""))))
    parted = rows.withColumn("_part", F.spark_partition_id())
    own = first_n(parted.select("_host", "_part", key, cost), ["_host", "_part"], [F.col(key)], share)
    firsts = own.withColumn("turn", F.row_number().over(Window.partitionBy("_host").orderBy(key))).where(F.col("turn") <= share)
    firsts = stored(firsts.select("_host", key, cost, "turn", F.substring(F.md5("_host"), 1, 2).alias("_b")))
    sums = firsts.groupBy("turn", "_b").agg(F.sum(cost).alias("_sum"))  # 256 rows a turn at most
    before = sums.select("turn", "_b", (F.sum("_sum").over(Window.orderBy("turn", "_b")) - F.col("_sum")).alias("_before"))
    within = F.sum(cost).over(Window.partitionBy("turn", "_b").orderBy("_host"))
    placed = firsts.join(F.broadcast(before), ["turn", "_b"]).withColumn("_upto", F.col("_before") + within)
    chosen = placed.where((F.col("_upto") <= budget) | (F.col("_upto") == F.col(cost))).select(F.col(key), "turn")
    return rows.drop("_host").join(chosen, key, "left")


def passes(items: DataFrame, budget: float, share: int, most: int, key: str = "id", host: str = "host", cost: str = "cost") -> DataFrame:
    """``items`` with the ``number`` of the pass that does each, up to ``most`` passes; what is left after them has none."""
    left, done = items, None
    for n in range(1, most + 1):
        seen = stored(host_pass(left, budget, share, key, host, cost))
        this = seen.where("turn is not null").withColumn("number", F.lit(n))
        done = this if done is None else done.unionByName(this)
        left = seen.where("turn is null").drop("turn")
        if not left.limit(1).count():
            return done
    return done.unionByName(left.withColumn("turn", F.lit(None).cast("int")).withColumn("number", F.lit(None).cast("int")))


def as_of(requests: DataFrame, results: DataFrame, by: str, asked: str, saved: str, block: Column) -> DataFrame:
    """``requests`` with ``found``, the newest of ``results`` with the same ``by`` that was saved by then; null if there is none.

    ``found`` has all columns of the result.  Both lie in one order of time;
    the last result is carried on from ``block`` to block (of ``_at``, the
    moment), so a key that all ask for is not one task's work.  Of results
    saved at one moment any may stand.
    """
    kind = results.schema.simpleString()
    a = results.select(by, F.struct(F.col(saved).alias("_at"), F.lit(0).alias("_asks")).alias("_order"), F.struct(*results.columns).alias("found"), F.lit(None).cast(requests.schema.simpleString()).alias("_request"))
    b = requests.select(by, F.struct(F.col(asked).alias("_at"), F.lit(1).alias("_asks")).alias("_order"), F.lit(None).cast(kind).alias("found"), F.struct(*requests.columns).alias("_request"))
    both = a.unionByName(b).withColumn("_at", F.col("_order._at"))
    timeless = both.where("_at is null and _request is not null").select("_request.*", F.lit(None).cast(kind).alias("found"))
    told = carried(both.where("_at is not null"), F.col("found"), [by], "_order", block, "found")
    return told.where("_request is not null").select("_request.*", "found").unionByName(timeless)


def sitemap_walk(roots: DataFrame, rows: DataFrame, cutoff: datetime, most_levels: int = 100, site: str = "site") -> DataFrame:
    """``(site, sitemap, level)``: every sitemap file that a walk from ``roots(site, sitemap)`` reads.

    ``rows(url, kind, loc, lastmod)`` are the entries of all fetched files.  An
    index leads to its dated sub-sitemaps from the cutoff on, or to its last
    three if none has a date.  Each level is one join; a file that was read
    before is not read again, so an index that names one of its own ancestors
    ends there.
    """
    from echolens.sources.html import sub_sitemaps

    links = stored(sub_sitemaps(rows, cutoff).select(F.col("url").alias("sitemap"), F.col("loc").alias("next")).distinct())
    level = stored(roots.select(site, "sitemap").distinct().withColumn("level", F.lit(0)))
    seen = level
    for n in range(1, most_levels + 1):
        found = level.join(links, "sitemap").select(site, F.col("next").alias("sitemap")).distinct()
        level = stored(found.join(seen.select(site, "sitemap"), [site, "sitemap"], "left_anti").withColumn("level", F.lit(n)))
        if not level.limit(1).count():
            return seen
        seen = seen.unionByName(level)
    raise RuntimeError(f"sitemaps go deeper than {most_levels} levels")


def walked_urls(walk: DataFrame, rows: DataFrame, cutoff: datetime, site: str = "site") -> DataFrame:
    """``(site, loc, at)``: article addresses of the files that a walk has read, each once, at its newest date; index files give none."""
    from echolens.sources.html import sitemap_urls

    index = rows.where("kind = 'sitemap'").select(F.col("url").alias("sitemap")).distinct()
    leaves = walk.join(index, "sitemap", "left_anti").select(site, F.col("sitemap").alias("url"))
    return leaves.join(sitemap_urls(rows, cutoff), "url").groupBy(site, "loc").agg(F.max("at").alias("at"))
