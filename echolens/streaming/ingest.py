"""Incremental ingest: files of items → one micro-batch cycle at a time.

Uniqueness holds over all history, so no watermark bounds it: each batch is
checked against the stored stories inside ``foreachBatch``.  A cycle keeps, in
folders by batch that are merged as they grow (``versions.Segments``):

* ``stories``, the new ones, by day, so that reprints are looked for among the
  days around a batch's own;
* ``known``, their hashes, by the beginning of the hash;
* ``outcomes``, what became of every item and which story it belongs to.
  Stories are never rewritten for a reprint: its address is an entry here and
  is folded into the story's list when cards are read;
* ``sources``, when a source succeeded, failed or was scanned in depth;
* ``dead``, records that cannot be used, with the reason, to be sent again.

A batch's rows are written under its number, and a batch that runs again
replaces them, so every item counts once whatever fails in between.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from echolens import schema
from echolens.operators import dedup, filters, keywords, merge
from echolens.operators.order import first_of
from echolens.operators.versions import Folder, Segments

#: A record: an item, or with ``error`` the report that a source could not be read, with ``deep`` that it was read in depth.
ITEM = "id string, source_id string, title string, text string, url string, published_at timestamp, error string, deep boolean"
#: Sources that every task may know; parts that the stories of a day, or those without one, are written in.
MOST_SOURCES, DAY_PARTS = 100_000, 32
OUTCOMES = ("skipped_old", "excluded_domain", "no_keyword", "inserted", "reprint", "duplicate")


def bucket() -> Column:
    """The bucket of a row: a letter, so that no reader takes it for a number, and the hash's first two characters."""
    return F.concat(F.lit("b"), F.substring("hash", 1, 2))


def day() -> Column:
    """The day of a story, for its folder."""
    return F.coalesce(F.date_format(F.col("published_at"), "'d'yyyy-MM-dd"), F.lit("undated"))


def parsed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items, and dead letters ``(record, reason)``, of lines of JSON in ``value``.

    A dead letter does not parse, or lacks its id, title or address; a report
    of a source needs its ``source_id`` only.
    """
    fields = F.from_json("value", f"{ITEM}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = records.select("value", fields.alias("item"))
    blank = lambda c: ~filters.has_ink(f"item.{c}")
    report = F.col("item.error").isNotNull() | F.coalesce("item.deep", F.lit(False))
    reason = (
        F.when(F.col("item").isNull() | F.col("item._bad").isNotNull(), "does not parse")
        .when(report, F.when(blank("source_id"), "a report of no source"))
        .when(blank("id"), "no id").when(blank("title"), "no title").when(blank("url"), "no address")
    )
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("item.*").drop("_bad"), rows.where("reason is not null").select(F.col("value").alias("record"), "reason")


@dataclass
class Cycle:
    """Collection cycles over stored tables below the folder ``table``."""

    spark: SparkSession
    table: str
    now: Callable[[], datetime]
    keyword_table: Callable[[], DataFrame]
    excluded: Sequence[str] = ()
    backfill_days: int = filters.BACKFILL_DAYS
    paused: Callable[[], bool] = lambda: False
    fan: int = 8
    #: What the last batch did, counted in the pass that wrote it.
    counters: dict[str, int] = field(default_factory=dict)

    def _segments(self, name: str, by: str) -> Segments:
        return Segments(Folder(self.spark, f"{self.table}/{name}"), by, self.fan)

    @property
    def tables(self) -> dict[str, Segments]:
        return {name: self._segments(name, by) for name, by in (("stories", "day"), ("known", "bucket"), ("outcomes", "bucket"), ("sources", "bucket"), ("dead", "reason"))}

    def sources(self, before: int | None = None) -> DataFrame:
        """Each source's state as the table of sources has it: when it succeeded, when it was scanned in depth, and its last error."""
        rows = self.tables["sources"].read(before)
        if rows is None:
            return self.spark.createDataFrame([], "id string, last_success_at timestamp, last_deep_scan_at timestamp, last_error string, status string")
        last = F.max(F.struct("batch", "ok", "message"))
        state = rows.groupBy(F.col("source_id").alias("id")).agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"), F.max(F.when(F.col("deep"), F.col("at"))).alias("last_deep_scan_at"), last.alias("l"))
        return state.select("id", "last_success_at", "last_deep_scan_at", F.when(~F.col("l.ok"), F.col("l.message")).alias("last_error"), F.when(F.col("l.ok"), "active").otherwise("error").alias("status"))

    def outcomes(self, items: DataFrame, batch: int | None = None) -> DataFrame:
        """Items with the one ``outcome`` of each and the ``card_id`` that it belongs to.

        The tests of a cycle come in their order, then exact duplicates, then
        reprints, among stored stories and earlier items (by id) of the batch.
        Every item of a source that has not succeeded before is backfill.
        """
        done = self.sources(batch).where("last_success_at is not null").select(F.col("id").alias("source_id"), F.lit(False).alias("is_backfill"))
        done = dedup.stored(done)
        if done.count() <= MOST_SOURCES:  # else items, with their texts, would be dealt by source, a few tasks for a few sources
            done = F.broadcast(done)
        rows = items.drop("error", "deep").join(done, "source_id", "left").withColumn("is_backfill", F.coalesce("is_backfill", F.lit(True)))
        active = keywords.snapshot(self.keyword_table())  # edits count from the next batch on
        marked = keywords.matched(merge.hashed(rows), active)
        tested = merge.outcome_of(marked, self.now(), self.backfill_days, self.excluded, F.col("matched"))
        tested = dedup.stored(tested.withColumn("_key", F.concat("id", F.lit("#"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))))
        first = first_of(tested.where("outcome = 'candidate'").select("hash", "_key"), ["hash"], ["_key"]).withColumnRenamed("_key", "_first")
        rows = tested.select("_key", "id", "hash", "outcome").join(first, "hash", "left")  # texts stay where they are
        known = self.tables["known"].read(batch)
        if known is not None:
            asked = [r[0] for r in first.select(bucket()).distinct().collect()]  # 256 at most
            old = known.where(F.col("bucket").isin(asked)).groupBy("hash").agg(F.min("id").alias("_known"))
            rows = rows.join(old, "hash", "left")
        else:
            rows = rows.withColumn("_known", F.lit(None).cast("string"))
        fresh = (F.col("outcome") == "candidate") & F.col("_known").isNull()
        rows = dedup.stored(rows)
        asking = rows.where(fresh & (F.col("_key") == F.col("_first"))).select("_key")
        told = self._told_again(tested.join(asking, "_key", "left_semi"), batch).withColumnRenamed("_key", "_first")
        rows = rows.withColumn("_first", F.coalesce("_first", "_key")).join(told, "_first", "left")  # of equal items all fare as the first; others are first alone, as a null would be one task's
        outcome = (
            F.when(F.col("outcome") != "candidate", F.col("outcome")).when(F.col("_known").isNotNull(), "duplicate").when(F.col("_card").isNotNull(), "reprint")
            .when(F.col("_key") == F.col("_first"), "inserted").otherwise("duplicate")
        )
        card = F.when(F.col("outcome") == "candidate", F.coalesce("_known", "_card", F.substring_index("_first", "#", 1)))
        rows = rows.select("_key", card.alias("card_id"), outcome.alias("outcome"))
        return tested.drop("outcome").join(rows, "_key").drop("_key", "matched")

    def _told_again(self, new: DataFrame, batch: int | None) -> DataFrame:
        """``(_key, _card)`` for the new stories that are reprints: of a stored one, or of an earlier new one that is none itself."""
        named = lambda key, mark: [F.concat(F.lit(mark), key).alias("id"), "title", "text", "published_at", F.lit(False).alias("url_hidden")]
        mine = dedup.stored(new.select(*named("_key", "n:")))
        ends = mine.agg(F.count(F.lit(1)), F.min("published_at"), F.max("published_at"), F.count("published_at")).first()
        none = self.spark.createDataFrame([], "_key string, _card string")
        if not ends[0]:
            return none
        pairs = dedup.reprint_pairs(mine, mine).where("old_id < new_id")
        known = self.tables["stories"].read(batch)
        if known is not None:
            stories = lambda df: df.select(*named("id", "s:"))
            if ends[3]:
                apart = F.expr(f"interval {dedup.DAYS + 1} days")
                near = (F.col("day") == "undated") | F.col("day").between(F.date_format(F.lit(ends[1]) - apart, "'d'yyyy-MM-dd"), F.date_format(F.lit(ends[2]) + apart, "'d'yyyy-MM-dd"))
                pairs = pairs.union(dedup.reprint_pairs(mine.where("published_at is not null"), stories(known.where(near))))
            if ends[3] < ends[0]:  # only what has no date may repeat a story of any day
                pairs = pairs.union(dedup.reprint_pairs(mine.where("published_at is null"), stories(known)))
        pairs = dedup.stored(pairs)
        if not pairs.limit(1).count():
            return none
        cards = dedup.reprint_clusters(mine, pairs, earlier=F.lit(True)).where("id <> card_id")
        plain = F.when(F.col("card_id").startswith("n:"), F.substring_index(F.expr("substring(card_id, 3)"), "#", 1)).otherwise(F.expr("substring(card_id, 3)"))
        return dedup.stored(cards.select(F.expr("substring(id, 3)").alias("_key"), plain.alias("_card")))

    def __call__(self, records: DataFrame, batch: int) -> None:
        """One batch of lines of JSON."""
        tables = self.tables
        for t in tables.values():
            t.compact(batch)
        records = dedup.stored(records.select("value"))
        items, dead = parsed(records)
        tables["dead"].write(dead, batch)
        reports = items.where(F.col("error").isNotNull() | F.coalesce("deep", F.lit(False)))
        items = items.where(F.col("error").isNull() & ~F.coalesce("deep", F.lit(False)))
        rows = dedup.stored(self.outcomes(items, batch).withColumn("bucket", bucket()))
        seen = Observation(f"cycle {batch}")
        counted = [F.count(F.lit(1)).alias("found"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]]
        said = rows.select("id", "source_id", "url", F.lit(self.now()).cast("timestamp").alias("found_at"), "outcome", "card_id", "bucket")
        tables["outcomes"].write(said.observe(seen, *counted), batch)
        new = rows.where("outcome = 'inserted'")
        tables["stories"].write(new.select("id", "source_id", "title", "text", "url", "published_at", "is_backfill", "hash", "matched_keywords", day().alias("day")).repartition("day", F.pmod(F.xxhash64("id"), F.lit(DAY_PARTS))), batch)
        tables["known"].write(new.select("hash", "id", "bucket").coalesce(8), batch)
        failed = reports.where("error is not null").groupBy("source_id").agg(F.min("error").alias("message"))
        deep = reports.where("deep").select("source_id", F.lit(True).alias("deep")).distinct()
        read = items.select("source_id").union(reports.where("error is null").select("source_id")).distinct().withColumn("read", F.lit(True))
        state = read.join(failed, "source_id", "full_outer").join(deep, "source_id", "left")
        state = state.where("source_id is not null").select("source_id", F.col("message").isNull().alias("ok"), "message", F.coalesce("deep", F.lit(False)).alias("deep"), F.lit(self.now()).cast("timestamp").alias("at"), F.concat(F.lit("b"), F.substring(F.md5("source_id"), 1, 1)).alias("bucket"))
        tables["sources"].write(state.coalesce(4), batch)
        self.counters = {**seen.get, "dead": tables["dead"].batch(batch).count()}

    def cards(self) -> DataFrame:
        """All stories, each with the addresses of its duplicates and reprints: each once, never the story's own."""
        stories = self.tables["stories"].read()
        told = self.tables["outcomes"].read()
        if stories is None:
            return self.spark.createDataFrame([], f"{schema.MENTION.split(', sentiment')[0]}, reprints array<{schema.REPRINT}>")
        blank = F.array().cast(f"array<{schema.REPRINT}>")
        again = told.where("outcome in ('duplicate', 'reprint')").groupBy("card_id", "url").agg(F.min(F.struct("found_at", "source_id")).alias("f"))
        again = again.select("card_id", "url", F.col("f.source_id").alias("source_id"), F.col("f.found_at").alias("found_at"), F.lit("reprint").alias("outcome"))
        return merge.with_reprints(stories.drop("batch", "day").withColumn("reprints", blank), again)


def start(cycle: Cycle, folder: str, checkpoint: str, files: int = 100):  # noqa: ANN201
    """Runs the cycle over all new files of a folder of JSON lines, then stops; None while collection is paused.

    A paused cycle never begins a query, so the files that arrive meanwhile
    are new to the next one.
    """
    if cycle.paused():
        return None
    records = cycle.spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    return records.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(cycle: Cycle, batch: int, folder: str, repaired: Column, where: Column | str = "true") -> int:
    """Sends the dead letters of a batch again, as ``repaired`` makes them of ``record``; they come with the next cycle.

    Returns how many were sent.  Sending a batch twice does not count its
    items twice, as their stories are known by then.
    """
    dead = cycle.tables["dead"].read()
    chosen = dead.where((F.col("batch") == batch) & (F.expr(where) if isinstance(where, str) else where)).select(repaired.alias("value")).where("value is not null")
    chosen = dedup.stored(chosen)
    chosen.write.mode("append").text(folder)
    return chosen.count()


def recent_only(items: DataFrame, keep: str = "7 days") -> DataFrame:
    """Stream twin with bounded state: one item for each hash within a watermark on the time found."""
    return items.withWatermark("found_at", keep).dropDuplicatesWithinWatermark(["hash"])


def day_counts(items: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming counts a day and source; late items count until the watermark passes."""
    return items.withWatermark("found_at", late).groupBy(F.window("found_at", "1 day").alias("day"), "source_id").agg(F.count(F.lit(1)).alias("count"))


def retried(action: Callable[[], object], attempts: int = 3, pause_s: float = 1.0, transient: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> object:
    """The action's result; transient failures are tried again after one, two, ... pauses."""
    for n in range(1, attempts + 1):
        try:
            return action()
        except Exception as e:
            if n == attempts or not transient(e):
                raise
            sleep(pause_s * n)
    raise ValueError("attempts must be positive")


def by_host(items: DataFrame, work: Callable, schema: str, host: str = "host", most: int = 64) -> DataFrame:
    """Work that must not run at once for one host: rows of a host are one partition's, hosts run beside one another.

    ``work`` maps an iterator of pandas batches to another.
    """
    return items.repartition(most, host).sortWithinPartitions(host).mapInPandas(work, schema)
