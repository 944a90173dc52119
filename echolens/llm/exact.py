"""Exact dedup of texts against immutable snapshots.

Texts are equal when they are the same characters after white space is
deleted.  A snapshot keeps one row for each different text, in buckets by
digest, and a static binary-fuse filter for each bucket.  An incoming batch is
grouped on its own first; the digests of its groups are screened by the
filters, and only those that a filter may hold meet the exact buckets, where
texts are compared byte by byte.  Everything else is new.

A text that holds a third of all rows is one row a task before anything is
shuffled: groups are partial aggregates, by digest and then, for digests that
repeat, by digest and text.  Two texts of one digest stay two groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolens.llm.common import KEY_BYTES, Scratch, bounded_batches, lean
from echolens.llm.fuse import Fuse

#: Digests in a bucket of a snapshot, about.
BUCKET_KEYS = 1 << 14
#: A group with more than one of so many of all rows is joined by broadcast: there are fewer than that.
HEAVY = 10_000
#: The characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """A text without its white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest(normal: Column) -> Column:
    """The 32 bytes that name a normalised text."""
    return F.unhex(F.sha2(normal, 256))


@dataclass(frozen=True)
class Snapshot:
    """Different texts, never changed once written.

    ``rows`` holds at least ``(row, d, t)`` of each group's best row: its
    number, digest and normalised text.  ``groups`` holds ``(name, d, n, keep)``
    and ``filters`` ``(bucket, seed, bits, segments, slots)``.
    """

    rows: DataFrame
    groups: DataFrame
    filters: DataFrame
    buckets: int

    def write(self, path: str) -> Snapshot:
        """The snapshot under ``path``, in a shared store: one text a group, in buckets by digest, the groups and the filters."""
        bucket = F.pmod(short("d"), F.lit(self.buckets)).alias("bucket")
        texts = self.rows.select("row", "d", "t").join(self.groups.select(F.col("keep.row").alias("row")), "row")
        texts.select(bucket, "row", "d", "t").repartition("bucket").sortWithinPartitions("bucket", "d").write.option("compression", "zstd").parquet(f"{path}/texts")
        self.groups.write.parquet(f"{path}/groups")
        self.filters.withColumn("buckets", F.lit(self.buckets)).write.parquet(f"{path}/filters")
        return Snapshot.read(self.rows.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Snapshot:
        filters = spark.read.parquet(f"{path}/filters")
        some = filters.select("buckets").first()
        return Snapshot(spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/groups"), filters.drop("buckets"), some[0] if some else 1)


def rows_of(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", batch: Column | None = None) -> DataFrame:
    """Stored rows ``(row, id, lot, size, d, t)``: a number for each row, the length of its text, digest and normalised text.

    ``batch`` says to which lot a row belongs: 0 for the snapshot, 1 for the incoming batch (all rows if None).
    """
    lot = F.lit(1) if batch is None else F.coalesce(batch, F.lit(1))
    rows = docs.select(F.col(f"`{key}`").alias("id"), lot.cast("int").alias("lot"), F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("size"), normalised(F.col(f"`{text}`")).alias("t"))
    return scratch.table(rows.select(F.monotonically_increasing_id().alias("row"), "id", "lot", "size", digest(F.col("t")).alias("d"), "t"), compression="zstd")


def grouped(rows: DataFrame, scratch: Scratch, prefix: str = "g") -> tuple[DataFrame, DataFrame]:
    """Groups ``(name, d, n, keep)`` of equal texts, and rows ``(row, id, d, name)`` with the name of their group.

    ``keep`` is the best row: ``(-size, id is null, id, row)``.  Digests are
    counted first.  The texts of those that repeat are told apart by digest and
    text: that is the comparison of bytes.  Where one digest has several texts,
    each is a group of its own.
    """
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("void"), "id", "row")).alias("keep")
    plain = F.concat(F.lit(f"{prefix}:"), F.hex("d"))
    counted = scratch.table(rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), best))
    texts = scratch.table(_repeated(rows, counted).select("d", "t").distinct().groupBy("d").agg(F.count(F.lit(1)).alias("texts")))
    several = scratch.table(texts.where("texts > 1").select("d"))
    slim = rows.select("row", "id", "d")
    if not several.limit(1).count():
        return counted.select(plain.alias("name"), "d", "n", "keep"), slim.withColumn("name", plain)
    split = rows.join(several, "d", "left_semi").groupBy("d", "t").agg(F.count(F.lit(1)).alias("n"), best).withColumn("i", F.row_number().over(Window.partitionBy("d").orderBy("t")))
    split = scratch.table(split.select(F.concat(plain, F.lit(":"), "i").alias("name"), "d", "t", "n", "keep"))
    groups = counted.join(several, "d", "left_anti").select(plain.alias("name"), "d", "n", "keep").union(split.select("name", "d", "n", "keep"))
    apart = rows.join(split.select("d", "t", "name"), ["d", "t"]).select(*slim.columns, "name")
    return scratch.table(groups), scratch.table(slim.join(several, "d", "left_anti").withColumn("name", plain).unionByName(apart))


def _repeated(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """The rows whose digest repeats; a digest of very many rows is met by broadcast, so that its rows stay in their tasks."""
    limit = max(1, rows.count() // HEAVY)
    heavy = F.broadcast(counted.where(F.col("n") > limit).select("d"))  # fewer than HEAVY
    light = _few(counted.where((F.col("n") > 1) & (F.col("n") <= limit)).select("d"), 40)
    return rows.join(heavy, "d", "left_semi").unionByName(rows.join(heavy, "d", "left_anti").join(light, "d", "left_semi"))


def _few(keys: DataFrame, weight: int) -> DataFrame:
    """``keys``, marked for broadcast if all of ``weight`` bytes each take ``KEY_BYTES`` at most."""
    return F.broadcast(keys) if keys.count() * weight <= KEY_BYTES else keys


def short(d: Column | str) -> Column:
    """The 64 bits of a digest that filters are made of."""
    return F.xxhash64(d)


def snapshot(rows: DataFrame, groups: DataFrame, scratch: Scratch) -> Snapshot:
    """The groups of ``rows`` as a snapshot, with a filter for each bucket of digests."""
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))

    def build(table: pa.Table) -> pa.Table:
        f = Fuse.build(table.column("f").to_numpy())
        return pa.table({"bucket": table.column("bucket")[:1], "seed": [f.seed], "bits": [f.bits], "segments": [f.segments], "slots": [f.slots.tobytes()]})

    keys = groups.select(F.pmod(short("d"), F.lit(buckets)).cast("long").alias("bucket"), short("d").alias("f"))
    filters = keys.groupBy("bucket").applyInArrow(build, "bucket long, seed long, bits long, segments long, slots binary")
    return Snapshot(rows, groups, scratch.table(filters), buckets)


def screened(keys: DataFrame, snap: Snapshot) -> DataFrame:
    """Those of the 64-bit ``keys(f)`` that a filter of the snapshot may hold; no key that it holds is missing.

    Keys stream past the filter of their bucket; a bucket that has far more
    keys than a filter was made for is dealt to several tasks, each of which
    gets the filter.
    """
    bounded_batches(keys.sparkSession)
    salts = max(1, -(-keys.count() // (snap.buckets * 4 * BUCKET_KEYS)))
    none = lambda kind: F.lit(None).cast(kind)
    asked = keys.select(F.pmod("f", F.lit(snap.buckets)).alias("bucket"), F.pmod(F.shiftrightunsigned("f", 40), F.lit(salts)).alias("salt"), "f", *[none("long").alias(c) for c in ("seed", "bits", "segments")], none("binary").alias("slots"))
    dealt = snap.filters.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), none("long").alias("f"), "seed", "bits", "segments", "slots")
    both = asked.unionByName(dealt).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("slots").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)] if len(buckets) else []
            for low, high in zip(edges, edges[1:], strict=False):
                if buckets[low] != at:
                    at, held = buckets[low], None
                part = batch.slice(low, high - low)
                slots = part.column("slots")
                for i in range(part.num_rows - slots.null_count) if slots.null_count < part.num_rows else ():
                    seed, bits, segments = (part.column(c)[i].as_py() for c in ("seed", "bits", "segments"))
                    held = Fuse(seed, bits, segments, np.frombuffer(slots[i].as_py(), dtype=np.uint8))
                f = part.column("f").drop_null()
                if held is not None and len(f):
                    keep = held.holds(f.to_numpy())
                    yield pa.RecordBatch.from_arrays([f.filter(pa.array(keep))], ["f"])

    return both.mapInArrow(lean(_by_salt(run)), "f long")


def _by_salt(run):  # noqa: ANN001, ANN202
    """Splits batches where the salt changes within a bucket, so that each part starts with its own filter."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                salt = batch.column("salt").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(salt)) + 1).tolist(), len(salt)] if len(salt) else []
                for low, high in zip(edges, edges[1:], strict=False):
                    yield batch.slice(low, high - low)

        yield from run(parts())

    return split


def known(rows: DataFrame, groups: DataFrame, snap: Snapshot, scratch: Scratch) -> DataFrame:
    """``(name, of)`` for the groups of a batch whose text the snapshot has: ``of`` is the snapshot's name for it.

    The batch's digests go through the filters; one text of each group that
    may be known meets the exact bucket of its digest and is compared there.
    """
    keyed = lambda df, name: df.select(F.col("name").alias(name), short("d").alias("f"), F.col("keep.row").alias("row"))
    maybe = scratch.table(screened(keyed(groups, "name").select("f").distinct(), snap).distinct())

    def texts(all_rows: DataFrame, of: DataFrame, name: str, text: str) -> DataFrame:
        asked = scratch.table(keyed(of, name).join(maybe, "f", "left_semi").select(name, "row"))
        return all_rows.select("row", "d", F.col("t").alias(text)).join(_few(asked, 100), "row").select(name, "d", text)

    met = texts(rows, groups, "name", "t").join(texts(snap.rows, snap.groups, "of", "there"), "d")
    return scratch.table(met.where("t = there").select("name", "of"))


def exact_duplicates(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", older: Column | None = None) -> DataFrame:
    """One row per document: ``(key, keep_id, group_size, kept, text_sha256)``.

    Of equal texts the row with the most code points in its original text
    stays, then the one with the smallest key (null keys last), then the one
    read first, so that of rows that repeat in whole one stays.  ``older``
    says which rows make up the snapshot (half of them, by a hash of the key,
    if not given); the others come as one batch against it.  The groups do not
    depend on that choice.  Null texts count as empty; texts of white space
    only equal them; an empty table gives no rows; other columns are ignored.
    """
    older = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(2)) == 0 if older is None else older
    rows = rows_of(docs, scratch, key, text, (~F.coalesce(older, F.lit(False))).cast("int"))
    old, new = rows.where("lot = 0"), rows.where("lot = 1")
    old_groups, old_rows = grouped(old, scratch, "s")
    new_groups, new_rows = grouped(new, scratch, "b")
    snap = snapshot(old, old_groups, scratch)
    links = known(new, new_groups, snap, scratch)
    named = old_groups.select("name", F.col("name").alias("of"), "n", "keep").union(new_groups.join(links, "name", "left").select("name", F.coalesce("of", "name").alias("of"), "n", "keep"))
    named = scratch.table(named)
    both = scratch.table(named.groupBy("of").agg(F.sum("n").alias("n"), F.min("keep").alias("keep"), F.count(F.lit(1)).alias("parts")).where("n > 1"))
    final = scratch.table(named.select("name", "of").join(both, "of").select("name", "n", "keep"))
    return _told(old_rows.unionByName(new_rows), final, rows.count()).select(
        F.col("id").alias(key), F.coalesce("keep.id", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"), F.lower(F.hex("d")).alias("text_sha256")
    )


def _told(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Rows with the size and best row of their group, if it has others.

    Groups that hold more than one of ``HEAVY`` of all rows are fewer than
    ``HEAVY``, so these are broadcast whatever the input; no other group is
    large enough to weigh on the task that its name is dealt to.
    """
    heavy = groups.where(F.col("n") > max(1, total // HEAVY))
    told = rows.join(F.broadcast(heavy), "name", "left")
    rest = told.where("n is null").select(*rows.columns).join(groups.join(F.broadcast(heavy.select("name")), "name", "left_anti"), "name", "left")
    return told.where("n is not null").unionByName(rest)
