"""Plumbing shared by the training-data operators.

* ``Scratch`` writes intermediate tables to the folder the session names in
  ``spark.checkpoint.dir`` so that they outlive lost executors, and deletes
  them again once the operator has written its result; what a lazy result
  still reads goes with ``release`` or when the driver ends.
* ``ranked`` numbers the rows of each group without a gap although no group
  is ever held by one task.
* ``components`` contracts an edge list to connected components without
  sending links to the driver.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Largest Arrow batch, in bytes and rows, that a Python stage is handed.
ARROW_BYTES = 4 << 20
ARROW_ROWS = 2000
#: Bytes of a table, and of a table of 8-byte keys, that may be broadcast.
LIGHT_BYTES, KEY_BYTES = 16 << 20, 64 << 20
#: Rows of each hot group are dealt over so many sub-groups.
SALTS = 64

_own_dir: list[str] = []


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that very long texts fit in a Python worker.

    The session's own limits are lowered where they are higher, and stay so:
    a lazy result reads them when it runs.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(name).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def light(stored: DataFrame, weight: Column | int) -> DataFrame:
    """``stored``, marked for broadcast if its rows, of ``weight`` bytes each, take ``LIGHT_BYTES`` at most."""
    size = stored.agg(F.sum(F.lit(weight) if isinstance(weight, int) else weight)).first()[0] or 0
    return F.broadcast(stored) if size <= LIGHT_BYTES else stored


def with_matches(rows: DataFrame, stored: DataFrame, key: str, outer: bool = False) -> DataFrame:
    """``rows`` joined with the few of them that ``stored`` has something for, by a 64-bit ``key``; with ``outer`` all rows.

    The keys go to the rows first, as long as they may be broadcast, so only
    rows with a match are moved; the others stay where they are.
    """
    keys = stored.select(key)
    if 24 * keys.count() > KEY_BYTES:
        return rows.join(stored, key, "left" if outer else "inner")
    keys = F.broadcast(keys)
    found = rows.join(keys, key, "left_semi").join(stored, key)
    if not outer:
        return found
    rest = rows.join(keys, key, "left_anti")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[c for c in stored.columns if c != key]).union(rest.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema if f.name != key]))


def trim() -> None:
    """Gives memory that a worker has freed back to the system; the worker lives on beside later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that trims the worker's memory at its end."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in parts, for functions whose Python objects take far more than their texts."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def lean_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function over groups, after each group of some size."""

    @functools.wraps(f)
    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            if table.nbytes > 1 << 20:
                trim()

    return run


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; one of our own only on a single machine whose session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="echolens-"))
    return _own_dir[0]


class Scratch:
    """Intermediate Parquet tables of one operator call."""

    #: All that may still have tables, oldest first.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/echolens-{uuid.uuid4().hex}"
        self._n = 0
        Scratch.made.append(self)

    def table(self, df: DataFrame, **options: str) -> DataFrame:
        """Writes ``df`` and reads it back: the lineage ends here."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as the last table and deletes those before it."""
        last = self.table(df)
        for n in range(1, self._n):
            self._delete(f"{self.root}/t{n}")
        return last

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the given tables."""
        for path in sorted({f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}):
            self._delete(path)

    def clear(self) -> None:
        """Deletes all tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(since: int) -> None:
    """Deletes what was made after ``Scratch.made`` had ``since`` entries: for when the results that read it are written."""
    while len(Scratch.made) > since:
        Scratch.made.pop().clear()


@atexit.register
def _at_end() -> None:
    for s in Scratch.made:
        if s.spark.sparkContext._jsc is None:  # the session was stopped before
            return
        with contextlib.suppress(Exception):  # the engine may be gone already
            s.clear()


def private(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names that ``df`` does not have, whatever their case: ``names`` with underscores in front."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def utf8_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text (null counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit("second"), t)


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str], rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """Adds ``rank``: 0-based and gapless within ``groups``.

    ``df`` must be a stored table (its row order per file split decides the
    sub-group of a row, so that even equal rows spread).  Rows are ordered by
    ``order`` within a sub-group; sub-groups follow one another.  Each task
    sorts one sub-group, never a whole group.
    """
    keys = [*groups, "_salt"]
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys).orderBy(*order)
    rows = salted.withColumn("_rn", F.row_number().over(inner) - 1)
    joined = rows.join(starts, [rows[k] == starts[k] for k in keys])
    return joined.select(*[rows[c] for c in df.columns], (F.col("_start") + F.col("_rn")).cast("long").alias(rank))


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, root)`` with the smallest reachable node.

    Alternates large-star and small-star contraction; each round is two
    aggregations over the remaining edges, written to the shared folder.
    A star round hangs neighbours on the group's smallest member through a
    partially aggregated minimum and a join that adaptive execution may
    split, so a node with very many neighbours is not one task's work.
    """
    cur = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        large = scratch.table(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.table(small)
        moved = new.count() != cur.count() or new.join(cur, ["u", "v"], "left_anti").limit(1).count()
        scratch.drop(large)
        scratch.drop(cur)
        cur = new
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_columns_of(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with just the columns of ``like``, in its order."""
    return df.select(*[F.col(f"`{c}`") for c in like.columns])
