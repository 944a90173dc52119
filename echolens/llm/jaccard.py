"""N-gram Jaccard join as a blocked sparse product of the incidence matrix.

Rows of the matrix are distinct n-gram sets, columns are n-grams.  The
product of the matrix with its transpose counts overlaps.  Columns are put in
one order for all rows (frequent n-grams last) and of each row only the first
entries, a little over a quarter, are multiplied: linked sets of ``n`` and
``m`` n-grams share ``bound(n, m)`` of them, so all but a known number of the
first entries of one of the two are shared.  Pairs with a smaller partial
count are discarded.

* Blocks of columns are packed arrays, one task multiplies one block.  In a
  short column all pairs are counted, in a long one each row is paired with
  the column's most central row only.
* Pairs whose counts reach the bound are compared in full, and components
  are contracted from those that link.
* Rows of long columns that did not end up in one component are gathered
  around the most central row of each column and multiplied tile by tile, as
  bit matrices.  The counts of a pair's tiles and short columns are added up
  before its bound is tested; clusters with very many possible pairs are
  multiplied in full instead.  No link is lost.

Tiles and blocks are bounded by the bytes of their sets, bit matrices by
strips of columns.  Only frequent n-grams (a bounded number) and sums reach
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.bytetext import LOWER, Lane, U, mix, slices, words
from echolens.llm.common import Scratch, bounded_batches, components, lean, lean_group, light, private

GRAM = 5
#: Similarity as a fraction.
SHARE = (3, 4)
#: An n-gram is frequent if a worker sees it so often among so many; so many frequent ones are kept at most (an order, not a filter).
OFTEN, AMONG, MOST_FREQUENT = 3, 1_000_000, 500_000
#: Entries that a worker sends at once; entries of a block; rows of a column up to which all its pairs are formed.
FLUSH, BLOCK_ENTRIES, SHORT = 500_000, 200_000, 6
#: Names of sets that a worker remembers to leave out copies.
KNOWN = 100_000
#: A frequent column's entries are dealt over so many blocks.
SHARES = 16
#: ``far``: permille of the set that is not frequent; the most central set of a column has least.
ENTRY = np.dtype([("gram", "<u8"), ("set", "<i8"), ("n", "<i4"), ("far", "<i4")])
#: Rows and bytes of sets of a tile, bytes of sets in a block of tiles, and bytes of a strip of a tile's bit matrix.
TILE, TILE_BYTES, BLOCK_BYTES, STRIP_BYTES = 1024, 2 << 20, 8 << 20, 16 << 20
#: Possible pairs for each row of a cluster's tile beyond which the tile's whole rows are multiplied.
MANY_PAIRS = 3
_lanes: list[Lane] = []


def sets_of(col: pa.Array) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    if not _lanes:
        _lanes.append(Lane(31))
    powers = [U(pow(0x9E3779B97F4A7C15, i, 2**64)) for i in range(GRAM)]
    for _, data, at in slices(col):
        start, end, first = words(data, at)
        h = _lanes[0].span(_lanes[0].prefix(LOWER[data]), start, end)
        grams = np.zeros(max(0, len(h) - GRAM + 1), dtype=np.uint64)
        for i, p in enumerate(powers):
            grams += h[i : i + len(grams)] * p
        grams = mix(grams)
        for i in range(len(at) - 1):
            a, z = int(first[i]), int(first[i + 1])
            if z - a >= GRAM:
                yield np.unique(grams[a : z - GRAM + 1])
            elif z > a:  # fewer words than an n-gram: the sequence itself
                yield mix(np.array([sum(int(h[a + j]) * int(powers[j]) for j in range(z - a)) + z - a & 2**64 - 1], dtype=np.uint64) ^ U(0x5DEECE66D))
            else:
                yield np.zeros(0, dtype=np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as signed numbers."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=np.uint64).view(np.int64))


def bound(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of these sizes: ``overlap >= share / (1 + share) * (n + m)``."""
    a, b = SHARE
    return -(-(a * (n.astype(np.int64) + m)) // (a + b))


def first_entries(n: np.ndarray) -> np.ndarray:
    """How many entries of a row of ``n`` are multiplied: one more than a linked row can lack."""
    a, b = SHARE
    return n - -(-a * n.astype(np.int64) // b) + 1


def partial_bound(na: Column, nb: Column) -> Column:
    """Least count of shared first entries of linked rows, as an expression."""
    a, b = SHARE
    need = F.ceil((na + nb) * a / (a + b))
    lack = lambda n: need - F.ceil(n * a / b) + 1  # noqa: E731  overlap - n + first entries
    return F.least(lack(na), lack(nb))


def alike_in_size(na: Column, nb: Column) -> Column:
    return (na * SHARE[1] >= nb * SHARE[0]) & (nb * SHARE[1] >= na * SHARE[0])


def row_names(key: str, text: str) -> list[Column]:
    """``g1, g2``: 128 bits that stand for a row's key and text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [F.xxhash64(F.col(f"`{key}`"), t).alias("g1"), F.xxhash64(F.lit("second"), t, F.col(f"`{key}`")).alias("g2")]


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n, d1, d2, g1, g2)`` of each row, and ``(gram, seen)`` of n-grams that are frequent somewhere (the other columns null)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, n = [], 0
        seen_sets: set[int] = set()

        def frequent() -> pa.RecordBatch:
            grams, seen = np.unique(np.concatenate(pool), return_counts=True)
            hit = seen >= OFTEN
            k = int(hit.sum())
            cols = [pa.nulls(k, ktype), *(pa.nulls(k, pa.int64()) for _ in range(5)), pa.array(grams[hit].view(np.int64)), pa.array(seen[hit].astype(np.int64))]
            return pa.RecordBatch.from_arrays(cols, names)

        names = [key, "n", "d1", "d2", "g1", "g2", "gram", "seen"]
        ktype = pa.int64()
        for batch in batches:
            ktype = batch.column(0).type
            rows = []
            for s in sets_of(batch.column(1)):
                rows.append((len(s), *digest(s)))
                if rows[-1][1] not in seen_sets:  # copies say nothing of how frequent an n-gram is among sets
                    seen_sets.add(rows[-1][1])
                    pool.append(s)
                    n += len(s)
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, batch.column(2), batch.column(3), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names)
            if n >= AMONG:
                yield frequent()
                pool, n = [], 0
                seen_sets.clear()
        if n:
            yield frequent()

    return docs.select(key, text, *row_names(key, text)).mapInArrow(lean(run), f"`{key}` {kind}, n long, d1 long, d2 long, g1 long, g2 long, gram long, seen long")


def multiplied(docs: DataFrame, last: np.ndarray, blocks: int, text: str) -> DataFrame:
    """Product of the column blocks: pairs ``(a, b, na, nb, count, star)``, and the entries ``(a, na, gram, share)`` of long columns.

    ``last`` holds the frequent n-grams, ascending.  A frequent column's
    entries are many: they are dealt over the blocks by set as well, and each
    share works as a column of its own; ``gram`` still names the whole one.
    """
    a, b = SHARE

    def frequent(grams: np.ndarray) -> np.ndarray:
        if not len(last):
            return np.zeros(len(grams), dtype=np.uint64)
        return (last[np.minimum(np.searchsorted(last, grams), len(last) - 1)] == grams).astype(np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        pool, n = [], 0

        def flush() -> pa.RecordBatch:
            e = np.concatenate(pool)
            home = ((e["gram"] >> U(20)) + frequent(e["gram"]) * (e["set"].view(np.uint64) % U(SHARES))) % U(blocks)
            order = np.argsort(home, kind="stable")
            numbers, starts = np.unique(home[order], return_index=True)
            e = e[order]
            parts = [e[lo:hi].tobytes() for lo, hi in zip(starts, [*starts[1:], len(e)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), pa.array(parts, pa.binary())], ["block", "entries"])

        for batch in batches:
            for s in sets_of(batch.column(0)):
                if not len(s):
                    continue
                name = digest(s)[0]
                if name in sent:
                    continue
                if len(sent) >= KNOWN:
                    sent.clear()
                sent.add(name)
                far = 1000
                if len(last):
                    late = frequent(s) == 1
                    far = 1000 - 1000 * int(late.sum()) // len(s)
                    s = np.concatenate([s[~late], s[late]]) if late.any() else s
                most = int(first_entries(np.array(len(s))))
                e = np.zeros(most, dtype=ENTRY)
                e["gram"], e["set"], e["n"], e["far"] = s[:most], name, len(s), far
                pool.append(e)
                n += most
                if n >= FLUSH:
                    yield flush()
                    pool, n = [], 0
            if n >= FLUSH:
                yield flush()
                pool, n = [], 0
        if n:
            yield flush()

    def multiply(table: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x, dtype=ENTRY) for x in table.column("entries").to_pylist()])
        share = (frequent(e["gram"]) * (U(1) + e["set"].view(np.uint64) % U(SHARES))).astype(np.int64)  # 0: the column is whole
        order = np.lexsort((e["set"], e["far"], share, e["gram"]))
        e, share = e[order], share[order]
        new = np.concatenate([[True], (e["gram"][1:] != e["gram"][:-1]) | (e["set"][1:] != e["set"][:-1])])
        e, share = e[new], share[new]
        first = np.flatnonzero(np.concatenate([[True], (e["gram"][1:] != e["gram"][:-1]) | (share[1:] != share[:-1])]))
        size = np.diff(np.concatenate([first, [len(e)]]))
        found = []
        shares, whole = SHARE

        def keep(x: np.ndarray, y: np.ndarray, star: int) -> None:
            n, m = e["n"][x].astype(np.int64), e["n"][y].astype(np.int64)
            ok = (n * whole >= m * shares) & (m * whole >= n * shares)
            sx, sy, n, m = e["set"][x][ok], e["set"][y][ok], n[ok], m[ok]
            low = sx < sy
            found.append(np.stack([np.where(low, sx, sy), np.where(low, sy, sx), np.where(low, n, m), np.where(low, m, n), np.full(len(sx), star)]))

        for k in range(2, SHORT + 1):
            starts = first[size == k]
            for i in range(k):
                for j in range(i + 1, k):
                    keep(starts + i, starts + j, 0)
        long = size > SHORT
        head = np.repeat(first[long], size[long] - 1)
        each = size[long] - 1
        step = np.arange(len(head)) - np.repeat(np.cumsum(each) - each, each) + 1
        keep(head, head + step, 1)
        p = np.concatenate(found, axis=1)
        p = p[:, np.lexsort((p[4], p[1], p[0]))]
        new = np.flatnonzero(np.concatenate([[True], (p[:, 1:] != p[:, :-1])[[0, 1, 4]].any(axis=0)])) if p.shape[1] else np.zeros(0, dtype=np.int64)
        count = np.diff(np.concatenate([new, [p.shape[1]]]))
        p = p[:, new]
        held = np.repeat(long | (share[first] > 0), size)
        rest, share = e[held], share[held]
        k, m = p.shape[1], len(rest)

        def column(left: np.ndarray | None, right: np.ndarray | None) -> pa.Array:
            parts = [pa.nulls(k, pa.int64()) if left is None else pa.array(left.astype(np.int64)), pa.nulls(m, pa.int64()) if right is None else pa.array(right.astype(np.int64))]
            return pa.chunked_array(parts).combine_chunks()

        cols = [column(p[0], rest["set"]), column(p[1], None), column(p[2], rest["n"]), column(p[3], None), column(count, None), column(p[4], None), column(None, rest["gram"].view(np.int64)), column(None, share), column(None, rest["far"])]
        return pa.table(cols, names=["a", "b", "na", "nb", "count", "star", "gram", "share", "far"])

    sent = docs.select(text).mapInArrow(lean(scan), "block long, entries binary")
    return sent.groupBy("block").applyInArrow(lean_group(multiply), "a long, b long, na long, nb long, count long, star long, gram long, share long, far long")


class Sets:
    """Makes the n-gram sets of named rows of the matrix from their texts."""

    def __init__(self, docs: DataFrame, rows: DataFrame, scratch: Scratch, key: str, text: str) -> None:
        self.texts = docs.select(F.col(f"`{text}`").alias("text"), *row_names(key, text))
        self.scratch = scratch
        self.homes = scratch.table(rows.where("n > 0").groupBy(F.col("d1").alias("set")).agg(F.min(F.struct("g1", "g2")).alias("g")))
        self.repeated = bool(rows.where("n > 0").groupBy("g1", "g2").count().where("count > 1").limit(1).count())

    def of(self, names: DataFrame) -> DataFrame:
        """``(set, grams)``, one row for each of the distinct ``names(set)``; only their texts are read on."""
        asked = self.scratch.table(names.join(self.homes, "set").select("g.g1", "g.g2"))

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 64):
                    out = [(digest(s)[0], packed(s)) for s in sets_of(batch.column(0).slice(low, 64)) if len(s)]
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([g for _, g in out], pa.binary())], ["set", "grams"])

        made = self.texts.join(light(asked, 64), ["g1", "g2"], "left_semi").select("text").mapInArrow(lean(make), "set long, grams binary")
        return self.scratch.table(made.groupBy("set").agg(F.max("grams").alias("grams")) if self.repeated else made)


def linked(sets_of_names: Sets, pairs: DataFrame) -> DataFrame:
    """Those of the stored ``pairs(a, b)`` whose exact overlap reaches the bound."""
    sets = sets_of_names.of(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct())

    def count_overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [overlap(unpacked(p), unpacked(q)) >= int(bound(np.array(len(p) // 6), np.array(len(q) // 6))) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], ["a", "b"])

    left = pairs.join(sets.select(F.col("set").alias("b"), F.col("grams").alias("gb")), "b")
    both = left.join(sets.select(F.col("set").alias("a"), F.col("grams").alias("ga")), "a")
    return both.select("a", "b", "ga", "gb").mapInArrow(lean(count_overlap), "a long, b long")


def packed(s: np.ndarray) -> bytes:
    """Six bytes of each hash: the upper 48 bits, ascending."""
    return (s >> U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def near_duplicates(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, n_shingles, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest key reachable by links, the row's own
    included.  Rows with equal sets are linked; a text without words has an
    empty set, is linked with nothing and is its own component (its key).
    Null keys are no smallest key: a component of null keys only has null.
    Repeated rows share a component; an empty table gives no rows.
    """
    rows, named = _classes(docs, scratch, key, text)
    out = rows.join(named, ["d1", "d2"], "left")
    return scratch.finish(out.select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col(key)).otherwise(F.col("component_id")).alias("component_id")))


def _classes(docs: DataFrame, scratch: Scratch, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Stored ``(key, n, d1, d2, g1, g2)`` of each row, and ``(d1, d2, root, component_id)`` of each set."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = scratch.table(measured(docs, key, text))
    rows = slim.where("n is not null").select(F.col(f"`{key}`"), "n", "d1", "d2", "g1", "g2")
    often = slim.where("gram is not null").groupBy("gram").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "gram").limit(MOST_FREQUENT).select("gram")
    last = np.sort(np.array(often.toArrow().column(0).to_numpy(), dtype=np.int64).view(np.uint64))
    total = rows.agg(F.coalesce(F.sum(F.floor(F.col("n") / 4) + 1), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    product = scratch.table(multiplied(docs, last, max(least, total // BLOCK_ENTRIES), text))
    counted = product.where("b is not null").select("a", "b", "na", "nb", "count", "star").union(heads(product))
    sums = counted.groupBy("a", "b", "na", "nb").agg(F.sum("count").alias("count"), F.max("star").alias("star"))
    need = partial_bound(F.col("na"), F.col("nb"))
    strong = F.col("count") * (1 + 3 * F.col("star")) >= need  # a star counts only some of the shared columns
    pairs = scratch.table(sums.where(strong).select("a", "b"))
    sets = Sets(docs, rows, scratch, key, text)
    links = scratch.table(linked(sets, pairs))
    roots = scratch.table(components(spark, links, scratch))
    more = across(sets, product, roots, scratch, least)
    if more is not None:
        links = scratch.table(links.union(more))
        roots = scratch.table(components(spark, links, scratch))
    found = rows.where("n > 0").groupBy("d1", "d2").agg(F.min(key).alias("_low"))
    roots = roots.select(F.col("node").alias("d1"), "root")
    roots = scratch.table(roots.union(roots.select("root", "root").distinct()))  # sets that are linked with others; all others are their own component
    held = light(roots, 48)
    lows = scratch.table(found.join(held, "d1").groupBy("root").agg(F.min("_low").alias("component_id")))
    named = found.join(held, "d1", "left").join(light(lows, 48), "root", "left")
    own = F.col("root").isNull()
    named = named.select("d1", "d2", F.when(own, F.col("d1")).otherwise(F.col("root")).alias("root"), F.when(own, F.col("_low")).otherwise(F.col("component_id")).alias("component_id"))
    return rows, scratch.table(named)  # stored, so that a join with the rows of very many copies can be split


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component.

    The row of the smallest key stays; null keys come last, and where a key
    repeats with different texts the row whose text hashes lowest stays.  Of
    rows that repeat key and text one stays, the one whose columns hash
    lowest.  Rows without words are linked with nothing and all stay.  Other
    columns are kept whatever their names; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    rows, named = _classes(docs, scratch, key, text)
    order = F.struct(F.col(f"`{key}`").isNull().alias("last"), F.col(f"`{key}`").alias("k"), "g1", "g2")
    members = rows.where("n > 0").join(named.select("d1", "d2", "root"), ["d1", "d2"]).select("root", "g1", "g2", order.alias("o"))
    first = scratch.table(members.groupBy("root").agg(F.min("o").alias("best"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows"))
    judged = members.join(light(first, 96), "root").groupBy("g1", "g2").agg(F.max((F.col("g1") != F.col("best.g1")) | (F.col("g2") != F.col("best.g2"))).alias("gone"), F.count(F.lit(1)).alias("rows"))
    told = scratch.finish(judged.where("gone or rows > 1").select("g1", "g2", "gone"))
    names = private(docs, "g1", "g2", "gone", "mark")
    marked = docs.withColumns({n: c for n, c in zip(names, row_names(key, text), strict=False)})
    weigh = light(told, 64).withColumnsRenamed({"g1": names[0], "g2": names[1], "gone": names[2]})
    marked = marked.join(weigh, [names[0], names[1]], "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    kept = marked.where(F.col(names[2]).isNull()).select(*own)
    if told.where("not gone").limit(1).count():
        again = marked.where(~F.col(names[2])).withColumn(names[3], F.xxhash64(*own))
        again = again.groupBy(names[0], names[1]).agg(F.min_by(F.struct(*own), names[3]).alias(names[3]))
        kept = kept.union(again.select(*[F.col(f"`{names[3]}`.`{c}`") for c in docs.columns]))
    return kept


def heads(product: DataFrame) -> DataFrame:
    """Pairs of the most central rows of a frequent column's shares with the most central of the whole column."""
    first = product.where("share > 0").groupBy("gram", "share").agg(F.min(F.struct("far", "a", "na")).alias("x"))
    whole = first.groupBy("gram").agg(F.min("x").alias("y"))
    both = first.join(whole, "gram").where("x.a <> y.a").select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))
    low = F.col("p.a") < F.col("q.a")
    pick = lambda f, g: F.when(low, F.col(f)).otherwise(F.col(g))
    pairs = both.select(pick("p.a", "q.a").alias("a"), pick("q.a", "p.a").alias("b"), pick("p.na", "q.na").alias("na"), pick("q.na", "p.na").alias("nb"))
    return pairs.where(alike_in_size(F.col("na"), F.col("nb"))).withColumn("count", F.lit(1).cast("long")).withColumn("star", F.lit(1).cast("long"))


def across(sets: Sets, product: DataFrame, roots: DataFrame, scratch: Scratch, least: int) -> DataFrame | None:
    """Links ``(a, b)`` between different components among rows that share a long column; None if there are no such rows.

    A column's rows gather around its most central row, so that columns of
    one group of near copies make one cluster, which is cut into tiles.  Each
    pair of tiles is first multiplied over the cluster's columns alone: a
    pair whose count cannot reach the bound, even with all that either row
    shares elsewhere, is discarded.  Where few pairs are left, the counts of
    a pair are added up over all clusters and short columns, and those that
    reach the bound are compared; where many are, the tiles' whole rows are
    multiplied.
    """
    entries = product.where("share is not null").select("gram", F.col("a").alias("set"), F.col("na").alias("n"), "far")
    e = entries.join(light(roots, 48).select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    heads = e.groupBy("gram").agg(F.min(F.struct("far", "set")).alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    heads = scratch.table(heads.select("gram", F.col("head.set").alias("centre")))
    rows = e.join(light(heads, 48), "gram").groupBy("set", "centre", "n", "root").agg(F.collect_set("gram").alias("grams"))  # a row has a quarter of its n-grams here at most
    short = product.where("star = 0")
    ends = short.select(F.col("a").alias("set"), "count").union(short.select("b", "count")).union(entries.select("set", F.lit(1).cast("long")))
    members = scratch.table(rows.join(ends.groupBy("set").agg(F.sum("count").alias("all")), "set"))
    if not members.limit(1).count():
        return None
    blocks = max(least, members.agg(F.sum(F.size("grams"))).first()[0] // BLOCK_ENTRIES)
    partial = scratch.table(tiled(members, blocks).groupBy("block").applyInArrow(lean_group(partial_tiles), "low int, high int, centre long, a long, b long, root long, na long, nb long, count long"))
    links = []
    possible = partial.where("b is not null").select("a", "b", "na", "nb", "count")
    counted = possible.union(short.select("a", "b", "na", "nb", "count").join(possible.select("a", "b").distinct(), ["a", "b"], "left_semi").select("a", "b", "na", "nb", "count"))
    enough = counted.groupBy("a", "b", "na", "nb").agg(F.sum("count").alias("count")).where(F.col("count") >= partial_bound(F.col("na"), F.col("nb")))
    pairs = scratch.table(enough.select("a", "b").distinct())
    if pairs.limit(1).count():
        links.append(linked(sets, pairs))
    whole = partial.where("b is null").select("low", "high", "centre", F.col("a").alias("set"), "root")
    if whole.limit(1).count():
        full = whole.join(sets.of(whole.select("set").distinct()), "set")
        size = full.agg(F.sum(F.length("grams"))).first()[0] or 0
        many = max(least, int(size // BLOCK_BYTES))
        links.append(full.withColumn("block", F.pmod(F.xxhash64("centre", "low", "high"), F.lit(many))).groupBy("block").applyInArrow(lean_group(whole_tiles), "a long, b long"))
    return reduce(DataFrame.union, links) if links else None


def tiled(members: DataFrame, blocks: int) -> DataFrame:
    """Members with the pair of tiles ``low, high`` of their cluster, once for each pair, and the block that holds it."""
    weight = F.sum(6 * F.col("n") + 16 * F.size("grams"))
    tiles = members.groupBy("centre").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, weight / TILE_BYTES)).cast("int").alias("tiles"))
    m = members.join(tiles, "centre").withColumn("tile", F.pmod(F.xxhash64("set"), "tiles").cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    m = m.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other", "tiles")
    return m.withColumn("block", F.pmod(F.xxhash64("centre", "low", "high"), F.lit(blocks)))


def by_tile(table: pa.Table) -> dict[tuple, list[int]]:
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("centre", "low", "high")), strict=True)):
        rows.setdefault(key, []).append(i)
    return rows


def partial_tiles(table: pa.Table) -> pa.Table:
    """Of each pair of tiles the pairs that may still link with their counts, or, if these are many, the rows that they are made of (``b`` null)."""
    name, root, n, all_, tile = (table.column(c).to_numpy() for c in ("set", "root", "n", "all", "tile"))
    grams = table.column("grams").combine_chunks()
    values, at_ = grams.values.to_numpy(), grams.offsets.to_numpy()
    out: list[tuple] = []
    for (centre, low, high), at in by_tile(table).items():
        i = np.array(at)
        # rows of one tile meet in every pair that the tile is in; they count in its pair with itself
        found, count = possible_pairs([values[at_[k] : at_[k + 1]] for k in at], root[i], n[i], all_[i], None if low == high else tile[i])
        if len(found) <= MANY_PAIRS * len(at):
            for (x, y), c in zip(found, count, strict=True):
                x, y = (i[x], i[y]) if name[i[x]] < name[i[y]] else (i[y], i[x])
                out.append((low, high, centre, int(name[x]), int(name[y]), None, int(n[x]), int(n[y]), int(c)))
        else:
            out += [(low, high, centre, int(name[i[x]]), None, int(root[i[x]]), None, None, None) for x in np.unique(found)]
    kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 7)
    return pa.table([pa.array([r[k] for r in out], kinds[k]) for k in range(9)], names=["low", "high", "centre", "a", "b", "root", "na", "nb", "count"])


def overlaps(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How many values each of the sets numbered ``rows`` shares with each set: products of bit matrices, strip by strip of the values that two sets or more hold."""
    out = np.zeros((len(rows), len(sets)), dtype=np.int32)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    place = (np.cumsum(shared) - 1)[column]
    ok = shared[column]
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok]
    place = place[ok]
    order = np.argsort(place, kind="stable")
    own, place = own[order], place[order]
    width = min(max(64, STRIP_BYTES // len(sets) // 64 * 64), -(-int(shared.sum()) // 64) * 64)
    for low in range(0, int(shared.sum()), max(1, width)):
        part = slice(*np.searchsorted(place, [low, low + width]))
        dense = np.zeros((len(sets), width), dtype=bool)
        dense[own[part], place[part] - low] = True
        bits = np.packbits(dense, axis=1).view(np.uint64)
        del dense
        for k, i in enumerate(rows):
            out[k] += np.bitwise_count(bits & bits[i]).sum(axis=1, dtype=np.int32)
    return out


def possible_pairs(sets: list[np.ndarray], roots: np.ndarray, n: np.ndarray, all_: np.ndarray, sides: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different roots, and of different sides if there are any, whose shared first entries may reach the bound, and how many they share here; both may share more elsewhere."""
    if len(sets) < 2 or (roots == roots[0]).all():
        return np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = SHARE
    rest = all_ - np.array([len(s) for s in sets])
    floor = -(-a * n // b) - 1  # n - first entries
    out, counts = [], []
    shared = overlaps(sets, np.arange(len(sets) - 1))
    for i, count in enumerate(shared):
        j = np.arange(i + 1, len(sets))
        j = j[(count[j] > 0) & (roots[j] != roots[i]) & (b * n[j] >= a * n[i]) & (b * n[i] >= a * n[j])]
        if sides is not None:
            j = j[sides[j] != sides[i]]
        if len(j):
            need = bound(n[j], n[i]) - np.maximum(floor[j], floor[i])
            j = j[count[j] + np.minimum(rest[j], rest[i]) >= need]
            out.append(np.stack([np.full(len(j), i), j], axis=1))
            counts.append(count[j])
    return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64))


def whole_tiles(table: pa.Table) -> pa.Table:
    name, root, grams = (table.column(c).to_pylist() for c in ("set", "root", "grams"))
    out: list[tuple[int, int]] = []
    for at in by_tile(table).values():
        out += tile_links([name[i] for i in at], [root[i] for i in at], [grams[i] for i in at])
    return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def tile_links(names: list[int], roots: list[int], grams: list[bytes]) -> list[tuple[int, int]]:
    """Links that join components of a tile, one for each two that become one."""
    _, label = np.unique(np.array(roots), return_inverse=True)
    if label.max() == 0:
        return []
    sets = [unpacked(g) for g in grams]
    n = np.array([len(s) for s in sets])
    out = []
    most = np.bincount(label).argmax()
    rows = np.flatnonzero(label != most)  # rows of the largest component meet all others here too
    shared = overlaps(sets, rows)
    for both, i in zip(shared, rows, strict=True):
        hit = np.flatnonzero((label != label[i]) & (4 * n >= 3 * n[i]) & (4 * n[i] >= 3 * n) & (both >= bound(n, n[i])))
        for j in hit:
            if label[j] != label[i]:
                out.append((names[i], names[j]))
                label[label == label[i]] = label[j]
    return out
