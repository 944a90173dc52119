"""Order-dependent operators: first-wins, running numbers, carry-forward, packing, paging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key.  A partial minimum runs before the shuffle, so a frequent key sends one row from each task."""
    cols = df.columns
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[r.alias(f"_o{i}") for i, r in enumerate(ranks)], F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))).alias("_best"))
    return best.select("_best._row.*")


def latest_of(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    cols = df.columns
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(by).alias("_o"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))).alias("_best")).select("_best._row.*")


def best_match(pairs: DataFrame, probe: str, score: Column, tie: str) -> DataFrame:
    """The best scored partner of each probe row, ties to the smaller ``tie``."""
    return first_of(pairs.withColumn("_score", -score), [probe], ["_score", tie]).drop("_score")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key (a report)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def blocks_before(df: DataFrame, group: Sequence[str], block: Column, over: Sequence[Column]) -> DataFrame:
    """``df`` with ``_block`` and, of all earlier blocks of its group, the aggregates ``over`` of theirs.

    ``block`` must not fall as the order of a group rises.  What follows works
    within blocks, so a frequent key is not one task's work: of a group, only
    one row a block meets in one place.  Aggregates named ``_last...`` carry
    the last value on, ``_most...`` the greatest, others the sum.
    """
    rows = df.withColumn("_block", block)
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_block").agg(*over)
    names = [c for c in totals.columns if c not in (*group, "_block")]
    folded = [(F.last(c, ignorenulls=True) if c.startswith("_last") else F.max(c) if c.startswith("_most") else F.sum(c)).over(earlier).alias(c) for c in names]
    before = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_block").alias("_b"), *folded)
    same = [rows[g].eqNullSafe(before[f"_g{i}"]) for i, g in enumerate(group)] + [rows["_block"].eqNullSafe(before["_b"])]
    return rows.join(before, same).drop("_b", *[f"_g{i}" for i in range(len(group))])


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], block: Column, start: int = 1, name: str = "number") -> DataFrame:
    """Running numbers within a group, going on from ``start``; ``block`` as in ``blocks_before``."""
    rows = blocks_before(df, group, block, [F.count(F.lit(1)).alias("_count")])
    within = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order))
    return rows.withColumn(name, (within + F.coalesce("_count", F.lit(0)) + (start - 1)).cast("int")).drop("_block", "_count")


def carried(df: DataFrame, value: Column, group: Sequence[str], order: str, block: Column, name: str) -> DataFrame:
    """``df`` with the last non-null value up to each row of its group."""
    rows = df.withColumn(name, value)
    rows = blocks_before(rows, group, block, [F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias("_last")])
    within = F.last(name, ignorenulls=True).over(Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(within, "_last")).drop("_block", "_last")


def merged_intervals(df: DataFrame, group: Sequence[str], start: str, end: str, block: Column) -> DataFrame:
    """Intervals that touch or overlap made one, within each group; ``block`` is one of their starts."""
    w = lambda: Window.partitionBy(*group, "_block").orderBy(start, end)
    rows = blocks_before(df.select(*group, start, end), group, block, [F.max(end).alias("_most")])
    reach = F.greatest(F.max(end).over(w().rowsBetween(Window.unboundedPreceding, -1)), F.col("_most"))
    opened = rows.withColumn("_open", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).drop("_most", "_block")
    counted = blocks_before(opened, group, block, [F.sum("_open").alias("_sum")])
    island = counted.withColumn("_island", F.sum("_open").over(w().rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_sum", F.lit(0)))
    return island.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def packed_pages(lines: DataFrame, group: str, order: str, line: str, limit: int, joint: str = "\n\n", head: str | None = None, head_alone: bool = True) -> DataFrame:
    """Greedy pages of at most ``limit`` characters, one line at least: ``(group, page, first, shown, text)``.

    ``head`` names a column whose first non-empty value starts a group's
    first page and counts in its budget; if the first line does not fit beside
    it, it is a page of its own with ``head_alone``.  Lines of a group arrive sorted and in
    batches; a task holds a page, not a group.
    """
    kind = lines.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, page int, first int, shown int, text string"

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = None
        begun = False
        number = first = shown = seen = 0
        current = ""
        out: list[tuple] = []

        def close() -> None:
            nonlocal number
            if current or shown:
                out.append((at, number, first, shown, current))
                number += 1

        for pdf in parts:
            for key, text, start in zip(pdf[group], pdf[line].fillna(""), pdf["_head"].fillna(""), strict=True):
                if not begun or key != at:
                    if begun:
                        close()
                    begun, at, number, first, shown, seen, current = True, key, 0, 0, 0, 0, start
                longer = current + joint + text if current or shown else text
                if (shown or (current and head_alone)) and len(longer) > limit:
                    close()
                    current, first, shown = text, seen, 1
                else:
                    current, shown = longer, shown + 1
                seen += 1
            if out:
                yield pd.DataFrame(out, columns=[group, "page", "first", "shown", "text"])
                out.clear()
        if begun:
            close()
            yield pd.DataFrame(out, columns=[group, "page", "first", "shown", "text"])

    rows = lines.where(F.col(group).isNotNull()).select(group, order, line, (F.col(head) if head else F.lit(None).cast("string")).alias("_head"))
    return rows.repartition(group).sortWithinPartitions(group, order, line).select(group, line, "_head").mapInPandas(pack, schema)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page; only ``offset + limit`` rows are ever sorted together."""
    top = df.orderBy(*order)
    return (top.offset(offset) if offset else top).limit(limit)


def newest_first(published: str = "published_at", tie: str = "id", undated_first: bool = False) -> list[Column]:
    return [F.desc_nulls_first(published) if undated_first else F.desc_nulls_last(published), F.asc(tie)]


def problems_first(links: DataFrame) -> DataFrame:
    """Links to look into, by status and host."""
    return links.orderBy("status", F.col("host").cast("int"), "host", "id")


def batch_state(total: int, offset: int, shown: int) -> tuple[int, int]:
    """``(next offset, remaining)`` after a batch."""
    return offset + shown, max(total - offset - shown, 0)


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of ``size`` rows; a size below one counts as one."""
    out: list = []
    for r in rows:
        out.append(r)
        if len(out) >= max(1, size):
            yield out
            out = []
    if out:
        yield out
