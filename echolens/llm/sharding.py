"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring; a key belongs to the arc
that ends at the next point clockwise.  A shard takes at most its capacity;
the keys it has no room for go on clockwise to the next shard that has.

Only the number of keys of each arc reaches the driver (``shards * vnodes``
numbers, whatever the table holds).  There the overflow is worked out as
ranges of ranks within arcs, and the rows then find their range through a
small broadcast table whose size is bounded by the ring.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import Scratch, bounded_batches, ranked

VNODES = 128


@dataclass(frozen=True)
class Segment:
    """Ranks ``[low, high)`` of an arc go to ``shard``, at slots from ``slot``."""

    arc: int
    low: int
    high: int
    shard: int
    slot: int


def ring_points(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring points (signed 64 bit) and the shard at each."""
    named = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in named], dtype=np.int64), np.array([s for _, s in named], dtype=np.int32)


def capacities(demand: np.ndarray, total: int) -> np.ndarray:
    """Row capacities that sum to ``total`` and are at most one apart; the fullest shards get the odd rows."""
    n = len(demand)
    caps = np.full(n, total // n, dtype=np.int64)
    caps[np.argsort(-demand, kind="stable")[: total % n]] += 1
    return caps


def bounded_loads(counts: np.ndarray, owners: np.ndarray, shards: int) -> list[Segment]:
    """Deals the keys of all arcs out under the capacities, clockwise."""
    demand = np.bincount(owners, weights=counts, minlength=shards).astype(np.int64)
    room = capacities(demand, int(counts.sum()))
    used = np.zeros(shards, dtype=np.int64)
    plan: list[Segment] = []

    def put(arc: int, low: int, shard: int, want: int) -> int:
        n = int(min(want, room[shard]))
        if n:
            plan.append(Segment(arc, low, low + n, shard, int(used[shard])))
            room[shard] -= n
            used[shard] += n
        return n

    over: list[tuple[int, int, int]] = []
    for arc, (count, owner) in enumerate(zip(counts.tolist(), owners.tolist(), strict=True)):
        n = put(arc, 0, owner, count)
        if n < count:
            over.append((arc, n, count))
    for arc, low, high in over:
        at = arc
        while low < high:
            at = (at + 1) % len(owners)
            low += put(arc, low, int(owners[at]), high - low)
    return plan


def shard_rows(docs: DataFrame, key: str = "doc_id", shards: int = 40, vnodes: int = VNODES, carry: dict | None = None) -> DataFrame:
    """Rows ``(key, *carry, shard int, slot long)`` for every row of ``docs``.

    Row counts of the shards are at most one apart; slots are gapless from 0
    within a shard.  Null keys share one ring position, equal keys another;
    either overflow like all others, so they crowd no shard.  ``carry`` names
    columns to compute beside the key.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    points, owners = ring_points(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, h.to_numpy(np.int64), side="left") % len(points)).astype("int32")

    scratch = Scratch(spark)
    carried = [c.alias(name) for name, c in (carry or {}).items()]
    keyed = docs.select(F.col(key), *carried, F.xxhash64(F.col(key).cast("string")).alias("_h"))
    slim = scratch.table(keyed.withColumn("_arc", arc_of("_h")))
    counts = np.zeros(len(points), dtype=np.int64)
    for arc, n in slim.groupBy("_arc").count().collect():  # one number per ring point
        counts[arc] = n
    plan = bounded_loads(counts, owners, shards)
    if not plan:
        return slim.select(key, *(carry or {}), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot")).limit(0)
    table = spark.createDataFrame(pd.DataFrame(plan), "_arc int, _low long, _high long, shard int, _slot long")
    rows = ranked(slim, ["_arc"], ["_h", key], rank="_rank", salts=16)
    hit = rows.join(F.broadcast(table), "_arc").where((F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    return scratch.finish(hit.select(key, *(carry or {}), "shard", (F.col("_slot") + F.col("_rank") - F.col("_low")).alias("slot")))
