"""Cutting-stock packing by column generation.

Texts become token ids with a closing id; what fills whole sequences is cut
off first, and every rest is one piece.  The lengths of the pieces form a
histogram of ``CLASSES`` classes, which is all that reaches the driver.  A
linear program over patterns (how many pieces of each class share a
sequence) is solved there by column generation: a knapsack dynamic program
prices new patterns against the dual values until none improves.  Patterns
are rounded down, the remaining demand is filled largest first, and the
pieces of each class, ranked, are dealt to the sequences of their patterns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolens.llm.chunktable import word_table
from echolens.llm.common import Scratch, bounded_batches, lean, ranked

WIDTH = 2048
#: Lengths are rounded up to multiples of this for the histogram.
GRAIN = 8
END_ID = 1


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows ``(key, start, length, ids_crc32, doc_tokens)``, one per piece; a null text is an empty one and has the closing id only."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    end, step = END_ID.to_bytes(4, "little"), 4 * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = (table.ids(t) if t else b"") + end
                for low in range(0, len(ids), step):
                    part = ids[low : low + step]
                    at.append(i)
                    start.append(low // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            cols = [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(cols, [key, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(key, text).mapInArrow(lean(run), schema)


def best_pattern(value: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of classes ``1..len(value)`` (class ``c`` takes ``c`` units of ``cap``) of the highest value."""
    best, pick = np.zeros(cap + 1), np.zeros(cap + 1, dtype=np.int64)
    for room in range(1, cap + 1):
        most = min(room, len(value))
        gain = value[:most] + best[room - most : room][::-1]
        k = int(gain.argmax())
        if gain[k] > best[room - 1]:
            best[room], pick[room] = gain[k], k + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(value), dtype=np.int64), cap
    while room > 0:
        if pick[room]:
            pattern[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return float(best[cap]), pattern


def fractional_patterns(demand: np.ndarray, cap: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Optimal fractional use of patterns that cover ``demand``: columns of the basis and how often each is used.

    Revised simplex on the covering program, with the basis inverse updated
    in place; the entering column comes from ``best_pattern``.  Rounding
    errors of the updates cost at most a little padding: the plan that is
    made of these patterns counts in whole numbers.
    """
    live = np.flatnonzero(demand)
    m = len(live)
    need = demand[live].astype(float)
    basis = np.zeros((m, m))
    for i, c in enumerate(live):
        basis[i, i] = cap // (c + 1)
    inverse = np.diag(1.0 / np.diag(basis))
    use = need / np.diag(basis)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        value = np.zeros(len(demand))
        value[live] = dual
        gain, pattern = best_pattern(value, cap)
        if gain > 1 + 5e-4:
            column = pattern[live].astype(float)
        elif dual.min() < -1e-9:
            column = np.zeros(m)
            column[dual.argmin()] = -1.0  # more than the demand of this class
        else:
            break
        move = (inverse * column).sum(axis=1)
        ratio = np.where(move > 1e-9, use / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
        use = use - ratio[out] * move
        use[out] = ratio[out]
        basis[:, out] = column
    full = np.zeros((m, len(demand)), dtype=np.int64)
    full[:, live] = np.rint(basis.T).astype(np.int64)
    return full, np.maximum(use, 0)


def cutting_plan(demand: np.ndarray, cap: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns and how many sequences use each; together they hold ``demand`` exactly."""
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    if not left.any():
        return plan
    patterns, use = fractional_patterns(left, cap)
    for i in np.argsort(-use):
        pattern = patterns[i]
        if (pattern < 0).any() or not pattern.any():
            continue
        on = pattern > 0
        times = int(min(np.floor(use[i] + 1e-6), (left[on] // pattern[on]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= times * pattern
    while left.any():  # what rounding left over: at most a few sequences for each class
        pattern, room = np.zeros_like(left), cap
        for c in range(len(left) - 1, -1, -1):
            n = int(min(left[c], room // (c + 1)))
            if n:
                pattern[c], room = n, room - n * (c + 1)
        on = pattern > 0
        times = int((left[on] // pattern[on]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", width: int = WIDTH, grain: int = GRAIN) -> DataFrame:
    """Rows ``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one per piece of every row of ``docs``.

    Repeated rows and null keys are packed like all others; an empty table
    gives no rows; a text of any length is cut into as many pieces as it
    needs.  Class counts (``width / grain`` numbers) are all the driver sees.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cap = width // grain
    pieces = token_pieces(docs, tokenizer, key, text, width).withColumn("_class", F.ceil(F.col("length") / grain).cast("int"))
    pieces = scratch.table(pieces)
    demand = np.zeros(cap, dtype=np.int64)
    for c, n in pieces.groupBy("_class").count().collect():
        demand[c - 1] = n
    rows, taken, sequence = [], np.zeros(cap, dtype=np.int64), 0
    for pattern, times in cutting_plan(demand, cap):
        slot = 0
        for c in np.flatnonzero(pattern):
            each = int(pattern[c])
            rows.append((int(c) + 1, int(taken[c]), int(taken[c]) + each * times, each, sequence, slot))
            taken[c] += each * times
            slot += each
        sequence += times
    out = [key, "start", "length", "ids_crc32", "doc_tokens"]
    if not rows:
        return pieces.select(*out, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    plan = spark.createDataFrame(pd.DataFrame(rows), "_class int, _low long, _high long, _each long, _first long, _slot long")
    placed = ranked(pieces, ["_class"], ["length", key, "start"], rank="_rank").join(F.broadcast(plan), "_class").where("_rank >= _low and _rank < _high")
    placed = placed.select(*out, F.expr("_first + (_rank - _low) div _each").alias("sequence_id"), F.expr("_slot + (_rank - _low) % _each").alias("_at"))
    before = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return scratch.finish(placed.select(*out, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset")))
