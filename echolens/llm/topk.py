"""Exact top-k inner products by columnar branch and bound.

Vectors are stored as whole numbers ``floor(1024 * x)`` in blocks, one row
of the matrix per dimension.  For a query the scores of a block grow one
block of dimensions at a time; what the remaining dimensions can still add
is bounded by the product of the two remaining norms.  Candidates whose upper
bound is below the tenth best lower bound leave, and the survivors are
compacted before the next block of dimensions.

Queries go to the candidates, which never move: in rounds of a bounded number
of bytes, one scan of the stored candidates for each.  A round's queries start
from the tenth best score among a small sample of candidates, a bound that
holds for all of them, and each worker raises it as it goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolens.llm.common import Scratch, bounded_batches, lean

SCALE = 1024
#: Dimensions that are accumulated before candidates are dropped.
STRIDE = 16
#: Candidates in a block and bytes after which it is closed even if short, query bytes of a round, candidates of the sample.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
ROUND_BYTES = 8 << 20
SAMPLE = 1024


def whole_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, v binary)``: little-endian 64-bit whole components of the vectors that are all finite; the rest is left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            ok, out = [], []
            for i, vector in enumerate(col.to_pylist()):
                if vector is None or None in vector:
                    continue
                x = np.array(vector, dtype=np.float64)
                if np.isfinite(x).all():
                    ok.append(i)
                    out.append(np.floor(SCALE * x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok, pa.int32())), pa.array(out, pa.binary())], [key, "v"])

    return df.select(key, column).where(F.col(key).isNotNull()).mapInArrow(run, f"`{key}` {kind}, v binary")


def matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    """``dims x n`` matrix in vertical layout; shorter vectors are filled up with zeros."""
    out = np.zeros((dims, len(vectors)))
    for i, v in enumerate(vectors):
        x = np.frombuffer(v, dtype="<i8")
        out[: len(x), i] = x
    return out


def rest_norms(m: np.ndarray) -> np.ndarray:
    """Norm of what is left of each column from every stride on (the last row is zero)."""
    squares = (m * m)[::-1].cumsum(axis=0)[::-1]
    cuts = [np.sqrt(squares[low]) for low in range(0, len(m), STRIDE)]
    return np.vstack([*cuts, np.zeros(m.shape[1])])


def best_of_block(query: np.ndarray, own: int, block: np.ndarray, ids: np.ndarray, rest: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the block's best ``k`` for one query that score ``floor`` or more, without the query's own id."""
    left = np.array([np.sqrt((query[low:] ** 2).sum()) for low in range(0, len(query), STRIDE)] + [0.0])
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive))
    for step, low in enumerate(range(0, len(query), STRIDE)):
        part = block[low : low + STRIDE]
        part = part if len(alive) == block.shape[1] else part[:, alive]
        score = score + np.einsum("d,dn->n", query[low : low + STRIDE], part)
        slack = left[step + 1] * rest[step + 1, alive] * (1 + 1e-9)
        if len(alive) > k:
            floor = max(floor, np.partition(score - slack, -k)[-k])
        keep = score + slack >= floor
        alive, score = alive[keep], score[keep]
    order = np.lexsort((ids[alive], -score))[:k]
    return alive[order], score[order]


def top_k(df: DataFrame, is_query: str, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows ``(query_id, rank int, vec_id, score long)``: each query's ``k`` highest whole inner products, ties to smaller ids.

    ``is_query`` is the SQL predicate that marks queries.  Vectors that are
    null or hold null or non-finite components, and null ids, take no part.
    Rows that repeat an id are candidates each, none for the query of that id;
    a repeated query counts once, with its first vector.  Scores are exact up
    to 2**53.  An empty table gives no rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    stored = scratch.table(whole_vectors(df, key, column))
    kind = stored.schema[key].dataType.simpleString()
    queries = scratch.table(stored.where(is_query).groupBy(key).agg(F.min("v").alias("v")))
    size = queries.agg(F.coalesce(F.sum(F.length("v") + 16), F.lit(0))).first()[0]
    rounds = max(1, -(-int(size) // ROUND_BYTES))
    sample = stored.limit(SAMPLE).where(F.length("v") <= BLOCK_BYTES // SAMPLE).toArrow()
    found = []
    for n in range(rounds):
        asked = queries.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == n).toArrow()
        ids, vectors = asked.column(0).to_pylist(), asked.column(1).to_pylist()
        floors = first_floors(ids, vectors, sample.column(0).to_pylist(), sample.column(1).to_pylist(), k)
        part = best_scores(stored.mapInArrow(lean(searcher(ids, vectors, floors, k)), "query_id long, vec_id long, score long"), k)
        found.append(part if rounds == 1 else scratch.table(part))
    best = reduce(DataFrame.union, found)
    return scratch.finish(best.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score"))


def best_scores(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_floors(ids: list[int], vectors: list[bytes], sample_ids: list[int], sample: list[bytes], k: int) -> list[float]:
    """For each query the ``k``-th best score among the sample, or minus infinity if it is too small."""
    if not ids or not sample_ids:
        return [-np.inf] * len(ids)
    dims = max(len(v) // 8 for v in [*vectors, *sample])
    block, names = matrix(sample, dims), np.array(sample_ids, dtype=np.int64)
    rest = rest_norms(block)
    out = []
    for own, v in zip(ids, vectors, strict=True):
        _, score = best_of_block(matrix([v], dims)[:, 0].copy(), own, block, names, rest, k, -np.inf)
        out.append(float(score[-1]) if len(score) == k else -np.inf)
    return out


def searcher(ids: list[int], vectors: list[bytes], floors: list[float], k: int) -> Callable:
    """A function over batches of candidates ``(id, v)`` that gives what may be among each query's best."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {own: np.array([floor]) for own, floor in zip(ids, floors, strict=True)}

        def block_of(names: list[int], vs: list[bytes]) -> pa.RecordBatch:
            dims = max(len(v) // 8 for v in [*vs, *vectors])
            block, at_ = matrix(vs, dims), np.array(names, dtype=np.int64)
            rest = rest_norms(block)
            out = ([], [], [])
            for own, v in zip(ids, vectors, strict=True):
                at, score = best_of_block(matrix([v], dims)[:, 0], own, block, at_, rest, k, best[own][0])
                if len(at):
                    seen = np.sort(np.concatenate([best[own][1:], score]))[-k:]
                    best[own] = np.concatenate([[max(best[own][0], seen[0] if len(seen) == k else -np.inf)], seen])
                out[0].extend([own] * len(at))
                out[1].extend(at_[at].tolist())
                out[2].extend(score.astype(np.int64).tolist())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

        names, vs, n = [], [], 0
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(i)
                vs.append(v)
                n += len(v)
                if ids and (len(names) == BLOCK or n >= BLOCK_BYTES):
                    yield block_of(names, vs)
                    names, vs, n = [], [], 0
        if names and ids:
            yield block_of(names, vs)

    return search
