"""Target-distribution importance resampling of documents.

Hashed word features are counted over the corpus and over the target texts;
the logarithm of the two rates' quotient is a bucket's gain, and a document's
weight is the mean gain of its features, read from one array.  A random number
that depends on the key alone turns weights into scores whose highest ones are
a draw without replacement.

The draw is exact and passes through no single task.  Scores are whole
numbers, so their histogram gives the lowest score that can be drawn and cuts
the scores into ranges with known first ranks.  Every partition's eligible
rows become a sorted run in the shared store, cut into blocks at the ranges;
a task merges the blocks of a range from all runs with a tournament tree,
opens a block only when the next row might be in it, and stops the tree after
the last draw.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import Scratch, bounded_batches, lean, small_batches

#: Everything but digits, letters and what is not ASCII ends a word; capitals A-Z become small.
SPELL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Bytes of a text that are cut into words at a time.
SEGMENT = 1 << 20
#: Words whose bucket a worker remembers.
MOST_WORDS = 200_000
#: Rows of a block of a run; ranges of scores, and rows of one at least.
BLOCK, MOST_RANGES, RANGE_ROWS = 1024, 4096, 4096


@dataclass(frozen=True)
class Features:
    """Runs of one to ``longest`` words, hashed into ``buckets``."""

    buckets: int = 10_000
    longest: int = 1


class _Known(dict):
    """From a feature to its bucket; emptied when full."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = zlib.crc32(feature) % self.buckets
        if len(feature) <= 100:
            self[feature] = found
        return found


def word_runs(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    data = (text or "").encode().translate(SPELL)
    low = 0
    while low < len(data):
        high = data.find(b" ", low + SEGMENT)
        high = len(data) if high < 0 else high
        yield data[low:high].split()
        low = high


def feature_runs(text: str | None, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """``(features, words)`` of a text, some at a time; runs of words cross from one part to the next."""
    tail: list[bytes] = []
    for words in word_runs(text):
        out = list(words)
        joined = tail + words
        for n in range(2, longest + 1):
            first = max(0, len(tail) - n + 1)
            out += [b" ".join(joined[i : i + n]) for i in range(first, len(joined) - n + 1)]
        tail = joined[-(longest - 1) :] if longest > 1 else []
        yield out, len(words)


def bucket_counts(docs: DataFrame, features: Features, text: str = "text") -> DataFrame:
    """``(bucket, n)``: how often features of each bucket occur in all texts; a task sends one row a bucket at most."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Known(features.buckets), np.zeros(features.buckets, dtype=np.int64)
        for batch in small_batches(batches):
            for t in batch.column(0).to_pylist():
                for found, _ in feature_runs(t, features.longest):
                    if found:
                        total += np.bincount(np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)), minlength=features.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, features: Features) -> np.ndarray:
    """A thousand times the logarithm of each bucket's rate in the target over that in the corpus, add-one smoothed, floored."""
    both = corpus.withColumn("target", F.lit(False)).union(target.withColumn("target", F.lit(True)))
    s, t = [0] * features.buckets, [0] * features.buckets
    for bucket, n, of_target in both.collect():  # two rows a bucket at most
        (t if of_target else s)[bucket] = n
    over_s, over_t = float(sum(s) + features.buckets), float(sum(t) + features.buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * over_s / (float(a + 1) * over_t))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def noise(seed: int, key: object) -> int:
    """A Gumbel number times 1000, floored, from the first 32 bits of a hash of seed and key (a null key is the text ``null``)."""
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, features: Features, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(id, n_features, n_words, weight, score)``: the floored mean gain, and the score of the draw."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def one(known: _Known, text: str | None) -> tuple[int, int, int]:
        total = count = words = 0
        for found, n in feature_runs(text, features.longest):
            words += n
            if found:
                total += int(gain[np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found))].sum())
                count += len(found)
        return count, words, total // count if count else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(features.buckets)
        for batch in small_batches(batches):
            rows = [one(known, t) for t in batch.column(1).to_pylist()]
            score = [w + noise(seed, k) for (_, _, w), k in zip(rows, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array(score, pa.int64())], ["id", "n_features", "n_words", "weight", "score"])

    return docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`")).mapInArrow(lean(run), f"id {kind}, n_features long, n_words long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int = 10, least_words: int = 20, seed: int = 2024, features: Features = Features(), key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:  # noqa: B008
    """One row per document: ``(key, n_features, weight, score, rank)``; ``rank`` is null for what is not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a
    hundred are drawn (floored) by highest score, ties to the smaller key, null
    keys last, rows that repeat a key one after another.  Null texts have no
    words; a text without features has weight 0; an empty table gives no rows;
    an empty target weighs like one that holds nothing; other columns are
    ignored.
    """
    gain = gains(bucket_counts(docs, features, text), bucket_counts(target, features, target_text), features)
    rows = scratch.table(scored(docs, gain, features, seed, key, text))
    out = lambda df: df.select(F.col("id").alias(key), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    histogram = rows.where(F.col("n_words") >= least_words).groupBy("score").count().collect()  # scores are whole numbers within bounds of the logarithm
    histogram = sorted(((s, n) for s, n in histogram), reverse=True)
    draw = percent * sum(n for _, n in histogram) // 100
    if not draw:
        return out(rows)
    cut = next(s for (s, _), upto in zip(histogram, accumulate(n for _, n in histogram), strict=True) if upto >= draw)
    lows, firsts = ranges([(s, n) for s, n in histogram if s >= cut], max(RANGE_ROWS, -(-draw // MOST_RANGES)))
    eligible = (F.col("n_words") >= least_words) & (F.col("score") >= cut)
    runs = scratch.table(sorted_runs(rows.where(eligible).drop("n_words"), lows))
    drawn = merged(runs, len(lows), firsts, draw).withColumnRenamed("id", key)
    return out(rows.where(~eligible)).unionByName(drawn)


def ranges(histogram: list[tuple[int, int]], most: int) -> tuple[list[int], list[int]]:
    """Ranges of scores, highest first, of about ``most`` rows or one score: the lowest score of each, and how many rows lie above it."""
    lows, firsts, held, above = [], [], 0, 0
    for i, (score, n) in enumerate(histogram):
        held += n
        if held >= most or i == len(histogram) - 1:
            lows.append(score)
            firsts.append(above)
            above, held = above + held, 0
    return lows, firsts


def sorted_runs(rows: DataFrame, lows: list[int]) -> DataFrame:
    """Each partition's rows as one sorted run, in blocks that end with a range: ``(range, run, n, score, first, rows...)``."""
    kind = rows.schema["id"].dataType.simpleString()
    down = [-x for x in lows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        n = 0
        for batch in batches:
            of = np.searchsorted(down, -batch.column("score").to_numpy())
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
            for low, high in zip(edges, edges[1:], strict=False):
                for at in range(low, high, BLOCK):
                    rows = batch.slice(at, min(BLOCK, high - at))
                    head = [pa.array([x], pa.int64()) for x in (int(of[low]), here, n, rows.column("score")[0].as_py())]
                    lists = [pa.array([rows.column(c).to_pylist()], pa.list_(rows.column(c).type)) for c in ("id", "n_features", "weight", "score")]
                    yield pa.RecordBatch.from_arrays([*head, rows.column("id")[:1], *lists], ["range", "run", "n", "top", "first", "ids", "features", "weights", "scores"])
                    n += 1

    schema = f"range long, run long, n long, top long, first {kind}, ids array<{kind}>, features array<long>, weights array<long>, scores array<long>"
    return rows.sortWithinPartitions(F.col("score").desc(), F.col("id").asc_nulls_last()).mapInArrow(lean(run), schema)


class Tournament:
    """The smallest of the first keys of several sorted sequences; a replaced one plays only its own path again."""

    def __init__(self) -> None:
        self.size = 1
        self.keys: list[tuple | None] = [None]
        self.tree = [0, 0]  # tree[1] is the winner, leaves stand from ``size`` on

    def _better(self, a: int, b: int) -> int:
        x, y = self.keys[a], self.keys[b]
        return a if y is None or (x is not None and x <= y) else b

    def put(self, leaf: int, key: tuple | None) -> None:
        while leaf >= self.size:
            self.size *= 2
            self.keys += [None] * (self.size - len(self.keys))
            self.tree = [0] * self.size + list(range(self.size))
            for i in range(self.size - 1, 0, -1):
                self.tree[i] = self._better(self.tree[2 * i], self.tree[2 * i + 1])
        self.keys[leaf] = key
        i = (leaf + self.size) // 2
        while i:
            self.tree[i] = self._better(self.tree[2 * i], self.tree[2 * i + 1])
            i //= 2

    def winner(self) -> tuple[int, tuple] | None:
        key = self.keys[self.tree[1]]
        return None if key is None else (self.tree[1], key)


def merge(blocks: Iterable[tuple], draws: int) -> Iterator[tuple]:
    """The first ``draws`` rows of all runs in order, then whatever is left, as ``(place or None, block, i)``.

    ``blocks`` are ``(run, keys, ...)``, sorted by their first key and those of
    a run in its order.  A block is opened when its first key may be next, so
    what is open is a block a run and those that begin with equal keys.
    """
    tree, waiting, leaves, free = Tournament(), {}, {}, []
    coming = iter(blocks)
    ahead = next(coming, None)
    place = 0
    while place < draws:
        best = tree.winner()
        if ahead is not None and (best is None or ahead[1][0] <= best[1][0]):
            run = ahead[0]
            if run in leaves:
                waiting[leaves[run]].append([ahead, 0])
            else:
                leaf = leaves[run] = free.pop() if free else len(leaves)
                waiting[leaf] = deque([[ahead, 0]])
                tree.put(leaf, (ahead[1][0], run))
            ahead = next(coming, None)
            continue
        if best is None:
            return
        leaf, (_, run) = best
        block, i = waiting[leaf][0]
        yield place, block, i
        place += 1
        waiting[leaf][0][1] += 1
        if i + 1 == len(block[1]):
            waiting[leaf].popleft()
        if waiting[leaf]:
            block, i = waiting[leaf][0]
            tree.put(leaf, (block[1][i], run))
        else:
            tree.put(leaf, None)
            free.append(leaf)
            del waiting[leaf], leaves[run]
    for queue in waiting.values():
        for block, i in queue:
            yield from ((None, block, j) for j in range(i, len(block[1])))
    while ahead is not None:
        yield from ((None, ahead, j) for j in range(len(ahead[1])))
        ahead = next(coming, None)


def merged(runs: DataFrame, n_ranges: int, firsts: list[int], draw: int) -> DataFrame:
    """All rows of the runs with their rank; those after the last draw have none.  Each range is merged by one task."""
    kind = runs.schema["first"].dataType.simpleString()
    # blocks of a range lie together, in the order in which the merge may need them
    dealt = runs.repartition(n_ranges, "range").sortWithinPartitions("range", F.col("top").desc(), F.col("first").asc_nulls_last(), "run", "n")
    columns = ["range", "run", "ids", "features", "weights", "scores"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def opened() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [batch.column("ids").type.value_type, *[pa.int64()] * 4]
                for i in range(batch.num_rows):
                    of, run, ids, features, weights, scores = (batch.column(c)[i].as_py() for c in columns)
                    yield of, run, [(-s, k is None, k) for s, k in zip(scores, ids, strict=True)], ids, features, weights, scores

        held: list[tuple] = []
        for of, blocks in groupby(opened(), key=lambda b: b[0]):
            for place, (_, _, ids, features, weights, scores), i in merge((b[1:] for b in blocks), max(0, draw - firsts[of])):
                held.append((ids[i], features[i], weights[i], scores[i], None if place is None else firsts[of] + place + 1))
                if len(held) == 2000:
                    yield _batch(held, types)
                    held = []
        if held:
            yield _batch(held, types)

    return dealt.select(*columns).mapInArrow(lean(run), f"id {kind}, n_features long, weight long, score long, rank long")


def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "n_features", "weight", "score", "rank"])
