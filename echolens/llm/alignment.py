"""Alignment of two tokenizers' tokens over the same bytes.

Tokens of both sides are laid over the text's bytes by where they end.  The
union of both arrays of ends cuts the bytes into elementary intervals, each of
which lies in just one token of either side: each is one overlapping pair.
Ends that both sides share close a group.

Neither tokenizer joins anything across a space between two characters that
are no white space, so long texts are encoded in segments that end there.

How many documents hold a pair, and which partners a token has most often, are
counts over the whole corpus.  The most frequent pairs, a table of a fixed
size, go to every task; what links of other pairs there are is shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.chunktable import MARK, byte_letters
from echolens.llm.common import Scratch, bounded_batches, lean, small_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space in anybody's view, and what some take for it.
BLANK = r"\s\x1c-\x1f\x85᠎​﻿"
BORDER = re.compile(f"(?<=[^{BLANK}]) (?=[^{BLANK}])")
#: Characters of a segment, pairs that go to every task, pairs that a task counts at a time.
SEGMENT, MOST_PAIRS, COUNTED = 1 << 18, 1 << 20, 1 << 21
#: Where every version of Unicode agrees on what is a letter, and a stretch that is not left to the faster of two encoders.
SETTLED = re.compile("[\x00-\u024f\u2010-\u2027\u20ac]*").fullmatch
STRETCH, BLANKS, SMALL = 2000, " " * 500, 2000
#: The byte-level tokenizer's own pattern of what is encoded by itself.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_TOKENS = (0, 0, 0, "", np.zeros(0, dtype=np.int64))

_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """The worker's aligner for a byte-level tokenizers file and a sentencepiece model; kept between tasks."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ends of all elementary intervals, the token of either side that each lies in, and whether both sides end there."""
    ends = np.union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, own_a, own_b, (ends_a[own_a] == ends) & (ends_b[own_b] == ends)


class Aligner:
    """Encodes texts on both sides and lays the tokens over one another."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross white-space markers")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        special = self.a.get_added_tokens_decoder()
        spelled = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [s.encode() if i in special else bytes(byte_of[c] for c in s) for i, s in enumerate(spelled)]
        self.long_a, self.long_b = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.bytes_a, self.bytes_b))
        ranks = {x: i for i, x in enumerate(self.bytes_a) if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: Every id of either side as it is written inside a group and at the end of its side.
        self.said = np.array([f"{i}{end}" for n, ends in ((len(spelled), ",|"), (self.n_b, ",;")) for end in ends for i in range(n)], dtype=object)

    def ids_a(self, text: str) -> list[int]:
        """Ids of the byte-level side.  Both encoders make the same of it; the faster one gets what is beyond doubt."""
        if SETTLED(text) and BLANKS not in text and max(map(len, text.split(" "))) <= STRETCH:
            return self.fast.encode_ordinary(text)
        if len(text) <= SMALL:
            return self.a.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for i, part in enumerate(segments(text, SMALL // 2)):
            part = f" {part}" if i else part
            out += self.ids_a(part) if len(part) <= SMALL else self.a.encode(part, add_special_tokens=False).ids
        return out

    def align(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """``(n_a, n_b, n_groups, groups, links)`` of a whole text: no tokens if it is null or empty, or if either side's bytes are not the space and the text.

        Links are ``id of A * number of B's ids + id of B`` in the order of the text.
        """
        if not text or MARK in text:  # the marker comes back as a space
            return NO_TOKENS
        parts = []
        for segment in segments(text, SEGMENT):
            want = b" " + segment.encode()
            a, b = self.ids_a(f" {segment}"), self.b.encode(segment, num_threads=1)
            if not want == b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b]):
                return NO_TOKENS
            parts.append(self._laid(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)))
        if len(parts) == 1:
            return parts[0]
        n_a, n_b, n_groups, groups, links = zip(*parts, strict=True)
        return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), np.concatenate(links)

    def _laid(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, str, np.ndarray]:
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        ends, own_a, own_b, shared = elementary(ends_a, ends_b)
        closes = ends[shared]
        # every id in the order of the groups, first those of A, the last of either side with the sign that ends it
        of_a, of_b = np.searchsorted(closes, ends_a), np.searchsorted(closes, ends_b)
        names = np.concatenate([a + len(self.long_a) * (closes[of_a] == ends_a), b + 2 * len(self.long_a) + self.n_b * (closes[of_b] == ends_b)])
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        return len(a), len(b), len(closes), "".join(self.said[names[order]].tolist())[:-1], a[own_a] * self.n_b + b[own_b]


def segments(text: str, length: int) -> Iterator[str]:
    """A text in parts of about ``length`` characters, without the space in front of each but the first."""
    low = 0
    while len(text) - low > length:
        border = BORDER.search(text, low + length)
        if border is None:
            break
        yield text[low : border.start()]
        low = border.end()
    yield text[low:] if low else text


def group_products(groups: str) -> Iterator[tuple[int, int]]:
    """All pairs of ids within each group of an alignment, where every token of a group stands for all of the other side's."""
    for group in filter(None, groups.split(";")):
        a, b = group.split("|")
        yield from ((int(x), int(y)) for x in a.split(",") for y in b.split(","))


def aligned(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(row, id, n_a, n_b, n_groups, groups_sha256, links array<long>)``.

    A text that is null or empty, or whose tokens' bytes differ from a space
    and the text, has no tokens: zeros, and an empty string for the digest.
    """
    return _run(docs, a, b, key, text, digest=True)


def alignments(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same with the groups themselves, ``a1,a2|b1;a3|b2,b3``, in the place of their digest."""
    return _run(docs, a, b, key, text, digest=False)


def _run(docs: DataFrame, a: str, b: str, key: str, text: str, digest: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    said = "groups_sha256" if digest else "groups"

    def told(groups: str) -> str:
        return hashlib.sha256(groups.encode()).hexdigest() if digest and groups else groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = aligner(a, b)
        for batch in small_batches(batches):
            n_a, n_b, n_groups, groups, links = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                row = table.align(t)
                for column, value in zip((n_a, n_b, n_groups, links), (*row[:3], row[4]), strict=True):
                    column.append(value)
                groups.append(told(row[3]))
            offsets = np.cumsum([0, *map(len, links)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(links)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)], pa.array(groups, pa.string()), lists], ["row", "id", "n_a", "n_b", "n_groups", said, "links"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`"))
    return rows.mapInArrow(lean(run), f"row long, id {kind}, n_a long, n_b long, n_groups long, {said} string, links array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, docs)``: how many rows hold each link; a task sends a pair once for each ``COUNTED`` that it has counted."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return pairs, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(pairs)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            links = batch.column(0)
            for low in range(0, len(links), 200):
                some = links[low : low + 200]
                values, at = some.flatten().to_numpy(zero_copy_only=False), some.value_lengths().to_numpy(zero_copy_only=False)
                if not len(values):
                    continue
                row = np.repeat(np.arange(len(at)), at)
                order = np.lexsort((row, values))
                values, row = values[order], row[order]
                first = np.ones(len(values), dtype=bool)
                first[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
                total.append(np.unique(values[first], return_counts=True))
                if sum(len(p) for p, _ in total) > COUNTED:
                    total = [merged(total)]
                    if len(total[0][0]) > COUNTED // 2:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, total.pop())), ["pair", "docs"])
        if total:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged(total))), ["pair", "docs"])

    return rows.select("links").mapInArrow(lean(run), "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def frequent(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``pairs`` in two: at most ``most`` of those that most documents hold, and the rest.

    The border is one of 8 steps a doubling of the number of documents, from a histogram of these steps.
    """
    step = F.floor(8 * F.log2("docs"))
    upto, lowest = 0, 64 * 8
    for level, n in sorted(pairs.groupBy(step.alias("step")).count().collect(), reverse=True):  # 512 rows at most
        if upto + n > most:
            break
        upto, lowest = upto + n, level
    return pairs.where(step >= lowest), pairs.where(step < lowest)


def link_report(docs: DataFrame, scratch: Scratch, a: str, b: str, key: str = "doc_id", text: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row per document: ``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    Every link is an overlapping pair of token occurrences.  A pair counts as
    often as there are documents that hold it; ``count_sum`` adds these counts
    over a document's links, and ``n_best`` counts the links whose pair has the
    highest count of all pairs of its token of A, ties included.  Rows that
    repeat a key are documents of their own; null and empty texts and texts
    whose bytes a tokenizer changes have zeros; an empty table gives no rows;
    other columns are ignored.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    rows = scratch.table(aligned(docs, a, b, key, text), compression="zstd")
    counted = scratch.table(pair_counts(rows))
    of_a = F.expr(f"pair div {n_b}")
    highest = F.broadcast(counted.groupBy(of_a.alias("a")).agg(F.max("docs").alias("most")))  # a row for each id of A at most
    pairs = scratch.table(counted.withColumn("a", of_a).join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    hot, cold = frequent(pairs, most_pairs)
    held = hot.orderBy("pair").toArrow()
    table = docs.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("pair", "docs", "best")))

    def looked_up(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each link stands among the frequent pairs, and whether it does."""
        known = table.value[0]
        at = np.minimum(np.searchsorted(known, links), max(0, len(known) - 1))
        return at, (known[at] == links) if len(known) else np.zeros(len(links), dtype=bool)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                row, links = (c[low : low + 200] for c in batch.columns)
                values, n = links.flatten().to_numpy(zero_copy_only=False), links.value_lengths().to_numpy(zero_copy_only=False)
                distinct, inverse = np.unique(values, return_inverse=True)
                at, there = looked_up(distinct)
                docs_of = np.where(there, table.value[1][at], 0) if len(table.value[1]) else np.zeros(len(distinct), dtype=np.int64)
                best_of = np.where(there, table.value[2][at], False) if len(table.value[1]) else there
                edges = np.concatenate([[0], np.cumsum(n)])
                total = [np.concatenate([[0], np.cumsum(x[inverse])])[edges] for x in (docs_of.astype(np.int64), best_of.astype(np.int64))]
                owner = np.repeat(np.arange(len(n)), n)
                lost = ~there[inverse]
                rest, times = np.unique(np.stack([owner[lost], inverse[lost]]), axis=1, return_counts=True) if lost.any() else (np.zeros((2, 0), dtype=np.int64), np.zeros(0, dtype=np.int64))
                cut = np.searchsorted(rest[0], np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (distinct[rest[1]], times)]
                yield pa.RecordBatch.from_arrays([row, pa.array(n.astype(np.int64)), *[pa.array(np.diff(x)) for x in total], *lists], ["row", "n_links", "hot_sum", "hot_best", "rare", "times"])

    sums = scratch.table(rows.select("row", "links").mapInArrow(lean(summed), "row long, n_links long, hot_sum long, hot_best long, rare array<long>, times array<long>"))
    asked = sums.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    rare = asked.join(cold, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("docs")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"))
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).cast("long")
    told = rows.drop("links").join(sums.drop("rare", "times"), "row").join(rare, "row", "left")
    return told.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", plus("hot_best", "rare_best").alias("n_best"), plus("hot_sum", "rare_sum").alias("count_sum"), "groups_sha256")
