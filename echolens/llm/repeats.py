"""Repeated windows of tokens by a depth-limited radix sort of suffixes.

A window of ``length`` tokens (bytes, or words) that starts at two places must
be found wherever they lie.  Suffixes are ordered only through the window's
last token, by their bytes, in passes of eight from the most significant on;
a suffix that is alone in its group after a pass leaves, and the groups that
are left at the end are exactly the repeated windows.

Not every suffix takes part in the sort:

* Each window names its *anchor*, the stretch of a few tokens in it that
  hashes lowest.  Equal windows name the same one and neighbours share it, so
  one anchor stands for a run of windows, and only anchors travel at first.
  A window whose anchor occurs nowhere else is no repeat.
* Runs that are equal as a whole, by their two hashes of 64 bits, are repeats
  as a whole; one of them goes on for all.
* What goes on are runs that share an anchor but differ.  Their suffixes are
  sorted, each anchor's in one task.

Each worker first combines equal runs of its own rows, so a text with very
many copies sends a few rows only, and an anchor with many runs in a worker's
rows is dealt out by its runs.  Where one anchor has more than ``MOST_RUNS``
runs, no task sorts it: each of its windows is counted under its 128-bit
hash, in blocks of hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.bytetext import SLICE, Lane, mix, slices, window_argmin, words
from echolens.llm.common import Scratch, bounded_batches, lean, lean_group, light, private, with_matches


@dataclass(frozen=True)
class Unit:
    """What a window is counted in, the tokens of a window and of an anchor."""

    token: str
    length: int
    gram: int


BYTES = Unit("byte", 400, 128)
#: Passages: words are told apart by their bytes, white space between them does not count.
WORDS = Unit("word", 50, 16)

#: Anchors a worker gathers before it combines them; anchors, suffix bytes and hashed windows of a block.
GATHER = 200_000
BLOCK_ANCHORS = 150_000
BLOCK_BYTES = 4 << 20
BLOCK_WINDOWS = 100_000
#: Bytes of runs whose suffixes are sorted at once.
SORTED_BYTES = 1 << 20
#: Runs of one anchor that one task sorts at most.
MOST_RUNS = 4096
#: Runs of one anchor that a worker sends to the anchor's own block at most; more are dealt out by the run.
OWN_RUNS = 16
#: Words longer than this are compared by their SHA-256.
LONG_WORD = 64

ANCHOR = np.dtype([("gram", "<u8"), ("run", "<u8"), ("row", "<i8"), ("pos", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("own", "<i4"), ("hot", "<i4")])
SPAN = np.dtype([("row", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
META = np.dtype([("gram", "<i8"), ("row", "<i8"), ("pos", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("size", "<i4")])
WINDOW = np.dtype([("one", "<u8"), ("two", "<u8"), ("row", "<i8"), ("start", "<i4"), ("own", "<i4")])
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_lanes: list[Lane] = []


def lanes() -> list[Lane]:
    """Two independent hashes."""
    if not _lanes:
        _lanes.extend([Lane(21), Lane(22)])
    return _lanes


def row_key(key: Column, text: Column) -> Column:
    """Stands for a row: its id and text (rows equal in both have equal results)."""
    return F.xxhash64(key, F.coalesce(text, F.lit("")))


# From texts to anchors


def stretches(col: pa.Array, unit: Unit) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, int]]:
    """``(first text, prefix values of both hashes, token number at which each text starts, offset)``.

    Short texts come many at a time, a long one in stretches that overlap, so
    that memory is bounded whatever the length; ``offset`` is the number of
    the stretch's first token in its text.
    """
    for low, data, at in slices(col):
        start = end = None
        first = at
        if unit.token == "word":
            start, end, first = words(data, at)
        n = int(first[-1])
        step = n if len(at) > 2 or n <= SLICE else SLICE
        for a in range(0, max(1, n - unit.length + 1), max(1, step)):
            z = n if step == n else min(n, a + step + unit.length - 1)
            if start is None:
                values = [lane.value[data[a:z]] for lane in lanes()]
            elif z > a:
                cut = slice(int(start[a]), int(end[z - 1]))
                values = [lane.span(lane.prefix(data[cut]), start[a:z] - cut.start, end[a:z] - cut.start) for lane in lanes()]
            else:
                values = [np.zeros(0, dtype=np.uint64)] * 2
            yield low, [lane.sums(v) for lane, v in zip(lanes(), values, strict=True)], first if step == n else np.array([0, z - a]), a
            if step == n:
                break


def anchors_of(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For gram hashes of one text: anchor positions, and the first and last window start that each stands for."""
    at = window_argmin(h, length - gram + 1)
    if not len(at):
        return at, at, at
    cut = np.flatnonzero(np.diff(at)) + 1
    lo = np.concatenate([[0], cut])
    return at[lo], lo, np.concatenate([cut, [len(at)]]) - 1


def text_anchors(rows: np.ndarray, col: pa.Array, unit: Unit) -> Iterator[np.ndarray]:
    for low, (one, two), at, offset in stretches(col, unit):
        h = lanes()[0].windows(one, unit.gram)
        for i in range(len(at) - 1):
            a, z = int(at[i]), int(at[i + 1])
            if z - a < unit.length:
                continue
            pos, lo, hi = anchors_of(h[a : z - unit.gram + 1], unit.length, unit.gram)
            out = np.zeros(len(pos), dtype=ANCHOR)
            out["gram"] = h[a + pos]
            out["run"] = mix(lanes()[1].span(two, a + lo, a + hi + unit.length) + (pos - lo).astype(np.uint64))
            out["row"] = rows[low + i]
            out["pos"], out["lo"], out["hi"], out["own"] = pos + offset, lo + offset, hi + offset, 1
            yield out


# Spans of window starts


def joined(spans: np.ndarray) -> np.ndarray:
    """Touching spans of a row made one."""
    if len(spans) < 2:
        return spans
    s = spans[np.lexsort((spans["lo"], spans["row"]))]
    turn = np.cumsum(np.concatenate([[0], s["row"][1:] != s["row"][:-1]])).astype(np.int64) << 33  # keeps rows apart
    low, high = s["lo"] + turn, s["hi"] + turn
    reach = np.concatenate([[True], low[1:] > np.maximum.accumulate(high)[:-1] + 1])
    first = np.flatnonzero(reach)
    out = s[first].copy()
    out["hi"] = np.maximum.reduceat(s["hi"], first)
    return out


def spans_of(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), dtype=SPAN)
    out["row"], out["lo"], out["hi"] = row, lo, hi
    return joined(out)


# Passes over anchors


def groups(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors ordered by anchor and run, and the group number of each by run and by anchor."""
    a = a[np.lexsort((a["run"], a["gram"]))]
    gram = np.concatenate([[True], a["gram"][1:] != a["gram"][:-1]])
    run = gram | np.concatenate([[True], a["run"][1:] != a["run"][:-1]])
    return a, np.cumsum(run) - 1, np.cumsum(gram) - 1


def dealt(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """``(block, kind, payload)`` rows: the records of each ``(kind, records, block of each)``."""
    ids, kinds, out = [], [], []
    for kind, records, block in parts:
        if not len(records):
            continue
        order = np.argsort(block, kind="stable")
        numbers, starts = np.unique(block[order], return_index=True)
        sorted_ = records[order]
        ids.extend(numbers.tolist())
        kinds.extend([kind] * len(numbers))
        out.extend(sorted_[lo:hi].tobytes() for lo, hi in zip(starts, [*starts[1:], len(sorted_)], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(out, pa.binary())], ["block", "kind", "payload"])


def combined(found: list[np.ndarray], blocks: int) -> pa.RecordBatch:
    """What one worker sends: spans that it can settle itself (kind 0), and one anchor of each run (kind 1).

    An anchor with many different runs here sends these to blocks by run, and
    a mark to its own block: whoever else has a run of it is not alone.
    """
    a, run, _ = groups(np.concatenate(found))
    each = np.bincount(run)
    settled = spans_of(*(a[each[run] > 1][c] for c in ("row", "lo", "hi")))
    sent = a[np.concatenate([[True], np.diff(run) > 0])]
    sent["own"] = each
    first = np.concatenate([[True], sent["gram"][1:] != sent["gram"][:-1]])
    gram = np.cumsum(first) - 1
    hot = np.bincount(gram)[gram] > OWN_RUNS
    sent["hot"] = hot
    marks = np.zeros(int((hot & first).sum()), dtype=ANCHOR)
    marks["gram"], marks["hot"] = sent["gram"][hot & first], 2
    n = np.uint64(blocks)
    block = (np.where(hot, mix(sent["gram"] ^ sent["run"]), sent["gram"]) % n).astype(np.int64)
    return dealt([(1, np.concatenate([sent, marks]), np.concatenate([block, (marks["gram"] % n).astype(np.int64)])), (0, settled, (settled["row"] % blocks).astype(np.int64))])


def records(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(p, dtype=dtype) for p, k in zip(table.column("payload").to_pylist(), table.column("kind").to_pylist(), strict=True) if k == kind]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


FOUND = "kind int, row long, lo int, hi int, pos int, gram long"


def first_passes(docs: DataFrame, unit: Unit, blocks: int) -> DataFrame:
    """``(kind, row, lo, hi, pos, gram)``: settled spans of window starts (kind 0) and runs to be sorted (kind 1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for part in text_anchors(batch.column(0).to_numpy(), batch.column(1), unit):
                found.append(part)
                n += len(part)
                if n >= GATHER:
                    yield combined(found, blocks)
                    found, n = [], 0
        if n:
            yield combined(found, blocks)

    def settle(table: pa.Table) -> pa.Table:
        spans = [records(table, 0, SPAN)]
        sent = records(table, 1, ANCHOR)
        more = np.zeros(0, dtype=ANCHOR)
        marked = np.unique(sent["gram"][sent["hot"] > 0])
        sent = sent[sent["hot"] < 2]
        if len(sent):
            a, run, gram = groups(sent)
            rows = np.bincount(run)
            alone = a[(rows[run] > 1) & (a["own"] == 1)]  # a worker that settled its own copies of a run sent one of them with their number
            spans.append(spans_of(alone["row"], alone["lo"], alone["hi"]))
            first = np.concatenate([[True], np.diff(run) > 0])
            runs = np.bincount(gram[first])
            more = a[first & ((runs[gram] > 1) | np.isin(a["gram"], marked))]
        done = joined(np.concatenate(spans))
        k, m = len(done), len(more)
        both = lambda c: pa.array(np.concatenate([done[c], more[c]]))
        kind = np.concatenate([np.zeros(k, dtype=np.int32), np.ones(m, dtype=np.int32)])
        gram = np.concatenate([np.zeros(k, dtype=np.int64), more["gram"].view(np.int64)])
        return pa.table([pa.array(kind), both("row"), both("lo"), both("hi"), pa.array(np.concatenate([np.zeros(k, dtype=np.int32), more["pos"]])), pa.array(gram)], names=["kind", "row", "lo", "hi", "pos", "gram"])

    sent = docs.mapInArrow(lean(scan), "block long, kind int, payload binary")
    return sent.groupBy("block").applyInArrow(lean_group(settle), FOUND)


# The sort of suffixes


def radix_groups(data: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Those of the suffixes ``data[begin:end)`` that equal another of their group, in order.

    ``group`` holds ascending numbers; suffixes of a group have one length.
    A pass sorts each group by its next eight bytes and splits it where they
    differ; groups of one leave.
    """
    digits = np.ndarray(len(data), dtype=">u8", buffer=np.concatenate([data, np.zeros(8, dtype=np.uint8)]).tobytes(), strides=(1,))
    alive, g = _shared(np.arange(len(begin)), np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=bool))
    done = []
    depth = 0
    while len(alive):
        left = end[alive] - begin[alive] - depth
        over = left <= 0
        if over.any():
            done.append(alive[over])
            alive, g, left = alive[~over], g[~over], left[~over]
            if not len(alive):
                break
        key = digits[begin[alive] + depth].astype(np.uint64)
        short = left < 8
        if short.any():
            away = ((8 - left[short]) * 8).astype(np.uint64)
            key[short] = key[short] >> away << away
        new = np.concatenate([[True], g[1:] != g[:-1]])
        head = key[np.flatnonzero(new)][np.cumsum(new) - 1]
        odd = key != head
        if odd.any():
            mixed = np.zeros(int(g[-1]) + 1, dtype=bool)
            mixed[g[odd]] = True
            at = np.flatnonzero(mixed[g])
            order = at[np.lexsort((key[at], g[at]))]
            alive[at], key[at] = alive[order], key[order]
            new[1:] |= key[1:] != key[:-1]
            alive, g = _shared(alive, new)
        depth += 8
    return np.concatenate(done) if done else np.zeros(0, dtype=np.int64)


def _shared(at: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of groups of two or more and their group numbers; ``new`` marks where groups begin."""
    g = np.cumsum(new) - 1
    keep = np.bincount(g, minlength=1)[g] > 1 if len(g) else np.zeros(0, dtype=bool)
    return at[keep], np.cumsum(new[keep]) - 1


def sorted_runs(meta: np.ndarray, texts: list[bytes], unit: Unit) -> np.ndarray:
    """Spans of the repeated windows among runs ``meta`` with these bytes."""
    out = [np.zeros(0, dtype=SPAN)]
    order = np.argsort(meta["gram"], kind="stable")
    meta = meta[order]
    turns = np.flatnonzero(np.concatenate([[True], meta["gram"][1:] != meta["gram"][:-1], [True]]))
    size = np.concatenate([[0], np.cumsum(meta["size"].astype(np.int64) + 1)])
    i = 0
    while i < len(turns) - 1:
        j = i + 1
        while j < len(turns) - 1 and size[turns[j + 1]] - size[turns[i]] <= SORTED_BYTES:
            j += 1
        low, high = int(turns[i]), int(turns[j])
        i = j
        m = meta[low:high]
        data = np.frombuffer(b" ".join(texts[k] for k in order[low:high]), dtype=np.uint8)
        width = m["hi"].astype(np.int64) - m["lo"] + 1
        which = np.repeat(np.arange(len(m)), width)
        step = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width)
        if unit.token == "byte":
            begin = (size[low:high] - size[low])[which] + step
            end = begin + unit.length
        else:
            space = np.flatnonzero(data == 32)
            count = width - 1 + unit.length
            at = (np.cumsum(count) - count)[which] + step
            begin = np.concatenate([[0], space + 1])[at]
            end = np.concatenate([space, [len(data)]])[at + unit.length - 1]
        start = m["lo"][which] + step
        lead = m["pos"][which] - start  # equal windows have their anchor at the same place
        by = np.lexsort((end - begin, lead, m["gram"][which]))
        change = np.zeros(len(by), dtype=bool)
        for x in (end - begin, lead, m["gram"][which]):
            y = x[by]
            change[1:] |= y[1:] != y[:-1]
        twice = by[radix_groups(data, begin[by], end[by], np.cumsum(change))]
        out.append(spans_of(m["row"][which][twice], start[twice], start[twice]))
    return joined(np.concatenate(out))


def run_bytes(data: bytes, asked: list[tuple[int, int]], unit: Unit) -> list[bytes]:
    """The bytes of runs of windows: stretches of a text, or words joined by single spaces."""
    if unit.token == "byte":
        return [data[lo : hi + unit.length] for lo, hi in asked]
    w = [x if len(x) <= LONG_WORD else hashlib.sha256(x).hexdigest().encode() for x in WORD.findall(data)]
    return [b" ".join(w[lo : hi + unit.length]) for lo, hi in asked]


def hashed_windows(meta: np.ndarray, texts: list[bytes], unit: Unit) -> np.ndarray:
    """One record for each window of the runs ``meta``, by the window's 128-bit hash."""
    out = []
    col = pa.array(texts, pa.binary()).view(pa.string())  # may cut characters in two
    whole = Unit(unit.token, 1, 1)
    for low, sums, at, _ in stretches(col, whole):
        for i in range(len(at) - 1):
            m = meta[low + i]
            step = np.arange(int(m["hi"]) - int(m["lo"]) + 1)
            begin = at[i] + step
            w = np.zeros(len(step), dtype=WINDOW)
            w["row"], w["start"], w["own"] = m["row"], m["lo"] + step, 1
            lead = (m["pos"] - w["start"]).astype(np.uint64)
            for name, lane, p in zip(("one", "two"), lanes(), sums, strict=True):
                w[name] = mix(lane.span(p, begin, begin + unit.length) + lead) ^ m["gram"].view(np.uint64)
            out.append(w)
    return np.concatenate(out) if out else np.zeros(0, dtype=WINDOW)


def by_hash(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows in order of their hashes, and the group number of each."""
    w = w[np.lexsort((w["two"], w["one"]))]
    return w, np.cumsum(np.concatenate([[False], (w["one"][1:] != w["one"][:-1]) | (w["two"][1:] != w["two"][:-1])]))


def last_passes(docs: DataFrame, runs: DataFrame, scratch: Scratch, unit: Unit, blocks: int) -> DataFrame:
    """``(row, lo, hi)``: the repeated windows among runs that share an anchor but differ."""
    many = scratch.table(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > MOST_RUNS))
    total = many.agg(F.coalesce(F.sum("runs"), F.lit(0))).first()[0]
    marked = runs.join(light(many, 32), "gram", "left").withColumn("hot", F.col("runs").isNotNull())
    asked = scratch.table(marked.groupBy("row").agg(F.collect_set(F.struct("pos", "lo", "hi", "gram", "hot")).alias("asked")))
    wide = max(1, int(total) * 100 // BLOCK_WINDOWS)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, list] = {}
            often: tuple[list, list] = ([], [])
            for row, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for x, part in zip(asked, run_bytes((text or "").encode(), [(x["lo"], x["hi"]) for x in asked], unit), strict=True):
                    meta = (x["gram"], row, x["pos"], x["lo"], x["hi"], len(part))
                    if x["hot"]:
                        often[0].append(meta)
                        often[1].append(part)
                    else:
                        out.setdefault(x["gram"] % blocks, []).append((meta, part))
            keys = list(out)
            metas = [np.array([m for m, _ in out[k]], dtype=META).tobytes() for k in keys]
            cols = [pa.array(keys, pa.int64()), pa.array([1] * len(keys), pa.int32()), pa.array(metas, pa.binary()), pa.array([b"".join(c for _, c in out[k]) for k in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "kind", "payload", "bytes"])
            for low in range(0, len(often[0]), 1000):
                meta = np.array(often[0][low : low + 1000], dtype=META)
                w, group = by_hash(hashed_windows(meta, often[1][low : low + 1000], unit))
                each = np.bincount(group)
                twice = each[group] > 1
                settled = spans_of(w["row"][twice], w["start"][twice], w["start"][twice])
                sent = w[np.concatenate([[True], np.diff(group) > 0])]
                sent["own"] = each
                parts = dealt([(2, sent, blocks + (sent["one"] % np.uint64(wide)).astype(np.int64)), (0, settled, (settled["row"] % blocks).astype(np.int64))])
                yield pa.RecordBatch.from_arrays([*parts.columns, pa.array([b""] * parts.num_rows, pa.binary())], ["block", "kind", "payload", "bytes"])

    def solve(table: pa.Table) -> pa.Table:
        spans = [records(table, 0, SPAN)]
        w, group = by_hash(records(table, 2, WINDOW))
        if len(w):
            more = (np.bincount(group)[group] > 1) & (w["own"] == 1)
            spans.append(spans_of(w["row"][more], w["start"][more], w["start"][more]))
        metas, texts = [], []
        for kind, payload, data in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), table.column("bytes").to_pylist(), strict=True):
            if kind == 1:
                metas.append(np.frombuffer(payload, dtype=META))
                at = np.concatenate([[0], np.cumsum(metas[-1]["size"].astype(np.int64))])
                texts += [data[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
        if metas:
            spans.append(sorted_runs(np.concatenate(metas), texts, unit))
        out = joined(np.concatenate(spans))
        return pa.table([pa.array(out["row"]), pa.array(out["lo"]), pa.array(out["hi"])], names=["row", "lo", "hi"])

    texts = with_matches(docs, asked, "row")
    sent = texts.select("row", "text", "asked").mapInArrow(lean(contexts), "block long, kind int, payload binary, bytes binary")
    return sent.groupBy("block").applyInArrow(lean_group(solve), "row long, lo int, hi int")


def repeat_spans(docs: DataFrame, scratch: Scratch, unit: Unit = BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, lo, hi)``: the numbers of the first and last of consecutive window starts, for windows that also start elsewhere."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(row_key(F.col(key), F.col(text)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = scratch.table(first_passes(rows, unit, max(least, size // 110 // BLOCK_ANCHORS)))
    runs = first.where("kind = 1").select("row", "pos", "lo", "hi", "gram")
    per = 1 if unit.token == "byte" else 7  # bytes of a token, about
    left = runs.agg(F.coalesce(F.sum((F.col("hi") - F.col("lo") + unit.length) * per), F.lit(0))).first()[0]
    spans = first.where("kind = 0").select("row", "lo", "hi")
    if left:
        spans = spans.union(scratch.table(last_passes(rows, runs, scratch, unit, max(least, left // BLOCK_BYTES))))
    return spans


def covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of tokens that windows cover, from spans of their starts; the end is exclusive."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((lo, hi + length) for lo, hi in spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def byte_runs(data: bytes, runs: list[tuple[int, int]], unit: Unit) -> list[tuple[int, int]]:
    """Runs of tokens as runs of bytes."""
    if unit.token == "byte" or not runs:
        return runs
    at = [m.span() for m in WORD.finditer(data)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    begins = [*(a for a, _ in runs), len(data)]
    return b"".join(data[lo:hi] for lo, hi in zip(ends, begins, strict=True))


def _with_spans(docs: DataFrame, units: list[Unit], key: str, text: str, names: tuple[str, str]) -> DataFrame:
    """``docs`` with a row key and an array of ``(u, lo, hi)``, ``u`` the unit's number; null where nothing repeats."""
    scratch = Scratch(docs.sparkSession)
    found = [repeat_spans(docs, scratch, unit, key, text).select(F.lit(i).alias("u"), "row", "lo", "hi") for i, unit in enumerate(units)]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    row, spans = names
    grouped = scratch.finish(every.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("u", "lo", "hi")).alias(spans)))
    return with_matches(docs.withColumn(row, row_key(F.col(key), F.col(text))), grouped, row, outer=True).drop(row)


def repeat_report(docs: DataFrame, unit: Unit = BYTES, passages: Unit | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs``, with ``passages`` also ``(n_passages, n_passage_words)``.

    Every byte that lies in a window of ``unit`` that also starts anywhere
    else, in the same text or another row, is removed.  Passages are the
    maximal runs of words that lie in windows of ``passages`` that also start
    elsewhere; they are counted only.  A null text counts as empty; rows that
    repeat id and text are copies of one another; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [], [])
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (t or "").encode()
                of = lambda u, s=spans: [(x["lo"], x["hi"]) for x in s or () if x["u"] == u]
                runs = byte_runs(data, covered(of(0), unit.length), unit)
                said = covered(of(1), passages.length) if passages else []
                for col, x in zip(out, (len(data), sum(b - a for a, b in runs), len(runs), len(said), sum(b - a for a, b in said), hashlib.sha256(kept_bytes(data, runs)).hexdigest()), strict=True):
                    col.append(x)
            numbers = [pa.array(x, pa.int64()) for x in out[:5]]
            more = numbers[3:] if passages else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers[:3], pa.array(out[5], pa.string()), *more], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", *COUNTED[: len(more)]])

    rows = _with_spans(docs.select(key, text), [unit, passages] if passages else [unit], key, text, private(docs, "row", "spans"))
    return rows.mapInArrow(lean(report), ", ".join([f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(f"{c} long" for c in COUNTED if passages)]))


#: What a report counts of passages.
COUNTED = ("n_passages", "n_passage_words")


def without_repeats(docs: DataFrame, unit: Unit = BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what lies in repeated windows gone from the texts.

    All copies of a repeat go, judged on the input.  Characters cut in two go
    as a whole; null texts stay null, empty ones empty; rows that repeat id
    and text are copies of one another and lose all windows; an empty table
    stays empty; other columns, whatever their names, are kept.
    """

    def keep_one(t: str | None, spans) -> str | None:  # noqa: ANN001
        if t is None or spans is None or not len(spans):
            return t
        data = t.encode()
        runs = covered([(s["lo"], s["hi"]) for s in spans], unit.length)
        return kept_bytes(data, byte_runs(data, runs, unit)).decode("utf-8", "ignore")

    @F.pandas_udf("string")
    def keep(texts, spans):  # noqa: ANN001, ANN202
        return texts.combine(spans, keep_one)

    names = private(docs, "row", "spans")
    rows = _with_spans(docs, [unit], key, text, names)
    return rows.withColumn(text, keep(F.col(text), F.col(names[1]))).select(*[F.col(f"`{c}`") for c in docs.columns])
