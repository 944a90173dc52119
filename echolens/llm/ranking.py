"""Quality classifier by Bradley-Terry pairwise ranking.

A document's worth is a linear function of its features; in a pair of a good
and a bad document the good one wins with the logistic probability of the
difference.  The weights are learned by logistic loss on feature differences
of such pairs; the cut lies at the quantile of the training scores that
leaves the share of bad documents below it.  The score is the logistic
distance to that cut.

Training takes a bounded sample of labelled rows (``MOST_LABELLED``);
scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.bytetext import LOWER, Lane, slices, words
from echolens.llm.common import bounded_batches, lean, private

#: Labelled rows that training looks at, at most; those whose id hashes lowest are taken.
MOST_LABELLED = 4000
#: Preference pairs drawn for each step and steps of the descent.
PAIRS, STEPS = 4000, 400

FEATURES = ("log_bytes", "upper", "digit", "symbol", "mark", "wide", "lines", "word_length", "distinct_words", "distinct_lines", "top_word", "short")

_symbols = np.zeros(256, dtype=bool)
_symbols[[ord(c) for c in "#*$%&|<>@^~=+_\\{}[]"]] = True
_marks = np.zeros(256, dtype=bool)
_marks[[ord(c) for c in ".,;:!?'\"()-"]] = True
_upper = np.zeros(256, dtype=bool)
_upper[ord("A") : ord("Z") + 1] = True
_digit = np.zeros(256, dtype=bool)
_digit[ord("0") : ord("9") + 1] = True
_lane: list[Lane] = []


def features(col: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; null and empty texts have a zero in all but the last."""
    if not _lane:
        _lane.append(Lane(11))
    out = [np.zeros((0, len(FEATURES)))]
    for _, data, at in slices(col):
        n = np.diff(at)
        per = np.maximum(n, 1)

        def share(flag: np.ndarray, at: np.ndarray = at, per: np.ndarray = per) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flag)])[at]) / per

        start, end, first = words(data, at)
        many = np.diff(first)
        low = LOWER[data]
        prefix = _lane[0].prefix(low)
        h = _lane[0].span(prefix, start, end)
        cut = np.flatnonzero(data == 10)
        f = np.zeros((len(n), len(FEATURES)))
        f[:, 0] = np.log1p(n) / 10
        for i, flag in enumerate((_upper[data], _digit[data], _symbols[data], _marks[data], data >= 128, data == 10)):
            f[:, 1 + i] = share(flag)
        f[:, 7] = n / np.maximum(many, 1) / 20
        for i in range(len(n)):
            w = h[first[i] : first[i + 1]]
            if len(w):
                _, each = np.unique(w, return_counts=True)
                # distinct words fall off with length: compare with a usual growth
                f[i, 8] = np.log(len(each)) / np.log(len(w)) if len(w) > 1 else 1.0
                f[i, 10] = each.max() / len(w) if len(w) > 9 else 0.0
            edge = np.concatenate([[at[i]], cut[np.searchsorted(cut, at[i]) : np.searchsorted(cut, at[i + 1])] + 1, [at[i + 1] + 1]])
            if len(edge) > 2:
                line = _lane[0].span(prefix, edge[:-1], np.minimum(edge[1:] - 1, at[i + 1]))
                f[i, 9] = 1 - len(np.unique(line)) / len(line)
        f[:, 11] = many < 5
        out.append(f)
    return np.vstack(out)


def expanded(f: np.ndarray) -> np.ndarray:
    """Features, their roots and squares: ratios matter most near zero."""
    return np.hstack([f, np.sqrt(np.abs(f)), f * f])


def fit(f: np.ndarray, label: np.ndarray, seed: int = 5) -> dict:
    """Weights, scaling and cut from labelled features; without both labels every score is 0.5."""
    x = expanded(f)
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(3 * len(FEATURES)), np.ones(3 * len(FEATURES)))
    w = np.zeros(x.shape[1])
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return {"w": w, "mean": mean, "spread": spread, "cut": 0.0}
    z = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        diff = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        loses = 1 / (1 + np.exp(np.clip((diff * w).sum(axis=1), -30, 30)))
        grad = -(diff * loses[:, None]).mean(axis=0) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = (z * w).sum(axis=1)
    return {"w": w, "mean": mean, "spread": spread, "cut": float(np.quantile(s, len(bad) / (len(good) + len(bad))))}


def scores(f: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((expanded(f) - model["mean"]) / model["spread"], -8, 8)
    return 1 / (1 + np.exp(-np.clip((z * model["w"]).sum(axis=1) - model["cut"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, where: str = "true", key: str = "doc_id") -> dict:
    """Fits on at most ``MOST_LABELLED`` labelled ids that satisfy ``where``, with one text each.

    Rows without label, id or text say nothing; of labels that repeat an id
    the best counts, of texts the one that hashes lowest; without labels of
    both kinds every score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).where(where).select(key, F.col("quality").cast("int").alias("quality"))
    known = known.groupBy(key).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(key), key).limit(MOST_LABELLED)
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))], ["quality", "f"])

    rows = docs.where(F.col("text").isNotNull()).select(key, "text").join(F.broadcast(known), key)  # at most MOST_LABELLED ids
    rows = rows.groupBy(key, "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.select("quality", "text").mapInArrow(lean(run), "quality int, f array<double>").toArrow()
    f = np.array(got.column("f").to_pylist(), dtype=float).reshape(-1, width)
    y = np.array(got.column("quality").to_pylist(), dtype=int)
    order = np.lexsort((*f.T, y))  # the same model whatever order the rows came in
    return fit(f[order], y[order])


def scored(docs: DataFrame, model: dict, carry: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``carry`` columns of ``docs`` and ``name``: the score of each row's text, between 0 and 1.

    Null and empty texts have the score of a text without a character; equal
    rows are rows of their own; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    cols = list(dict.fromkeys(carry))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(features(batch.column(len(cols))), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), pa.array(s, pa.float64())], [*cols, name])

    return docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").alias(private(docs, "text")[0])).mapInArrow(lean(run), schema)


def accepted(docs: DataFrame, model: dict, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns.

    Null and empty texts are scored like others; equal rows stay or go
    together; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(features(batch.column(at)), model) >= least))

    return docs.mapInArrow(lean(run), docs.schema)
