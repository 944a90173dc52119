"""SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece crosses a white-space marker, a text's segmentation is that of
its marked words side by side.  Each worker keeps a bounded table of the
marked words it has met, segments an unknown one once, and joins ids back by
position.  One pass over the texts, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from echolens.llm.chunktable import piece_table
from echolens.llm.common import bounded_batches, lean, small_batches


def piece_ids(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, ids array<int>, decoded string)``: ids with the end id only; null texts count as empty."""
    return _run(docs, model, key, text, digest=False)


def piece_digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, n_tokens, ids_sha256, decoded_sha256)`` of the same ids and decoded texts.

    A null text has the end id only; rows that repeat a key are rows of their
    own; an empty table gives no rows; a long text is encoded in segments.
    """
    return _run(docs, model, key, text, digest=True)


def _run(docs: DataFrame, model: str, key: str, text: str, digest: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in small_batches(batches):
            rows = [table.encode(t or "") for t in batch.column(1).to_pylist()]
            if digest:
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                cols = [pa.array([n for _, n, _ in rows], pa.int64()), pa.array([sha(ids) for ids, _, _ in rows], pa.string()), pa.array([sha(back) for _, _, back in rows], pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                cols = [pa.array([list(map(int, ids.split())) for ids, _, _ in rows], pa.list_(pa.int32())), pa.array([back for _, _, back in rows], pa.string())]
                names = [key, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    return docs.select(key, text).mapInArrow(lean(run), schema)
