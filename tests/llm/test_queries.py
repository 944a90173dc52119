"""Every registered query of the training-data operators against plain Python on a small folder of tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from test_llm_operators import ODD, PIECES, WORDS, brute_components, brute_passages, brute_repeats, near_texts, texts
from tokenizers import Tokenizer

from echolens.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    rows = texts(7) + near_texts()[::3] + ["plain words that go on and on. " * 6 for _ in range(3)] + ["x " * 3000 + "password: abcdefghijkl"]
    documents = [(i * 3, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(rows)]
    documents += documents[12:14]  # repeated rows
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(rng.random() < 0.5), 0) for i, *_ in documents[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [float(x) for x in np.random.default_rng(i % 190).normal(size=20)]) for i in range(0, 400)] + [(1000, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, documents, vectors


def rows_of(spark, folder, name):
    return queries.llm_queries()[name](spark, folder[0]).collect()


def matched(rows, documents, want):
    """The rows of each id are those wanted for its documents, whatever the order of repeated ones."""
    got, expected = {}, {}
    for r in rows:
        got.setdefault(r[0], []).append(tuple(r)[1:])
    for (i, *_), w in zip(documents, want, strict=True):
        expected.setdefault(i, []).append(tuple(w))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_op1(spark, folder):
    rows = rows_of(spark, folder, "op1_ring_shards")
    assert rows[0].asDict().keys() >= {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    matched([(r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in rows], folder[1], [(len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows") for _, t, *_ in folder[1]])
    counts = np.bincount([r["shard"] for r in rows], minlength=40)
    assert counts.max() - counts.min() <= 1 and len(counts) == 40 and all(r["grown_shard"] is None for r in rows)
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(40) for k in range(counts[s])]


def test_op2(spark, folder):
    whole = [t for _, t, *_ in folder[1]]
    said = brute_passages(whole, 50)
    want = [(*w, len([p for p in "".join(map(str, f)).split("0") if p]), sum(f)) for w, f in zip(brute_repeats(whole, 400), said, strict=True)]
    matched(rows_of(spark, folder, "op2_repeated_bytes"), folder[1], want)


def test_op3(spark, folder):
    tokenizer, rows = Tokenizer.from_file(WORDS), rows_of(spark, folder, "op3_cutting_stock_packing")
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t, *_ in folder[1]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        copies = sum(j == i for j, *_ in folder[1])
        starts = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces[i])
        assert sum(n for _, n, _ in starts) == copies * len(ids) and all(r["doc_tokens"] == len(ids) for r in pieces[i])
        assert all(crc == zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n, crc in starts)
    for taken in places.values():
        at = 0
        for offset, n in sorted(taken):
            assert offset == at
            at += n
        assert at <= 2048


def test_op5(spark, folder):
    matched(rows_of(spark, folder, "op5_ngram_jaccard_join"), folder[1], [w[1:] for w in brute_components([(i, t) for i, t, *_ in folder[1]])])


def test_op6(spark, folder):
    kept = [(i, np.floor(1024 * np.array(v, dtype="float32").astype("float64")).astype("int64")) for i, v in folder[2] if v is not None]
    got = {}
    for r in rows_of(spark, folder, "op6_exact_top_k"):
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q, v in kept:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in kept if i != q)[:10]
            assert [got[q][k + 1] for k in range(10)] == [(i, -s) for s, i in best]
    assert len(got) == 4


def test_op8(spark, folder):
    rows = rows_of(spark, folder, "op8_pairwise_quality")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, *_ in folder[1])
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_op8_learns_nothing_from_held_out_rows(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{folder[0]}/{name}.parquet")
        if name == "labels":
            df = df.selectExpr("doc_id", f"case when {queries.HELD_OUT} then 1 - quality else quality end as quality", "toxic")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    key = lambda r: (r["doc_id"], r["score"])
    assert sorted(map(key, queries.op8_pairwise_quality(spark, str(tmp_path)).collect())) == sorted(map(key, rows_of(spark, folder, "op8_pairwise_quality")))


def test_op10(spark, folder):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for _, t, *_ in folder[1]:
        ids = sp.encode(t or "", add_eos=True)
        want.append((len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    matched(rows_of(spark, folder, "op10_piece_ids"), folder[1], want)
    assert len(ODD) > 5
