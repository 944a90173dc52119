"""The stages and the whole pipeline against plain Python."""

import re
from functools import partial

import numpy as np
import pyarrow as pa
from test_llm_operators import ASSIGN, WORD, WORDS, brute_components, brute_passages
from tokenizers import Tokenizer

import corpus_pipeline
from echolens.llm import queries, ranking

SHARED = "this long passage stands word for word in some of the stories and has names such as " + " ".join(f"{c}{c}pas" for c in "abcdefghijklmnopqrstuvwxyz") + " and goes on for so many more words that it is a passage of over fifty"


def stories():
    good = [f"the plain words of story number {i} go on and on with other names like " + " ".join(f"{c}{i}{c}" for c in "abcdefghijklmnopqrstuvwxyz") + " and they end here." for i in range(30)]
    bad = ["###$$$ %%% ||| " * 20 for _ in range(8)]
    long = [f"{good[i]} again {' '.join(f'{c}{i}x' for c in 'klmnopqrstuvw')}\n{SHARED}\n and after it {' '.join(f'{c}{i}y' for c in 'abcdefghij')}" for i in (3, 7, 11)]
    rows = good + [good[0] + " more", good[1]] + bad + ["a note with the secret: abcdefghijklmnop in it and some more of the usual words that follow here"] + long
    return [*enumerate(rows), (60, None), (61, ""), (2, good[2]), (None, good[5])]


def plain_quality(rows, labels):
    """The same model by the same numbers; what is judged is which rows go on."""
    held = lambda i: i is not None and __import__("zlib").crc32(str(i).encode()) % 3 == 1
    text = {}
    for i, t in rows:
        if t is not None and i is not None:
            text.setdefault(i, t)
    known = [(text[i], q) for i, q in labels if i in text and not held(i)]
    f = ranking.features(pa.array([t for t, _ in known], pa.string()))
    y = np.array([q for _, q in known])
    order = np.lexsort((*f.T, y))
    model = ranking.fit(f[order], y[order])
    score = ranking.scores(ranking.features(pa.array([t for _, t in rows], pa.string())), model)
    return [r for r, s in zip(rows, score, strict=True) if s >= 0.5]


def plain_near(rows):
    groups = {}
    for (i, t), (_, n, c) in zip(rows, brute_components(rows), strict=True):
        groups.setdefault((c,) if n else (i, t, len(groups)), []).append((i, t))
    return [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]


def plain_cut(rows):
    out = []
    for (i, t), flags in zip(rows, brute_passages([t for _, t in rows], 50), strict=True):
        if t is not None and any(flags):
            at = [m.span() for m in WORD.finditer(t)]
            runs = [m.span() for m in re.finditer("1+", "".join(map(str, flags)))]
            for a, b in reversed(runs):
                t = t[: at[a][0]] + t[at[b - 1][1] :]
        out.append((i, t))
    return out


def plain_masks(rows):
    return [(i, t and ASSIGN.sub(lambda m: "<secret>" if len(m[2]) >= 12 else m[0], t)) for i, t in rows]


def test_stages(spark, docs_of, tmp_path):
    rows = stories()
    labels = [(i, int(i < 32 or i > 39)) for i in range(44)]
    docs = docs_of(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, kept = rows, docs
    plain = [partial(plain_quality, labels=labels), plain_near, plain_cut, plain_masks]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/s{i}")
        kept = spark.read.parquet(f"{tmp_path}/s{i}")
        want = plain[i](want)
        got = kept.collect()
        assert kept.columns == docs.columns and all(tuple(r)[5:] == ("x",) * len(docs.columns[5:]) for r in got)  # columns with clashing names
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    text = dict(want)
    assert set(range(30)) - {2} <= set(text) and not set(range(30, 40)) & set(text) and "<secret>" in text[40]
    assert not any(SHARED in (t or "") for t in text.values()) and {41, 42, 43} <= set(text) and text[41].endswith("j3y")
    tokenizer = Tokenizer.from_file(WORDS)
    totals = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in want)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_tokens"] for r in packed if r["start"] == 0) == totals and sum(r["length"] for r in packed) == sum(totals)


def test_stages_of_empty_tables(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    names = queries.llm_queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)}
