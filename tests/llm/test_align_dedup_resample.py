"""Token alignment, exact dedup against snapshots and importance resampling, each against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm_operators import ODD, PIECES, by_value, texts  # noqa: F401
from tokenizers import Tokenizer

from echolens.llm import alignment, common, exact, queries, resampling
from echolens.llm.chunktable import byte_letters
from echolens.llm.common import Scratch
from echolens.llm.fuse import Fuse

BYTES = queries.tokenizer_path("byte_bpe_50k.json")
MORE = [*ODD, *texts(3)[9:], "a b", "ab", " a\tb\n", "", None, "x" * 5000, "ends with space ", "<s> <|endoftext|> 12", "ﬁ ½ é", "a\x1cb \x85 c　d"]


# token alignment
A, B = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
A.encode_special_tokens = True
BYTE_OF = {letter: byte for byte, letter in byte_letters().items()}


def brute_alignment(text):
    """``(a ids, b ids, groups, links)`` by walking over both sides; None without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spelled_a = [bytes(BYTE_OF[c] for c in A.id_to_token(i)) for i in a]
    spelled_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
        return None
    groups, links, i, j, x, y, at_a, at_b = [], [], 0, 0, 0, 0, len(spelled_a[0]), len(spelled_b[0])
    while i < len(a):
        links.append((a[i], b[j]))
        move_a, move_b = at_a <= at_b, at_b <= at_a
        if move_a and move_b:
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            x, y = i + 1, j + 1
        if move_a:
            i += 1
            at_a += len(spelled_a[i]) if i < len(a) else 0
        if move_b:
            j += 1
            at_b += len(spelled_b[j]) if j < len(b) else 0
    return a, b, groups, links


def brute_links(docs):
    found = [brute_alignment(t) for t in docs]
    count = Counter(link for f in found if f for link in set(f[3]))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    sha = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest()
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(count[x] == most[x[0]] for x in f[3]), sum(count[x] for x in f[3]), sha(f[2])) for f in found]


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_links(spark, docs_of, most):
    rows = alignment.link_report(docs_of(MORE), Scratch(spark), BYTES, PIECES, most_pairs=most).collect()
    assert sorted(map(tuple, rows)) == [(i, *w) for i, w in enumerate(brute_links(MORE))]


def test_links_of_no_rows(spark, docs_of):
    assert alignment.link_report(docs_of(["x"]).limit(0), Scratch(spark), BYTES, PIECES).collect() == []
    assert alignment.link_report(docs_of([None, ""]), Scratch(spark), BYTES, PIECES).collect()[1][1:] == (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(BYTES, PIECES)


ALPHABET = list("ab zéß日😀\n\t  \x1c\x85\xa0​ ▁'<0x41>\x00.,1sS") + ["<|endoftext|>", "don't", " word", "́", "ﬁ", "x" * 40]


def agrees(aligner, text):
    n_a, n_b, n_groups, groups, links = aligner.align(text)
    want = brute_alignment(text)
    if want is None:
        assert (n_a, n_b, n_groups, groups, len(links)) == (0, 0, 0, "", 0)
    else:
        assert (n_a, n_b, groups) == (len(want[0]), len(want[1]), ";".join(want[2])) and n_groups == len(want[2])
        assert [divmod(x, aligner.n_b) for x in links.tolist()] == want[3]


@given(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join))
@settings(max_examples=300, deadline=None)
def test_alignment_of_odd_texts(aligner, text):
    agrees(aligner, text)


def test_alignment_in_segments(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT", 40)
    monkeypatch.setattr(alignment, "SMALL", 30)
    monkeypatch.setattr(alignment, "STRETCH", 25)
    rng = random.Random(5)
    for _ in range(200):
        agrees(aligner, "".join(rng.choices(ALPHABET, k=rng.randint(10, 120))))


def test_elementary_intervals_and_products():
    ends, a, b, shared = alignment.elementary(np.array([2, 5, 6]), np.array([1, 2, 6]))
    assert ends.tolist() == [1, 2, 5, 6] and a.tolist() == [0, 0, 1, 2] and b.tolist() == [0, 1, 2, 2] and shared.tolist() == [False, True, False, True]
    assert list(alignment.group_products("1,2|3;4|5,6")) == [(1, 3), (2, 3), (4, 5), (4, 6)]
    assert list(alignment.group_products("")) == []


# exact dedup
@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_fuse_filters(n):
    rng = np.random.default_rng(n)
    keys, others = (rng.integers(-(2**63), 2**63 - 1, k) for k in (n, 50_000))
    f = Fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert f.holds(keys).all() and f.holds(others).mean() < 0.006
    assert len(f.slots) < 1.6 * n + 150  # a small filter has three segments beside what its keys need


def brute_exact(rows):
    plain = lambda t: "".join(c for c in t or "" if c not in " \t\n\r\x0b\x0c")
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, 0 if i is None else i, n))
    out = []
    for n, (i, t) in enumerate(rows):
        best = min(groups[plain(t)])
        out.append((i, rows[best[3]][0], len(groups[plain(t)]), best[3] == n, hashlib.sha256(plain(t).encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x) if x is not None else (True, 0) for x in row)


ROWS = [(i * 7 % 100, t) for i, t in enumerate(MORE)] + [(3, "the same"), (3, "the same"), (None, "the same"), (None, None), (200, "thesame  ")] + [(300 + i, "copied\n") for i in range(40)]


def test_exact_duplicates(spark, docs_of):
    for older in (None, F.lit(True), F.lit(False), F.col("doc_id") < 50):
        rows = exact.exact_duplicates(docs_of(ROWS), Scratch(spark), older=older).collect()
        assert sorted(map(tuple, rows), key=key) == sorted(brute_exact(ROWS), key=key)
    assert exact.exact_duplicates(docs_of(["x"]).limit(0), Scratch(spark)).collect() == []


def test_texts_of_one_digest_stay_apart(spark, docs_of, monkeypatch):
    monkeypatch.setattr(exact, "digest", lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 64, "0")))
    monkeypatch.setattr(exact, "HEAVY", 4)
    rows = exact.exact_duplicates(docs_of(ROWS), Scratch(spark)).collect()
    assert sorted((tuple(r)[:4] for r in rows), key=key) == sorted((w[:4] for w in brute_exact(ROWS)), key=key)


def test_a_batch_against_a_stored_snapshot(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "BUCKET_KEYS", 8)  # many buckets, several tasks for each
    old, new = [(i, f"story {i}") for i in range(200)], [(1000 + i, f"  story{i * 3}") for i in range(100)]
    scratch = Scratch(spark)
    rows = exact.rows_of(docs_of(old), scratch)
    groups, _ = exact.grouped(rows, scratch)
    snap = exact.snapshot(rows, groups, scratch).write(str(tmp_path / "snap"))
    assert snap.buckets == 25 and snap.filters.count() == 25
    batch = exact.rows_of(docs_of(new), scratch)
    names, _ = exact.grouped(batch, scratch, "b")
    maybe = exact.screened(names.select(exact.short("d").alias("f")), snap).count()
    assert 67 <= maybe <= 72
    links = exact.known(batch, names, snap, scratch).join(names, "name").join(snap.groups.select(F.col("name").alias("of"), F.col("keep.id").alias("first")), "of")
    assert sorted((r["keep"]["id"], r["first"]) for r in links.collect()) == [(1000 + i, i * 3) for i in range(67)]


# importance resampling
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL_LETTERS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_resampling(rows, target, longest=1, percent=10, least=20):
    def features(t):
        w = WORD.findall((t or "").translate(SMALL_LETTERS))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    over_s, over_t = s.total() + 10000, t.total() + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * over_s / ((s[b] + 1) * over_t)))
    out, eligible = [], []
    for i, x in rows:
        n, found = features(x)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least:
            eligible.append(out[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for n, row in enumerate(eligible[: percent * len(eligible) // 100]):
        row[4] = n + 1
    return sorted(map(tuple, out), key=key)


DRAWN = [*MORE, "Ünï 12 ÄB ab AB"] + [" ".join(random.Random(i).choices("alpha beta gamma delta Eps 1 22 x".split(), k=15 + i)) for i in range(60)]


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (2, 35, 20), (3, 100, 1)])
def test_resampling(spark, docs_of, by_value, monkeypatch, longest, percent, least):
    if percent > 10:
        by_value(resampling)
        for name, value in {"BLOCK": 3, "RANGE_ROWS": 5, "SEGMENT": 20}.items():
            monkeypatch.setattr(resampling, name, value)
    rows = [(i, t) for i, t in enumerate(DRAWN)] + [(7, DRAWN[-1]), (7, DRAWN[-1]), (None, DRAWN[-2]), (None, DRAWN[-2])]
    target = ["Alpha beta!", None, "alpha 22"]
    got = resampling.resampled(docs_of(rows).repartition(5), docs_of(target), Scratch(spark), percent, least, features=resampling.Features(longest=longest)).collect()
    assert sorted(map(tuple, got), key=key) == brute_resampling(rows, target, longest, percent, least)


def test_resampling_of_little(spark, docs_of):
    none = docs_of(["x"]).limit(0)
    assert resampling.resampled(none, docs_of(["a"]), Scratch(spark)).collect() == []
    rows = resampling.resampled(docs_of([None, "a b"]), none, Scratch(spark)).collect()
    assert sorted(map(tuple, rows)) == brute_resampling([(0, None), (1, "a b")], [])


@given(st.lists(st.lists(st.integers(0, 9), max_size=12), max_size=6), st.integers(1, 4), st.integers(0, 80))
@settings(max_examples=200, deadline=None)
def test_tournament_merge(runs, size, draws):
    blocks = [(n, sorted(run)[low : low + size]) for n, run in enumerate(runs) for low in range(0, len(run), size)]
    out = list(resampling.merge(sorted(blocks, key=lambda b: b[1][0]), draws))
    values = [block[1][i] for _, block, i in out]
    everything = sorted(x for run in runs for x in run)
    assert values[:draws] == everything[:draws] and sorted(values) == everything
    assert [p for p, _, _ in out] == [n if n < draws else None for n in range(len(everything))]


# the queries on the small tables
@pytest.mark.parametrize("name", ["op12_exact_dedup", "op13_importance_resampling"])
def test_queries_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = queries.llm_queries()[name](spark, folder)
    found = con.execute(queries.llm_oracles()[name])
    assert [d[0] for d in found.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=key) == sorted(found.fetchall(), key=key)


def test_op11(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op11_token_alignment(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, rows.collect())) == sorted((d[0], *w) for d, w in zip(docs, brute_links([d[1] for d in docs]), strict=True))


def test_nothing_is_left_after_release(spark, docs_of):
    mark = len(Scratch.made)
    exact.exact_duplicates(docs_of(["a", "a"]), Scratch(spark)).collect()
    common.release(mark)
    assert len(Scratch.made) == mark
