import random

import pytest
from pyspark.sql import functions as F

from echolens.operators import dedup, keywords
from echolens.operators.keywords import Keyword


def one_by_one(n, edges):
    """Stories in order of arrival: each joins the best earlier card or becomes one."""
    by = {}
    for new, old, score in edges:
        by.setdefault(new, []).append((-score, old))
    card = {}
    for i in range(n):
        options = sorted(x for x in by.get(i, ()) if card[x[1]] == x[1])
        card[i] = options[0][1] if options else i
    return card


def clusters(spark, n, edges):
    pairs = spark.createDataFrame([(a, b, s / 2, s / 2) for a, b, s in edges], "new_id long, old_id long, title_sim double, text_sim double")
    return {r["id"]: r["card_id"] for r in dedup.reprint_clusters(spark.range(n).select("id"), pairs).collect()}


def band(n):
    return [(i, i - k, 2 - k / 10) for i in range(1, n) for k in (1, 2) if i >= k]


@pytest.mark.parametrize(("rounds", "chunk"), [(6, 20_000), (1, 9)])
def test_clusters_as_one_by_one(spark, monkeypatch, rounds, chunk):
    monkeypatch.setattr(dedup, "ROUNDS", rounds)
    monkeypatch.setattr(dedup, "CHUNK", chunk)
    rng = random.Random(rounds)
    edges = {(a, b): (a, b, rng.choice([1.2, 1.4, 1.6])) for a in rng.choices(range(1, 200), k=400) for b in [rng.randrange(a)]}
    assert clusters(spark, 200, edges.values()) == one_by_one(200, edges.values())
    assert clusters(spark, 40, band(40)) == one_by_one(40, band(40))


def test_a_chain_of_very_many_stories(spark):
    """No task holds more than a part of it."""
    assert clusters(spark, 100_000, band(100_000)) == one_by_one(100_000, band(100_000))


def test_clusters_of_no_pairs(spark):
    assert clusters(spark, 3, []) == {0: 0, 1: 1, 2: 2}


@pytest.mark.parametrize("block", [250_000, 20])
def test_phrases_in_texts(spark, monkeypatch, block):
    monkeypatch.setattr(keywords, "BLOCK_CHARACTERS", block)
    rng = random.Random(4)
    texts = [None, "", "Abc ABC", *("".join(rng.choices("abcé \n", k=rng.randint(0, 60))) for _ in range(60))]
    phrases = ["abc", "ABC", "", None, "a\nb", "bc a", "É", "nothing of it", "abc", *("".join(rng.choices("abc ", k=3)) for _ in range(20))]
    rows = spark.createDataFrame([(i, "c" if i % 2 else None, t) for i, t in enumerate(texts)], "id long, title string, text string")
    table = spark.createDataFrame(list(enumerate(phrases)), "ordinal long, phrase string")
    want = {(i, n, p) for i, t in enumerate(texts) for n, p in enumerate(phrases) if p is not None and p.lower() in f"{'c' if i % 2 else ''}\n{t or ''}".lower()}
    got = [tuple(r) for r in keywords.keyword_hits(rows, table, "id").collect()]
    assert set(got) == want and len(got) == len(want)
    assert keywords.keyword_hits(rows, table.limit(0), "id").count() == 0


def test_texts_are_searched_once(spark):
    rows = spark.createDataFrame([(i, ["One", None, "Two"][i % 3], ["brand here", "minus brand", None, ""][i % 4]) for i in range(60)], "id long, title string, text string")
    words = [Keyword("brand", "exact_phrase"), Keyword("minus", "minus"), Keyword("two", "exact_phrase")]
    key = lambda df: sorted((r["id"], r["matched"], r["matched_keywords"]) for r in df.collect())
    assert key(keywords.matched_once(rows, words)) == key(keywords.matched(rows, words))
    searched = keywords.matched_once(rows, words).select("id", F.size("matched_keywords").alias("n"))
    assert searched.count() == 60
