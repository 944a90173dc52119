"""What the reprint join moves, and that both ways to compare titles find every similar pair."""

import random
from datetime import datetime, timedelta

import pytest

from echolens.functions import text
from echolens.operators import dedup, merge, tiles
from pyspark.sql import functions as F

STORY = "id long, title string, text string, published_at timestamp, url_hidden boolean"
START = datetime(2024, 1, 1)


def trigrams(title):
    return {p[i : i + 3] for w in title.lower().split() for p in [f"  {w} "] for i in range(len(p) - 2)}


@pytest.fixture
def dealt_rows(monkeypatch):
    """Rows that are dealt to tasks to be compared."""
    rows, plain = [], tiles.dealt

    def counted(df, keys, total):
        rows.append(df.count())
        return plain(df, keys, total)

    monkeypatch.setattr(tiles, "dealt", counted)
    return rows


def test_a_text_is_sent_once_for_both_sides_and_all_days(spark, dealt_rows):
    s = spark.createDataFrame([(i, "One title of many stories", " ".join([*(f"word{k}" for k in range(40)), f"end{i}"]), START + timedelta(days=i % 20), False) for i in range(60)], STORY)
    assert dedup.closest_reprints(s, s).count() == 60
    assert max(dealt_rows) == 60


def test_copies_of_one_moment_find_each_other(spark):
    s = spark.createDataFrame([(i, "A title", "the same words of a text", START, False) for i in (1, 2, 3)], STORY)
    assert {tuple(r) for r in dedup.closest_reprints(s, s).collect()} == {(1, 2), (2, 1), (3, 1)}


def test_tiles_of_a_large_title(spark, monkeypatch):
    """Titles with more rows than a tile holds are cut by days and parts."""
    rng = random.Random(3)
    words = [f"word{i}" for i in range(16)]
    rows = [(i, "One title of many stories", " ".join(rng.sample(words, 12)), None if i % 17 == 0 else START + timedelta(days=rng.randrange(20)), i % 11 == 0) for i in range(90)]
    s = spark.createDataFrame(rows, STORY)
    want = sorted(tuple(r) for r in dedup.reprint_pairs(s, s).collect())
    best = sorted(tuple(r) for r in dedup.closest_reprints(s, s).collect())
    monkeypatch.setattr(tiles, "SETS", 4)
    assert want and sorted(tuple(r) for r in dedup.reprint_pairs(s, s).collect()) == want
    assert sorted(tuple(r) for r in dedup.closest_reprints(s, s).collect()) == best


@pytest.mark.parametrize("every", [True, False])
def test_both_ways_find_all_similar_titles(spark, monkeypatch, every):
    monkeypatch.setattr(tiles, "FEW", 10)
    monkeypatch.setattr(dedup, "_all_is_shorter", lambda *_: every)
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("rain", "bank", "over", "hill", "data") for b in ("ing", "er", "s", "ed")]
    titles = sorted({" ".join(rng.sample(words, rng.randrange(1, 9))) for _ in range(150)})
    titles += [t + " x" for t in titles[:40]]
    left, right = titles[::2] + titles[:30], titles[1::2] + titles[:30]
    frames = [spark.createDataFrame([(t,) for t in ts], "title string") for ts in (left, right)]
    name = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(F.xxhash64("t"), "t").collect()}
    found = [tuple(sorted((name[r["title"]], name[r["other"]]))) for r in dedup.similar_titles(*frames, 0.6).collect()]
    grams = {t: trigrams(t) for t in titles}
    want = {tuple(sorted((a, b))) for a in left for b in right if len(grams[a] & grams[b]) > 0.6 * len(grams[a] | grams[b])}
    assert len(found) == len(set(found)) and set(found) == want


def test_word_pieces_are_the_trigrams(spark):
    texts = ["", "a", "Ab c, déjà-vu!  Привет 12", " \n", "x" * 50, "𝒳𝒴 ok", "..a..b.."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = F.concat(F.lit("  "), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for t, w, g in df.select("text", words, text.trigrams("text")).collect():
        assert set(tiles.word_pieces(w).tolist()) == {ord(x) << 42 | ord(y) << 21 | ord(z) for x, y, z in g}, t


def test_outcomes_of_known_rows(spark):
    item = "id long, title string, text string, published_at timestamp, url_hidden boolean, hash string"
    stored = spark.createDataFrame([(1, "Title one", "Body of the first story", START, False, "h1"), (2, "Title one", "Body of the first story now", START, False, "h2")], item)
    new = spark.createDataFrame([(5, "Title one", "Body of the first story now", START, False, "h2"), (6, "Title one", "Body of the first story too", START, False, "h3"), (7, "Other", "Quite different", START, False, "h4")], item)
    got = {r["id"]: (r["outcome"], r["card_id"]) for r in merge.insert_outcomes(new, stored).collect()}
    assert got == {5: ("duplicate", 2), 6: ("reprint", 1), 7: ("inserted", None)}
