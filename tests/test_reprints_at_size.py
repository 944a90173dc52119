"""Reprints of large groups: what is stored between jobs, and results against comparing every two rows."""

import random
import re
from datetime import datetime, timedelta

import pytest

from echolens.operators import dedup

STORY = "id long, title string, text string, published_at timestamp, url_hidden boolean"
START = datetime(2024, 1, 1)


@pytest.fixture
def stored_rows(monkeypatch):
    """Rows of every table that is stored between jobs."""
    rows, plain = [], dedup.stored

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(dedup, "stored", counted)
    monkeypatch.setattr(dedup, "_cut", counted)
    return rows


def near_copies(spark, n):
    base = [f"word{i}" for i in range(60)]
    return spark.createDataFrame([(i, "One title of very many stories", " ".join([*base, f"end{i}"]), START, False) for i in range(n)], STORY)


def test_pairs_of_a_large_group_are_not_stored(spark, stored_rows):
    s = near_copies(spark, 120)
    assert dedup.reprint_pairs(s, s).count() == 120 * 119
    assert max(stored_rows) < 1000


def test_clusters_of_a_large_group_store_no_pairs(spark, stored_rows):
    s = near_copies(spark, 120)
    assert {r["card_id"] for r in dedup.clusters_among(s).collect()} == {0}
    assert max(stored_rows) < 1000


def trigrams(text):
    words = [f"  {w} " for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if w]
    return {w[i : i + 3] for w in words for i in range(len(w) - 2)}


def alike(a, b):
    a, b = trigrams(a), trigrams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def one_by_one(rows):
    pairs, card = {}, {}
    for i, t, x, at, _ in rows:
        for j, u, y, then, hidden in rows:
            far = at is not None and then is not None and abs(at - then) > timedelta(days=5)
            title, text = alike(t, u), alike(x, y) if (x or "").strip() else 0.0
            if i != j and not far and not hidden and title > 0.6 and (text > 0.5 if (x or "").strip() else title > 0.9):
                pairs[i, j] = title + text
    for i, *_ in rows:
        options = [(-v, o) for (n, o), v in pairs.items() if n == i and o < i and card[o] == o]
        card[i] = min(options)[1] if options else i
    return pairs, card


@pytest.mark.parametrize("rounds", [6, 1])
def test_clusters_among_rows(spark, monkeypatch, rounds):
    monkeypatch.setattr(dedup, "ROUNDS", rounds)
    rng = random.Random(rounds)
    titles = ["Rain over northern hills", "Rain over the northern hills", "Rain over hills", "Bank raises the rate", "Bank raises a rate", "...", None]
    words = [f"word{i}" for i in range(14)]
    bodies = [" ".join(words[k : k + 9]) for k in range(6)] + ["", None, " ", "?!"]
    rows = []
    for i in range(150):
        at = None if rng.random() < 0.1 else START + timedelta(days=rng.randrange(12))
        rows.append((i, rng.choice(titles), rng.choice(bodies), at, rng.random() < 0.05))
    s = spark.createDataFrame(rows, STORY)
    pairs, card = one_by_one(rows)
    got = {(r["new_id"], r["old_id"]): r["title_sim"] + r["text_sim"] for r in dedup.reprint_pairs(s, s).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[k] - v) < 1e-9 for k, v in pairs.items())
    assert {r["id"]: r["card_id"] for r in dedup.clusters_among(s).collect()} == card


@pytest.mark.parametrize("size", [20, 66, 130])
def test_sketches_lose_no_pair(size):
    """Sets that fill a folded sketch and sets that do not; no similar pair ends in the task."""
    import numpy as np
    import pyarrow as pa

    from echolens.operators import tiles

    rng = random.Random(size)
    sets = [rng.sample(range(3000), size) for _ in range(60)]
    sets += [s[: size - k % (size // 3)] + rng.sample(range(3000, 4000), k % 5) for k, s in enumerate(sets)]
    place = [rng.getrandbits(62) for _ in range(4000)]
    words = np.zeros((len(sets), tiles.WORDS), dtype=np.uint64)
    for i, s in enumerate(sets):
        for v in s:
            words[i, (place[v] >> 6) % tiles.WORDS] |= np.uint64(1 << (place[v] & 63))
    same = {c: np.zeros(len(sets), dtype=np.int64) for c in ("gram", "low", "high")}
    table = pa.table({**same, "id": np.arange(len(sets)), "n": np.array([len(s) for s in sets], dtype=np.int32), "side": np.full(len(sets), 3), "inner": np.ones(len(sets), dtype=bool), **{f"w{k}": words[:, k].view(np.int64) for k in range(tiles.WORDS)}})
    got = {(r["new_id"], r["old_id"]) for r in tiles.alike_sketches(0.6)(table).to_pylist()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and len({*a} & {*b}) > 0.6 * len({*a} | {*b})}
    assert want and want <= got
