import json
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echolens.operators import versions
from echolens.operators.versions import Folder, Segments
from echolens.sources import payloads
from echolens.streaming import ingest

NOW = datetime(2026, 8, 19, 10)
BODY = " ".join(f"word{i} and name{i}" for i in range(30))


@pytest.fixture
def drop(tmp_path):
    """Puts a file of records into the watched folder."""
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, rows):
        base = {"source_id": "s", "text": "brand body", "published_at": "2026-08-18T10:00:00Z"}
        (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(base | r)) + "\n" for r in rows))

    return put


@pytest.fixture
def cycle(spark, tmp_path):
    def make(word="brand", **more):
        words = spark.createDataFrame([(word, "required", True, "ru", [word])], "phrase string, type string, is_active boolean, language string, manual_forms array<string>")
        return ingest.Cycle(spark, str(tmp_path / "table"), lambda: NOW, lambda: words, ["bad.kz"], **more)

    return make


def run(cycle, tmp_path):
    query = ingest.start(cycle, str(tmp_path / "in"), str(tmp_path / "cp"))
    if query is not None:
        query.awaitTermination()
    return query


def ids(cycle):
    return {r["id"] for r in cycle.cards().collect()}


def records(spark, rows):
    base = {"source_id": "s", "text": "brand body"}
    return spark.createDataFrame([(json.dumps(base | r),) for r in rows], "value string")


def test_cycle(spark, tmp_path, cycle, drop):
    c = cycle()
    drop("1.json", [{"id": "1", "title": "A", "url": "https://a.kz/1"}, {"id": "2", "title": "B", "url": "https://bad.kz/1"}, {"id": "3", "title": "A", "url": "https://a.kz/2"}, {"id": "4", "title": "", "url": "x"}, {"id": "5", "title": "C", "url": "https://a.kz/5", "published_at": "2026-01-01T00:00:00Z"}])
    run(c, tmp_path)
    assert ids(c) == {"1"} and c.counters == {"found": 4, "skipped_old": 1, "excluded_domain": 1, "no_keyword": 0, "inserted": 1, "reprint": 0, "duplicate": 1, "dead": 1}
    drop("2.json", [{"id": "6", "title": "A", "url": "https://a.kz/9"}, {"id": "7", "title": "D", "url": "https://a.kz/7"}, {"id": "8", "title": "E", "text": "other", "url": "https://a.kz/8"}])
    run(c, tmp_path)
    assert ids(c) == {"1", "7"}
    c(records(spark, [{"id": "7", "title": "D", "url": "https://a.kz/7"}]), 1)  # the last batch once more
    assert ids(c) == {"1", "7"}


def test_items_that_come_while_paused_wait(tmp_path, cycle, drop):
    paused = [False]
    c = cycle(paused=lambda: paused[0])
    drop("0.json", [{"id": "0", "title": "Zero", "url": "https://a.kz/0"}])
    run(c, tmp_path)
    paused[0] = True
    drop("1.json", [{"id": "1", "title": "One", "url": "https://a.kz/1"}, {"id": "2", "title": "Two", "url": "https://a.kz/2"}])
    assert run(c, tmp_path) is None and ids(c) == {"0"}
    paused[0] = False
    drop("2.json", [{"id": "3", "title": "Three", "url": "https://a.kz/3"}])
    run(c, tmp_path)
    assert ids(c) == {"0", "1", "2", "3"}


def test_dead_letters_and_their_replay(spark, tmp_path, cycle, drop):
    c = cycle()
    drop("1.json", ['{"id": "1", "title"', "nonsense", '{"id": "2", "published_at": "soon", "title": "T", "url": "https://a.kz/2"}', {"id": "3", "url": "https://a.kz/3"}, {"id": "4", "title": "T", "url": "  "}, {"title": "T", "url": "https://a.kz/5"}, '{"error": "down"}', {"id": "6", "title": "Good", "url": "https://a.kz/6"}])
    run(c, tmp_path)
    dead = c.tables["dead"].read()
    assert sorted(r["reason"] for r in dead.collect()) == ["a report of no source", "does not parse", "does not parse", "does not parse", "no address", "no id", "no title"]
    assert ids(c) == {"6"} and c.counters["dead"] == 7
    mended = F.regexp_replace("record", '"https://a.kz/3"', '"https://a.kz/3", "title": "Mended"')
    assert ingest.replay(c, 0, str(tmp_path / "in"), mended, "reason = 'no title'") == 1
    run(c, tmp_path)
    assert ids(c) == {"3", "6"}
    assert ingest.replay(c, 0, str(tmp_path / "in"), mended, "reason = 'no title'") == 1  # sent again by mistake
    run(c, tmp_path)
    assert ids(c) == {"3", "6"} and c.counters["duplicate"] == 1


def test_reprints_in_a_cycle(spark, tmp_path, cycle):
    """A story told again is none of its own, whether of a stored one or of an earlier one of its batch, and its address stands on the card."""
    c = cycle("word")
    other = " ".join(f"word{i} but thing{i}" for i in range(40, 70))
    row = lambda i, title, text, day=18: {"id": i, "title": title, "text": text, "url": f"https://a.kz/{i}", "published_at": f"2026-08-{day}T00:00:00Z"}
    c(records(spark, [row("1", "The company opens an office", BODY), row("2", "The company opens an office today", BODY + " more"), row("3", "Another story", other)]), 0)
    assert ids(c) == {"1", "3"}
    late = [row("4", "The company opens an office now", BODY + " again", 20), row("5", "The company opens an office now", BODY + " late", 30), row("6", "Another story", other, 19), row("6b", "Another story", other, 19) | {"url": "https://a.kz/6"}]
    c(records(spark, late), 1)
    assert {r["id"]: (r["outcome"], r["card_id"]) for r in c.tables["outcomes"].read().where("batch = 1").collect()} == {"4": ("reprint", "1"), "5": ("inserted", "5"), "6": ("duplicate", "3"), "6b": ("duplicate", "3")}
    cards = {r["id"]: [x["url"] for x in r["reprints"]] for r in c.cards().collect()}
    assert {k: sorted(v) for k, v in cards.items()} == {"1": ["https://a.kz/2", "https://a.kz/4"], "3": ["https://a.kz/6"], "5": []}


def test_a_reprint_is_no_card_for_others(spark, cycle):
    """What repeats only a reprint is new; equal items fare as the first of them."""
    c = cycle("word")
    row = lambda i, title, text: {"id": i, "title": title, "text": text, "url": f"https://a.kz/{i}"}
    long = "alpha beta gamma delta epsilon zeta eta theta"
    c(records(spark, [row("1", long, BODY)]), 0)
    c(records(spark, [row("2", long + " iota kappa", BODY), row("2b", long + " iota kappa", BODY), row("3", long + " iota kappa lambda omicron rho sigma", BODY)]), 1)
    told = {r["id"]: (r["outcome"], r["card_id"]) for r in c.tables["outcomes"].read().where("batch = 1").collect()}
    assert told == {"2": ("reprint", "1"), "2b": ("reprint", "1"), "3": ("inserted", "3")}


def test_the_first_batch_of_a_source_is_backfill(spark, tmp_path, cycle):
    old = lambda i, source: {"id": i, "source_id": source, "title": f"Title {i}", "url": f"https://a.kz/{i}", "published_at": "2026-01-01T00:00:00Z"}
    cycle()(records(spark, [old("1", "a"), {"source_id": "b", "error": "timeout"}, old("2", "b")]), 0)
    c = cycle()  # after a restart
    c(records(spark, [old("3", "a"), old("4", "b"), old("5", "new"), {"source_id": "a", "deep": True}]), 1)
    assert {r["id"]: r["outcome"] for r in c.tables["outcomes"].read().collect()} == {"1": "skipped_old", "2": "skipped_old", "3": "inserted", "4": "skipped_old", "5": "skipped_old"}
    state = {r["id"]: (r["status"], r["last_error"], r["last_success_at"], r["last_deep_scan_at"]) for r in c.sources().collect()}
    assert state == {"a": ("active", None, NOW, NOW), "b": ("active", None, NOW, None), "new": ("active", None, NOW, None)}
    assert {r["id"]: r["last_error"] for r in c.sources(1).collect()} == {"a": None, "b": "timeout"}
    due = payloads.deep_scan(c.sources(), NOW)
    assert {r["id"]: (r["deep_due"], r["deep_pages"]) for r in due.collect()} == {"a": (False, None), "b": (True, 25), "new": (True, 25)}


def test_files_do_not_grow_with_batches(spark, tmp_path, cycle):
    """After any number of batches there are fewer than ``fan`` folders of each size to read."""
    rows = lambda n: spark.createDataFrame([(n * 10 + i, f"d{i % 2}") for i in range(4)], "id long, day string")
    s = Segments(Folder(spark, str(tmp_path / "s")), "day", 3)
    counts = []
    for n in range(27):
        s.compact(n)
        s.write(rows(n).coalesce(1), n)
        s.write(rows(n).coalesce(1), n)  # again
        counts.append(len(s.read().inputFiles()))
    assert s.read().count() == 108 and {r[0] for r in s.read().select("batch").distinct().collect()} == set(range(27))
    assert max(counts[18:]) <= 3 + 2 * (2 + 2) and len(s.raw(None)) <= 3
    assert s.read(5) is not None and s.raw(26) == s.raw(None)[:-1]
    assert s.read().where("day = 'd1'").count() == 54
    c = cycle(fan=2)
    for n in range(5):
        c(records(spark, [{"id": f"{n}", "title": f"Title {n}", "url": f"https://a.kz/{n}"}, {"id": f"{n}r", "title": "Title 0", "url": f"https://b.kz/{n}"}]), n)
    assert ids(c) == {"0", "1", "2", "3", "4"} and [len(r["reprints"]) for r in c.cards().where("id = '0'").collect()] == [5]
    assert len(c.tables["stories"].raw(None)) <= 2


def test_readers_always_find_a_table(spark, tmp_path):
    path, failures, seen, stop = str(tmp_path / "t"), [], set(), threading.Event()
    versions.publish(spark.range(5), path)

    def read():
        while not stop.is_set():
            try:
                seen.add(versions.published(spark, path).count())
            except Exception as e:  # noqa: BLE001
                failures.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(10):
        assert versions.publish(spark.range(6 + n), path, keep=4) == n + 2
    stop.set()
    reader.join()
    assert not failures and seen and versions.published(spark, path).count() == 15
    assert versions.published(spark, path, 9).count() == 13
    assert len([n for n in Folder(spark, path).names() if n.startswith("v")]) == 4
    with pytest.raises(FileNotFoundError):
        versions.published(spark, str(tmp_path / "none"))


def test_retries():
    seen, naps = [], []

    def action():
        seen.append(1)
        if len(seen) < 3:
            raise OSError
        return "ok"

    assert ingest.retried(action, sleep=naps.append) == "ok" and naps == [1.0, 2.0]
