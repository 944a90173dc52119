import random
from datetime import datetime

from pyspark.sql import functions as F

from echolens.operators import keywords, work
from echolens.operators.keywords import Keyword
from echolens.sources import html, payloads


def test_passes_end_and_are_fair(spark):
    rng = random.Random(1)
    rows = [(i, "busy" if i % 3 else rng.choice(["a", "b", "c", None]), rng.randint(1, 9)) for i in range(80)]
    items = spark.createDataFrame(rows, "id long, host string, cost long").repartition(5)
    done = [r.asDict() for r in work.passes(items, 40, 5, 100).collect()]
    assert sorted(r["id"] for r in done) == list(range(80)) and all(r["number"] for r in done)
    for n in {r["number"] for r in done}:
        of = [r for r in done if r["number"] == n]
        assert sum(r["cost"] for r in of) <= 40
        for host in {r["host"] for r in of}:
            turns = sorted(r["turn"] for r in of if r["host"] == host)
            assert turns == list(range(1, len(turns) + 1)) and len(turns) <= 5
    busy = sorted((r["number"], r["turn"], r["id"]) for r in done if r["host"] == "busy")
    assert [i for _, _, i in busy] == sorted(i for _, _, i in busy)  # in order within a host


def test_a_pass_always_gets_on(spark):
    items = spark.createDataFrame([(1, "a", 100), (2, "a", 1), (3, "b", 1)], "id long, host string, cost long")
    first = {r["id"]: r["turn"] for r in work.host_pass(items, 10, 2).collect()}
    assert sum(t is not None for t in first.values()) >= 1
    assert all(r["number"] for r in work.passes(items, 10, 2, 5).collect())
    left = work.passes(items, 0, 1, 2).collect()
    assert sorted(r["number"] is None for r in left) == [False, False, True]
    assert work.host_pass(items.limit(0), 10, 2).count() == 0


def test_results_as_of(spark):
    at = lambda h: None if h is None else datetime(2024, 1, 1 + h // 24, h % 24)
    rng = random.Random(2)
    results = [(rng.choice("ab"), at(h), f"r{h}") for h in rng.sample(range(200), 40)]
    requests = [(i, rng.choice("abc"), at(rng.choice([None, *range(200)]))) for i in range(120)]
    a = spark.createDataFrame(requests, "id long, period string, asked timestamp_ntz")
    b = spark.createDataFrame(results, "period string, saved timestamp_ntz, text string")
    got = {r["id"]: r["found"]["text"] if r["found"] else None for r in work.as_of(a, b, "period", "asked", "saved", F.to_date("_at")).collect()}
    for i, period, asked in requests:
        earlier = [] if asked is None else [(s, t) for p, s, t in results if p == period and s <= asked]
        assert got[i] == (max(earlier)[1] if earlier else None)
    assert len(got) == 120


def test_sitemap_walk(spark):
    """Nested indexes, a circle, an index without dates (its last three), and what is older than the cutoff."""
    rows = [("top", "sitemap", "mid", "2024-02-01"), ("top", "sitemap", "old", "2020-01-01"), ("mid", "sitemap", "top", "2024-02-01"), ("mid", "sitemap", "plain", "2024-03-01"), ("mid", "sitemap", "undated", None)]
    rows += [("plain", "sitemap", f"leaf{i}", None) for i in range(5)]
    rows += [(f"leaf{i}", "url", f"https://s.kz/news/a-{i}", "2024-02-02" if i != 3 else "2020-01-01") for i in range(5)] + [("old", "url", "https://s.kz/news/old", None), ("leaf4", "url", "https://s.kz/about", "2024-02-02"), ("leaf4", "url", "https://s.kz/news/a-2", "2024-02-05")]
    files = spark.createDataFrame(rows, "url string, kind string, loc string, lastmod string").coalesce(1)
    roots = spark.createDataFrame([("s", "top"), ("t", "plain"), ("u", "nowhere")], "site string, sitemap string")
    cutoff = datetime(2024, 1, 1)
    walk = work.sitemap_walk(roots, files, cutoff)
    got = {(r["site"], r["sitemap"]): r["level"] for r in walk.collect()}
    leaves = {"leaf2": 3, "leaf3": 3, "leaf4": 3}
    assert got == {("s", k): v for k, v in {"top": 0, "mid": 1, "plain": 2, **leaves}.items()} | {("t", "plain"): 0, **{("t", k): 1 for k in leaves}, ("u", "nowhere"): 0}
    urls = {(r["site"], r["loc"]): r["at"] for r in work.walked_urls(walk, files, cutoff).collect()}
    assert set(urls) == {(s, f"https://s.kz/news/a-{i}") for s in "st" for i in (2, 4)} and urls["s", "https://s.kz/news/a-2"] == datetime(2024, 2, 5)


def test_stems_through_a_dictionary(spark):
    """The published examples of both vocabularies, and the same as text by text."""
    rows = [("He was running", "and hopping nationally"), ("Важнейшие компании", "медицинская помощь в Астане"), (None, "generously related ponies"), ("", None), ("the and of", "runs, hops; nation's"), ("He was running", "and hopping nationally")]
    words = [Keyword("runs hopped", language="en"), Keyword("the", language="en"), Keyword("компанией", language="ru"), Keyword("медицинских", language="ru"), Keyword("pony", type="minus", language="en"), Keyword("NATION", language="en")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, title string, text string")
    key = lambda d: sorted((r["id"], r["matched"], r["matched_keywords"]) for r in d.collect())
    by_terms, by_texts = key(keywords.matched(df, words, terms=True)), key(keywords.matched(df, words))
    assert by_terms == by_texts
    assert [m for _, m, _ in by_terms] == [True, True, False, False, True, True]
    assert by_terms[1][2] == ["компанией", "медицинских"] and by_terms[4][2] == ["runs hopped", "NATION"]


def test_stems_move_no_text(spark, monkeypatch):
    """No text is shuffled for a small dictionary; a larger one is joined, with the same result."""
    rows = [(i, "The ponies", f"were running {i} and hopped " * 3) for i in range(20)] + [(20, None, None)]
    words = [Keyword("runs hopped", language="en"), Keyword("pony", language="en"), Keyword("nothing", type="minus", language="en")]
    df = spark.createDataFrame(rows, "id long, title string, text string")
    key = lambda d: sorted((r["id"], r["matched"], r["matched_keywords"]) for r in d.collect())
    by_list = keywords.matched(df, words, terms=True)
    assert "Exchange" not in by_list._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(keywords, "MOST_TERMS", 0)
    assert key(by_list) == key(keywords.matched(df, words, terms=True)) == key(keywords.matched(df, words))


def test_pages_and_feeds_come_in_small_batches(spark):
    """A worker holds a few pages at once, not ten thousand."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    page = "<html><body><article>" + "word " * 60 + "</article></body></html>"
    feed = "<rss><channel><item><title>T</title><link>http://l</link></item></channel></rss>"
    pages = spark.createDataFrame([(i, page) for i in range(600)], "page_id long, html string")
    feeds = spark.createDataFrame([(i, feed if i % 2 else "<broken") for i in range(600)], "source_id long, payload string")
    for rows, n in ((lambda: html.full_articles(pages), 600), (lambda: payloads.feed_items(feeds), 300)):
        spark.conf.set(name, "10000")
        assert rows().count() == n
        assert int(spark.conf.get(name)) <= 256
