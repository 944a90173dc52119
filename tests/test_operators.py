import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echolens.operators import dedup, filters, keywords, merge, order, records, stats
from echolens.operators.keywords import Keyword
from echolens.sources import files, html, payloads

NOW = datetime(2026, 8, 19, 10)


def hit(spark, title, text, kws):
    df = spark.createDataFrame([(title, text)], "title string, text string")
    r = keywords.matched(df, kws).first()
    return r["matched"], r["matched_keywords"]


def test_keywords(spark):
    assert hit(spark, "any", "thing", []) == (True, [])
    assert hit(spark, "The runner", "was running", [Keyword("run", language="en")]) == (True, ["run"])
    assert hit(spark, "nothing", "here", [Keyword("run", language="en")]) == (False, [])
    assert hit(spark, "Big brand", "x", [Keyword("бренд", manual_forms=("Brand",))]) == (True, ["бренд"])
    assert hit(spark, "brand", "minus word", [Keyword("brand", type="exact_phrase"), Keyword("minus", type="minus", manual_forms=("minus",))]) == (False, [])
    assert hit(spark, "Медицинские новости", "", [Keyword("медицинская")]) == (True, ["медицинская"])
    assert hit(spark, "Астане", "", [Keyword("Астана")]) == (False, [])
    assert hit(spark, "x", None, [Keyword("off", is_active=False)]) == (True, [])


STORY = "id long, title string, text string, published_at timestamp, url_hidden boolean"


def stories(spark, rows):
    return spark.createDataFrame([(*r, False) if len(r) == 4 else r for r in rows], STORY)


def test_reprints(spark):
    body = "the company opened a new data centre in the north of the country and hired many people"
    s = stories(spark, [
        (1, "Weather on day 19", "rain in the hills, calm sea and a warm evening", NOW),
        (2, "Weather on day 20", "snow falls over quiet plains while markets rest", NOW),
        (3, "Company opens data centre", body, NOW),
        (4, "Company opens a data centre", body + " today", NOW),
        (5, "Company opens data centre", body, datetime(2026, 7, 1)),
        (6, "Company opens data centre", "", None),
        (7, "Company opens data centre", body, NOW, True),
    ])
    got = {(r["new_id"], r["old_id"]) for r in dedup.reprint_pairs(s, s).collect()}
    assert (3, 4) in got and (4, 3) in got and (6, 3) in got and (6, 5) in got
    assert (1, 2) not in got and (3, 5) not in got and not any(o == 7 for _, o in got)
    clusters = {r["id"]: r["card_id"] for r in dedup.reprint_clusters(s.where("id < 5"), dedup.reprint_pairs(s.where("id < 5"), s.where("id < 5"))).collect()}
    assert clusters == {1: 1, 2: 2, 3: 3, 4: 3}


def test_insert_and_reprints(spark):
    item = "id long, title string, text string, url string, source_id string, published_at timestamp, found_at timestamp, url_hidden boolean"
    stored = merge.hashed(spark.createDataFrame([(1, "Title one", "Body of the first story here", "u1", "s", NOW, NOW, False)], item)).withColumn("reprints", F.array().cast("array<struct<url:string,source_id:string,found_at:timestamp>>"))
    new = merge.hashed(spark.createDataFrame([(2, " title ONE", "body of the first story here ", "u2", "t", NOW, NOW, False), (3, "Something else", "entirely new words", "u3", "t", NOW, NOW, False)], item))
    out = merge.insert_outcomes(new, stored)
    assert {r["id"]: r["outcome"] for r in out.collect()} == {2: "duplicate", 3: "inserted"}
    assert {r["id"] for r in merge.inserted(stored, out).collect()} == {1, 3}
    assert [x["url"] for x in merge.with_reprints(stored, out).first()["reprints"]] == ["u2"]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "see http://a.b", "http://u", True), (2, "see http://a.b", "http://u", False)], "id int, title string, url string, url_hidden boolean")
    a, b = filters.redacted(df).orderBy("id").collect()
    assert a["url"] is None and a["title"] == "see [ссылка]" and b["url"] == "http://u" and b["title"] == "see http://a.b"
    nested = filters.redacted_value({"items": [{"urlHidden": True, "url": "x", "text": "http://x y", "reprints": [1]}]})
    assert nested["items"][0] == {"urlHidden": True, "text": "[ссылка] y", "url": None, "reprints": []}


def test_state_machine(spark):
    links = spark.createDataFrame([(1, "pending", 0), (2, "pending", 2), (3, "pending", 1), (4, "excluded", 0)], "id int, status string, attempts int")
    for c in ("last_error", "mention_id", "date_source"):
        links = links.withColumn(c, F.lit("old"))
    links = links.withColumn("last_attempt_at", F.lit(None).cast("timestamp")).withColumn("processed_at", F.lit(None).cast("timestamp"))
    tried = spark.createDataFrame([(1, "error", "boom", None, None), (2, "error", "boom", None, None), (3, "processed", None, "m", "page")], "id int, result string, message string, mention_id string, date_source string")
    got = {r["id"]: (r["status"], r["attempts"], r["last_error"]) for r in merge.after_attempt(links, tried, NOW).collect()}
    assert got == {1: ("pending", 1, "boom"), 2: ("failed", 3, "boom"), 3: ("processed", 2, None), 4: ("excluded", 0, "old")}


def test_save_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    merge.save(spark.range(5).toDF("id"), path)
    merge.save(spark.range(2).toDF("id"), path)
    assert spark.read.parquet(path).count() == 2
    merge.clear(spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == 0


def test_change_rounding(spark):
    df = spark.createDataFrame([(12, 8), (0, 0), (7, 8), (1, 3)], "a int, b int")
    assert [r[0] for r in df.select(stats.share_change(F.col("a"), F.col("b"))).collect()] == [50.0, None, -12.5, -66.7]


def test_packing_and_order(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([5, 5, 30, 1, 1])], "g int, o int, line string")
    pages = order.packed_pages(df, "g", "o", "line", 12).orderBy("page").collect()
    assert [(r["first"], r["shown"]) for r in pages] == [(0, 2), (2, 1), (3, 2)]
    assert order.batch_state(10, 8, 2) == (10, 0) and list(order.batches(range(3), 0)) == [[0], [1], [2]]


def test_leaks(spark):
    bodies = spark.createDataFrame([(1, "go to https://s.kz/a/b?c=1 now"), (2, "path /a/b?c=1"), (3, "s.kz/a/b"), (4, "nothing here/at all")], "body_id int, body string")
    links = spark.createDataFrame([(9, "https://s.kz/a/b?c=1")], "link_id int, url string")
    assert {r["body_id"] for r in filters.leaks(bodies, links).collect()} == {1, 2, 3}


def test_leaks_whatever_the_case_the_escapes_and_the_place(spark):
    links = ["https://s.kz/a/b?c=1", "https://s.kz/a/b", "https://News.kz:8080/2024/a-long-name-of-a-story/", "http://bare.kz/", "no-slash-at-all", "xy", "https://u@t.kz/q#top", "HTTPS://t.kz/%D0%B0/Ä"]
    bodies = ["GO https://S.KZ/A/B?c=1", r'{"u":"https:\/\/s.kz\/a\/b"}', "xx/a/b?c=12345", "//news.kz/2024/a-long-name-of-a-story/more", "/2024/a-long-name-of-a-story", "see http://bare.kz/ here", "a / b / c", "an NO-SLASH-AT-ALL-here", "galaxy", "t.kz/q", "/%d0%b0/ä", "", "https://s.kz/a/c"]

    def shapes(u):
        m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)([^#]*)", u.lower())
        more = [m[2] + m[3]] * (len(m[2] + m[3]) > 1) + [m[1] + m[2]] * (len(m[2]) > 1) if m else []
        return [u.lower(), *more]

    want = {(i, j) for i, b in enumerate(bodies) for j, u in enumerate(links) if any(x in b.replace("\\/", "/").lower() for x in shapes(u))}
    found = filters.leaks(spark.createDataFrame(enumerate(bodies), "body_id int, body string"), spark.createDataFrame(enumerate(links), "link_id int, url string"))
    got = [(r["body_id"], r["link_id"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and {(0, 0), (1, 1), (3, 2), (8, 5), (7, 4)} <= want


def test_link_file(spark):
    rows = ["Group A", "https://s.kz/1", "", "https://s.kz/1/", "Group B", "https://s.kz/?id=1", "https://s.kz/?id=2", "http://"]
    lines = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(rows)], "file string, line int, value string")
    links = {r["line"]: r["group_label"] for r in files.links_of(lines).collect()}
    assert links == {2: "Group A", 6: "Group B", 7: "Group B"}
    c = stats.links_file_counters(files.link_lines(lines)).first()
    assert (c["total_lines"], c["url_lines"], c["unique_urls"], c["duplicate_urls"], c["groups"]) == (8, 4, 3, 1, 2) or c["malformed_urls"] == 1


PAGE = """<html><head><title>ITS</title></head><body><nav>menu 01.01.2020</nav><div><h1>A headline that is long enough</h1><span>20 января 2023</span></div>
<article><p>%s</p></article><a rel="next" href="?p=2">2</a><a href="/news/1">x</a></body></html>""" % ("word " * 60)


def test_pages(spark):
    title, body, at = html.full_article(PAGE)
    assert title == "A headline that is long enough" and body.startswith("word word") and "menu" not in body and at == datetime(2023, 1, 20)
    assert html.next_page(PAGE, "https://s.kz/list") == "https://s.kz/list?p=2"
    assert html.only_date("1.1.2020 " * 300) == datetime(2020, 1, 1) and html.only_date("1.1.2020 2.1.2020") is None
    assert html.json_ld_dates(html.Page('<script type="application/ld+json">{"@graph":[{"datePublished":"2024-01-02"}]}</script><script type="application/ld+json">{bad</script>')) == ["2024-01-02"]
    assert html.full_article("") == ("", "", None)
    df = spark.createDataFrame([(1, "https://s.kz/list", PAGE)], "page_id long, url string, html string")
    assert [r["link"] for r in html.page_links(df).collect()] == ["https://s.kz/news/1"]


def test_feeds_and_answers(spark):
    rss = "<rss><channel><item><title>T</title><link>http://l</link><description>D</description><pubDate>Wed, 31 Jan 2024 10:00:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="http://a"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("r", rss), ("a", atom), ("b", "<broken"), ("n", None)], "source_id string, payload string")
    got = {r["source_id"]: (r["title"], r["url"], r["published_at"]) for r in payloads.feed_items(df).collect()}
    assert got == {"r": ("T", "http://l", datetime(2024, 1, 31, 10)), "a": ("A", "http://a", datetime(2024, 1, 1))}
    stored = spark.createDataFrame([("k", '{"savedAt":"2024-01-01T00:00:00.000Z","finds":[{"title":"T","url":"http://u","publishedAt":"bad"},{"title":"T","url":"http://v","publishedAt":null,"sentiment":"odd"},{"url":"http://w"}]}'), ("g", "garbage")], "key string, payload string")
    rows = payloads.stored_finds(stored).collect()
    assert [(r["url"], r["sentiment"]) for r in rows] == [("http://v", "undefined")]
    assert payloads.boolean_query([Keyword("a"), Keyword("b c", type="exact_phrase"), Keyword("d", type="minus")]) == '(a OR "b c") NOT d'
    assert payloads.boolean_query([Keyword("d", type="minus")]) is None


@pytest.mark.parametrize(("raw", "name"), [("t.me/x_y", "x_y"), ("https://t.me/s/chan", "chan"), ("@chan", "chan"), ("channel1", "channel1"), ("https://s.kz/a", None)])
def test_channel_name(one, raw, name):
    assert one(payloads.channel_name("c"), c=raw) == name


def test_blocks_give_what_whole_groups_give(spark):
    rng = random.Random(5)
    rows = [(g, k, rng.choice(["a", "b", None, None]), k, k + rng.randint(0, 12)) for g in (1, 2, None) for k in sorted(rng.sample(range(300), 60))]
    df = spark.createDataFrame(rows, "g int, k int, v string, s int, e int")
    block = F.floor(F.col("k") / 20)
    groups = {g: [r for r in rows if r[0] == g] for g in (1, 2, None)}
    got = {(r["g"], r["k"]): r["number"] for r in order.numbered(df, ["g"], [F.col("k")], block, 5).collect()}
    assert got == {(g, r[1]): i + 5 for g, rs in groups.items() for i, r in enumerate(rs)}
    want, last = {}, None
    for g, rs in groups.items():
        last = None
        for _, k, v, *_ in rs:
            last = v or last
            want[g, k] = last
    assert {(r["g"], r["k"]): r["x"] for r in order.carried(df, F.col("v"), ["g"], "k", block, "x").collect()} == want
    merged = []
    for g, rs in groups.items():
        for *_, s, e in rs:
            if merged and merged[-1][0] == g and s <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([g, s, e])
    found = order.merged_intervals(df, ["g"], "s", "e", F.floor(F.col("s") / 20)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, merged), key=str)


@pytest.mark.parametrize(("alone", "limit", "want"), [(True, 9, ["HEAD", "aaaa", "bbbb", "c" * 30]), (True, 10, ["HEAD\n\naaaa", "bbbb", "c" * 30]), (False, 9, ["HEAD\n\naaaa", "bbbb", "c" * 30])])
def test_pages_with_a_header(spark, alone, limit, want):
    df = spark.createDataFrame([(1, i, s, "HEAD") for i, s in enumerate(["aaaa", "bbbb", "c" * 30])], "g int, o int, line string, h string")
    pages = order.packed_pages(df, "g", "o", "line", limit, head="h", head_alone=alone).orderBy("page").collect()
    assert [r["text"] for r in pages] == want and [r["page"] for r in pages] == list(range(len(want))) and sum(r["shown"] for r in pages) == 3


def test_a_pool_run(spark):
    long = "The brand opens an office. " * 30
    links = spark.createDataFrame([(1, "https://a.kz/n/1", "h1", "G", "pending", 0), (2, "https://a.kz/n/2", "h2", None, "pending", 0), (3, "https://a.kz/2019/01/3", "h3", "G", "pending", 2), (4, "https://a.kz/n/4", "h4", "G", "pending", 0)], "id long, url string, url_hash string, group_label string, status string, attempts int")
    pages = spark.createDataFrame([("https://a.kz/n/1/", "Title", long, None), ("https://a.kz/n/2", "Short", "brand", NOW), ("https://a.kz/2019/01/3", "Old", long, None)], "url string, title string, text string, published_at timestamp")
    models = spark.createDataFrame([(2, "Model", None, True, ["the brand is named", "twice"])], "id long, title string, date timestamp, model_mentioned boolean, fragments array<string>")
    done = records.outcomes(links, pages, models, [Keyword("brand", type="exact_phrase")], ["brand"], NOW, datetime(2020, 1, 1))
    got = {r["id"]: r for r in done.collect()}
    assert {i: (r["result"], r["read_via"], r["date_source"]) for i, r in got.items()} == {1: ("processed", "parser", None), 2: ("processed", "model", None), 3: ("not_relevant", "parser", None), 4: ("error", "model", None)}
    assert got[2]["excerpt"].endswith("the brand is named twice") and got[3]["message"] == "до 01.01.2020" and got[4]["message"] == records.UNREADABLE
    mentions = spark.createDataFrame([("m1", 1, "old", "old", None, "x", "negative", True, None)], "id string, curated_link_id long, title string, text string, published_at timestamp_ntz, source_label string, sentiment string, url_hidden boolean, keywords array<string>")
    after_links, after = records.processed(links.withColumns({"mention_id": F.lit(None).cast("string"), "last_error": F.lit(None).cast("string")}), mentions, done, NOW)
    rows = {r["curated_link_id"]: r for r in after.collect()}
    assert rows.keys() == {1, 2} and (rows[1]["id"], rows[1]["title"], rows[1]["sentiment"]) == ("m1", "Title", "negative")
    assert rows[2]["title"] == "Model" and rows[2]["source_label"] == records.POOL_NAME and rows[2]["url_hidden"]
    assert {r["id"]: (r["status"], r["attempts"]) for r in after_links.collect()} == {1: ("processed", 1), 2: ("processed", 1), 3: ("not_relevant", 3), 4: ("pending", 1)}
    assert {r["id"]: r["mention_id"] for r in after_links.collect()}[1] == "m1"
