from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolens.functions import dates, render, stem, text, url

NOW = datetime(2026, 9, 16, 7)


@pytest.mark.parametrize(
    ("raw", "key"),
    [
        ("https://WWW.Site.kz/Path/", "site.kz/path"),
        ("http://site.kz/a?utm_source=x&id=5#top", "site.kz/a?id=5"),
        ("https://site.kz/?mod=news_read&id=164916", "site.kz?mod=news_read&id=164916"),
        ("  site.kz/a//  ", "site.kz/a"),
        ("https://site.kz/a?fbclid=1&gclid=2", "site.kz/a"),
    ],
)
def test_url_key(one, raw, key):
    assert one(url.url_key("u"), u=raw) == key
    assert one(url.url_key("u"), u=key) == key


@pytest.mark.parametrize(
    ("raw", "identity"),
    [
        ("HTTPS://Site.KZ/Case-Kept/", "https://site.kz/Case-Kept"),
        ("https://site.kz", "https://site.kz/"),
        ("https://site.kz/?mod=a&id=1&utm_medium=x", "https://site.kz/?mod=a&id=1"),
        ("https://site.kz/a#frag", "https://site.kz/a"),
        ("https://site.kz:443/a", "https://site.kz/a"),
        ("not a url", None),
    ],
)
def test_url_identity(one, raw, identity):
    assert one(url.url_identity("u"), u=raw) == identity


@pytest.mark.parametrize(
    ("value", "hit"),
    [("https://spam.kz/x", True), ("https://news.spam.kz", True), ("https://notspam.kz", False), ("WWW.SPAM.KZ", True), ("spam.kz/a", True), ("", False), (None, False)],
)
def test_excluded(one, value, hit):
    assert one(url.excluded("u", ["www.Spam.kz", ""]), u=value) is hit


def test_article_like(one):
    like = lambda u: one(url.article_like("u"), u=u)
    assert like("https://s.kz/news/1") and like("https://s.kz/2024/05/x") and like("https://s.kz/a-long-enough-slug")
    assert not like("https://s.kz/about") and not like("nothing")


@pytest.mark.parametrize(
    ("raw", "day"),
    [
        ("https://s.kz/2026-04-20/x", date(2026, 4, 20)),
        ("https://s.kz/2026-04-21-slug", date(2026, 4, 21)),
        ("https://s.kz/slug-22-05-2026", date(2026, 5, 22)),
        ("https://s.kz/20260803/a", date(2026, 8, 3)),
        ("https://s.kz/2023/08/slug", date(2023, 8, 1)),
        ("https://s.kz/item-65434810.html", None),
        ("https://s.kz/2023-02-31/x", date(2023, 2, 1)),
        ("https://2023-01-01.kz/x", None),
        ("bad", None),
    ],
)
def test_url_date(one, raw, day):
    assert one(dates.url_date("u", NOW), u=raw) == day


@pytest.mark.parametrize(
    ("raw", "day"),
    [
        ("20 января 2023", date(2023, 1, 20)),
        ("Вышло 5 мая  2021 года", date(2021, 5, 5)),
        ("22 қыркүйек 2026", date(2026, 9, 22)),
        ("1 қыркүйегінде 2020", date(2020, 9, 1)),
        ("28.10.2024", date(2024, 10, 28)),
        ("2024-12-17 and 01.01.2020", date(2024, 12, 17)),
        ("31 февраля 2023", None),
        ("no date", None),
        ("", None),
    ],
)
def test_human_date(one, raw, day):
    assert one(dates.human_date("t"), t=raw) == day


def test_resolved_date(one):
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    got = one(dates.resolved_date(at("1999-01-01 00:00:00"), at("2024-05-01 00:00:00"), at("2020-01-01 00:00:00"), NOW))
    assert got["source"] == "url" and got["date"] == datetime(2024, 5, 1)
    assert one(dates.resolved_date(at("2030-01-01 00:00:00"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), NOW))["source"] is None


def test_text(one):
    assert one(text.truncated("t", 5), t="  abc def  ") == "abc d…"
    assert one(text.truncated("t", 4), t="abc def") == "abc…"
    assert one(text.trimmed("t"), t="﻿  a 　") == "a"
    assert one(text.escaped_attribute("t"), t='<a href="x">&') == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert one(text.without_links("t"), t="see HTTPS://a.b/c?d, end") == "see [ссылка] end"
    assert one(text.similarity("a", "b"), a="word", b="two words") == pytest.approx(4 / 11)
    assert one(text.similarity("a", "b"), a="", b="") == 0.0
    assert one(text.content_hash("a", "b"), a=" Title ", b="TEXT") == one(text.content_hash("a", "b"), a="title", b="text")


def test_mention_context(one):
    body = "x" * 50 + " Brand here " + "y" * 50 + " z" * 200 + " brand again"
    got = one(text.mention_context("t", "b", ["BRAND", " "], 10, 1000), t="Head", b=body)
    assert got.startswith("Head\n\n") and got.lower().count("brand") == 2 and " … " in got
    near = one(text.mention_context("t", "b", ["aa"], 5, 100), t="", b="one aa two aa three")
    assert near == "one aa two aa thre"
    assert one(text.mention_context("t", "b", ["nothing"], 5, 8), t="T", b="long body text") == "T\n\nlong…"
    assert one(text.mention_context("t", "b", ["a"], 5, 8), t="Title", b="") == "Title"


@given(st.text(max_size=30))
@settings(max_examples=200)
def test_stems_are_stable(word):
    assert stem.lexemes(word, "russian") == stem.lexemes(word.lower(), "russian")


@pytest.mark.parametrize(("word", "want"), [("медицинская", "медицинск"), ("астана", "аста"), ("компаниями", "компан"), ("важнейшие", "важн"), ("бежала", "бежа")])
def test_russian(word, want):
    assert stem.russian(word) == want


@pytest.mark.parametrize(("word", "want"), [("running", "run"), ("hopping", "hop"), ("national", "nation"), ("generously", "generous"), ("ponies", "poni"), ("relational", "relat"), ("skies", "sky")])
def test_english(word, want):
    assert stem.english(word) == want


def test_card_message(spark):
    row = dict(id="1.1", source_name="S", source_domain="s.kz", title="A<B", url='http://s.kz/?a="1"', published_at=date(2024, 1, 2), published_at_text="", summary="Sum", sentiment="positive", sentiment_note="note", status="duplicate", duplicate_of="2.2")
    df = spark.createDataFrame([row], "id string, source_name string, source_domain string, title string, url string, published_at date, published_at_text string, summary string, sentiment string, sentiment_note string, status string, duplicate_of string")
    got = df.select(render.card_message().alias("m")).first()[0].split("\n")
    assert got[0].startswith("⚪⚪🟢 🟩 Позитив | <a href=") and "2024-01-02" in got[0]
    assert "A&lt;B" in got[1] and got[2:4] == ["", "Sum"] and got[4] == "" and "note" in got[5]
    assert got[6] == "<i>⚠️ дубликат пункта 2.2</i>" and got[7] == "" and got[8].startswith("🔗 ")
