"""Rows → message texts.  Fixed texts are those that readers see; everything is a string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echolens.functions import dates, text, url

# Labels of tones and statuses, in the order of schema.SENTIMENTS.
TONE_MARK = {"positive": "🟢", "negative": "🔴", "neutral": "🟡", "undefined": "⚪"}
TONE_NAME = {"positive": "Позитив", "negative": "Негатив", "neutral": "Нейтрал", "undefined": "Не определена"}
CARD_LABEL = {"positive": "🟩 Позитив", "negative": "🟥 Негатив", "neutral": "🟨 Нейтрал", "undefined": "⬜ Не определена"}
CARD_SCALE = {"negative": "🔴⚪⚪", "neutral": "⚪🟡⚪", "positive": "⚪⚪🟢", "undefined": "⚪⚪⚪"}
CARD_STATUS = {"verified": "", "partial": "частично проверено", "unverified": "источник не открывался — данные по URL", "duplicate": "дубликат"}
NO_DATE = "дата не определена"
SOURCE_TO_MENTION = {"rss": "news", "parser": "news", "telegram": "telegram", "search_api": "news", "social_api": "social", "social_search_api": "social_search", "curated": "news"}
TITLE_LENGTH, SNIPPET_LENGTH = 200, 350
PERIOD_PROMPT = "За какой период искать упоминания?"
EMPTY_POOL = "Упоминаний не найдено."
RESET_CANCELLED = "Сброс отменён — ничего не изменилось."
RESET_NOTHING = "В пуле нет ссылок — сбрасывать нечего."
DEEP_NOTES = {
    "sitemap": "Глубокий обход: использован sitemap источника, найдено материалов: {n}.",
    "html-pagination": "Глубокий обход: sitemap не найден, использована HTML-пагинация листинга, найдено материалов: {n}.",
    "none": "Глубокий обход недоступен: ни sitemap, ни HTML-пагинация не дали ссылок на статьи (возможно, раздел новостей рендерится через JS) — источник добавлен, но пока не может собирать материалы автоматически.",
    "skipped": "Глубокий обход отложен: этот источник уже проверялся недавно, следующий проход пройдёт по расписанию /search.",
    "error": "Глубокий обход завершился ошибкой при первом подключении — источник добавлен, следующая попытка пройдёт при очередном /search.",
}


def looked_up(c: Column | str, table: dict[str, str], usual: str) -> Column:
    key = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(usual))


def tone(c: Column | str) -> Column:
    return F.concat(looked_up(c, TONE_MARK, TONE_MARK["undefined"]), F.lit(" "), looked_up(c, TONE_NAME, TONE_NAME["undefined"]))


def mention_type(kind: Column | str) -> Column:
    return looked_up(kind, SOURCE_TO_MENTION, "other")


def shown_date(c: str, zone: str = dates.ZONE) -> Column:
    return F.coalesce(dates.displayed_in_zone(c, zone), F.lit(NO_DATE))


def item_block(number: Column, zone: str = dates.ZONE) -> Column:
    """Number, tone and title; source and date; summary or snippet."""
    body = F.coalesce("summary", "snippet", F.lit(""))
    head = F.concat(number.cast("string"), F.lit(". "), tone("sentiment"), F.lit(" · "), text.escaped(text.truncated("title", TITLE_LENGTH)))
    return F.concat(head, F.lit("\n"), text.escaped(F.coalesce("source_label", F.lit(""))), F.lit(" · "), shown_date("published_at", zone), F.lit("\n"), text.escaped(body))


def item_message(number: Column, zone: str = dates.ZONE) -> Column:
    """The block with the address on a line of its own, where there is one."""
    link = F.when(F.coalesce("url", F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("\n🔗 "), text.escaped("url")))
    return F.concat(item_block(number, zone), link)


def title_line(number: Column, zone: str = dates.ZONE) -> Column:
    head = F.concat(number.cast("string"), F.lit(". "), tone("sentiment"), F.lit(" "), shown_date("published_at", zone), F.lit(" · "), text.escaped(F.coalesce("source_label", F.lit(""))))
    return F.concat(head, F.lit("\n"), text.escaped(text.truncated("title", TITLE_LENGTH)))


def tone_totals() -> Column:
    parts = [F.concat(F.lit(f"{TONE_MARK[s]} "), F.col(s).cast("string")) for s in ("positive", "negative", "neutral", "undefined")]
    return F.concat_ws(" · ", *parts)


def header(label: str, start, end) -> Column:  # noqa: ANN001
    """Two lines over a one-row table of totals."""
    name = label.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return F.concat(F.lit(f"<b>Упоминания за {name}</b> (с {start:%d.%m.%Y} по {end:%d.%m.%Y})\nВсего: "), F.col("total").cast("string"), F.lit(" · "), tone_totals())


def period_confirmation(label: str, start, end, published: bool = True) -> str:  # noqa: ANN001
    line = f"Период: {label} (с {start:%d.%m.%Y} по {end:%d.%m.%Y})"
    return line if published else f"{line}\nДашборд обновить не удалось — в веб-интерфейсе осталась прежняя выдача."


def empty_period(label: str) -> str:
    return f"За {label} упоминаний не найдено."


def progress(label: str, percent: int) -> str:
    return f"Ищу упоминания за {label}… {percent}%"


def deep_note(strategy: str, n: int) -> str:
    return DEEP_NOTES[strategy].format(n=n)


def reset_done(links: int, mentions: int) -> str:
    return (
        f"Пул сброшен. Удалено упоминаний: {mentions}, ссылок в очереди: {links}.\n"
        "Лента и дашборд по этим ссылкам сейчас пустые — наполнить их заново можно кнопкой периода "
        "в /search: выдача за этот период и окажется в дашборде. На /search и /status сброс не повлиял."
    )


def card_message() -> Column:
    """A card as HTML: tone, outlet and date; title; summary; notes; address."""
    href = text.escaped_attribute("url")
    when = F.coalesce(F.nullif(text.trimmed(F.coalesce("published_at_text", F.lit(""))), F.lit("")), F.col("published_at").cast("string"), F.lit(NO_DATE))
    link = lambda inner: F.concat(F.lit('<a href="'), href, F.lit('">'), inner, F.lit("</a>"))
    status = looked_up("status", CARD_STATUS, "")
    suffix = F.when(F.col("duplicate_of").isNotNull(), F.concat(status, F.lit(" пункта "), F.col("duplicate_of"))).otherwise(status)
    lines = [
        F.concat(looked_up("sentiment", CARD_SCALE, CARD_SCALE["undefined"]), F.lit(" "), looked_up("sentiment", CARD_LABEL, CARD_LABEL["undefined"]), F.lit(" | "), link(text.escaped("source_domain")), F.lit(" | "), text.escaped(when)),
        F.concat(F.lit("<b>"), link(text.escaped("title")), F.lit("</b>")),
        F.lit(""),
        text.escaped("summary"),
        F.when(F.coalesce("sentiment_note", F.lit("")) != "", F.concat(F.lit("\n<i>Тональность: "), text.escaped("sentiment_note"), F.lit("</i>"))),
        F.when(status != "", F.concat(F.lit("<i>⚠️ "), text.escaped(suffix), F.lit("</i>"))),
        F.lit(""),
        F.concat(F.lit("🔗 "), text.escaped("url")),
    ]
    return F.concat_ws("\n", *lines)


def card_plain() -> Column:
    note = F.when(F.coalesce("sentiment_note", F.lit("")) != "", F.concat(F.lit(" ("), "sentiment_note", F.lit(")"))).otherwise(F.lit(""))
    when = F.coalesce(F.nullif(F.col("published_at_text"), F.lit("")), F.col("published_at").cast("string"), F.lit("не определена"))
    return F.concat_ws("\n", F.concat(F.lit("["), "id", F.lit("] "), "source_name"), F.col("title"), F.col("url"), F.concat(F.lit("Дата: "), when), F.concat(F.lit("Содержание: "), "summary"), F.concat(F.lit("Тональность: "), "sentiment", note))


def alert(zone: str = dates.ZONE) -> Column:
    """A new mention: header, title, date, summary, head of the text, quotation."""
    href = text.escaped_attribute("url")
    body = text.trimmed(F.coalesce("text", F.lit("")))
    first = F.coalesce(F.nullif(text.trimmed(F.get(F.split(body, "\\n\\s*\\n"), 0)), F.lit("")), body)
    domain = F.coalesce(url.url_host("url"), "url")
    link = lambda inner: F.concat(F.lit('<a href="'), href, F.lit('">'), inner, F.lit("</a>"))
    full = F.coalesce(F.date_format(F.from_utc_timestamp("published_at", zone), "dd.MM.yyyy, HH:mm:ss"), F.lit(NO_DATE))
    compact = F.coalesce(F.date_format(F.from_utc_timestamp("published_at", zone), "HH:mm dd.MM.yyyy"), F.lit(NO_DATE))
    nonempty = lambda c: F.nullif(c, F.lit(""))
    quote = F.concat_ws("\n", F.concat(F.lit("<b>"), text.escaped(F.coalesce(nonempty(F.col("source_label")), F.col("source_name"), domain)), F.lit("</b>")), text.escaped("title"), nonempty(text.escaped(text.truncated(first, SNIPPET_LENGTH))))
    summary = F.when(text.trimmed(F.coalesce("summary", F.lit(""))) != "", F.concat(F.lit("📝 <i>"), text.escaped(text.trimmed("summary")), F.lit("</i>")))
    return F.concat_ws(
        "\n\n",
        F.concat(looked_up("sentiment", CARD_SCALE, CARD_SCALE["undefined"]), F.lit(" "), looked_up("sentiment", CARD_LABEL, CARD_LABEL["undefined"]), F.lit(" | "), link(text.escaped(domain)), F.lit(" | "), compact),
        F.concat(F.lit("<b>"), link(text.escaped("title")), F.lit("</b>")),
        F.concat(F.lit("🗓 "), full),
        summary,
        nonempty(text.escaped(text.truncated(body, SNIPPET_LENGTH))),
        F.concat(F.lit("<blockquote>"), quote, F.lit("</blockquote>")),
    )


def date_span(first: str = "first_date", last: str = "last_date", zone: str | None = dates.ZONE) -> Column:
    show = (lambda c: dates.displayed_in_zone(c, zone)) if zone else dates.displayed
    return F.coalesce(F.concat(show(first), F.lit(" — "), show(last)), F.lit("нет данных"))


def pool_status(zone: str = dates.ZONE) -> Column:
    """Text of a one-row pool summary."""
    names = {"processed": "обработано", "not_relevant": "не релевантны", "failed": "с ошибкой", "pending": "в очереди"}
    status = [F.concat(F.lit(f"{n} "), F.col(c).cast("string")) for c, n in names.items()]
    status.append(F.when(F.col("excluded") > 0, F.concat(F.lit("исключено "), F.col("excluded").cast("string"))))
    last = F.coalesce(F.date_format(F.from_utc_timestamp("last_processed_at", zone), "dd.MM.yyyy, HH:mm"), F.lit("ещё не запускалась"))
    line = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Пул ссылок: "), F.col("total_links").cast("string"), F.lit(" всего")),
        line("По статусам: ", F.concat_ws(" · ", *status)),
        line("Упоминаний в пуле: ", F.col("mentions_total")),
        line("Диапазон дат статей: ", date_span(zone=zone)),
        line("Без даты: ", F.col("undated_mentions")),
        line("Последняя обработка: ", last),
    )


def card_status() -> Column:
    """Text of a one-row card-set summary with its dates."""
    n = lambda c: F.col(c).cast("string")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Готовых карточек: "), n("total"), F.lit(" всего, доступно для /search: "), n("shown")),
        F.concat(F.lit("Тональность: "), tone_totals()),
        F.concat(F.lit("Проверено: "), n("status_verified"), F.lit(" · частично: "), n("status_partial"), F.lit(" · по URL: "), n("status_unverified")),
        F.concat(F.lit("Диапазон дат статей: "), date_span(zone=None)),
        F.concat(F.lit("Без даты: "), n("undated")),
        F.when(F.col("duplicates") > 0, F.concat(F.lit("Скрыто как дубликаты: "), n("duplicates"))),
    )


def source_lines(counts: DataFrame) -> DataFrame:
    """One line for each outlet of ``counts(source_name, count, domain)``."""
    tail = F.when(F.col("domain").isNotNull(), F.concat(F.lit(" (<code>"), text.escaped("domain"), F.lit("</code>)"))).otherwise(F.lit(""))
    return counts.withColumn("line", F.concat(text.escaped("source_name"), F.lit(" — "), F.col("count").cast("string"), tail))


def batch_messages(rows: DataFrame, order: list[Column], start: int, size: int, zone: str = dates.ZONE) -> DataFrame:
    """``(number, message)`` of the next batch: one article a message, with its address, numbered on from ``start``."""
    batch = rows.orderBy(*order).offset(start).limit(max(1, size))
    at = batch.withColumn("number", F.row_number().over(Window.orderBy(*order)) + start)  # a batch is a few rows
    return at.select("number", item_message(F.col("number"), zone).alias("message"))


def card_statistics(totals: DataFrame, outlets: DataFrame) -> DataFrame:
    """``message``: a one-row table of totals and the lines of ``outlets(source_name, count, domain)``, most cards first.

    Outlets are the names of a hand-kept card set.
    """
    n = lambda c: F.col(c).cast("string")
    head = [F.lit("<b>Проверенные карточки упоминаний</b>"), F.lit(""), F.concat(F.lit("Всего: <b>"), n("total"), F.lit("</b>"))]
    head += [F.concat(F.lit(f"{CARD_LABEL[s]}: "), n(s)) for s in ("positive", "neutral", "negative")]
    head.append(F.when(F.col("undefined") > 0, F.concat(F.lit(f"{CARD_LABEL['undefined']}: "), n("undefined"))))
    lines = source_lines(outlets).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "source_name", "line"))).alias("_lines"))
    both = totals.withColumn("_one", F.lit(1)).join(lines.withColumn("_one", F.lit(1)), "_one")
    listed = F.concat_ws("\n", F.lit(""), F.concat(F.lit("<b>Издания ("), F.size("_lines").cast("string"), F.lit(")</b>")), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"), F.lit(""), F.lit("Карточки одного издания: <code>/curated &lt;домен&gt;</code>"))
    return both.select(F.concat_ws("\n", *head, F.when(F.size("_lines") > 0, listed)).alias("message"))
