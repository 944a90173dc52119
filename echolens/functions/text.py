"""Text columns: trimming, hashes, excerpts, trigram similarity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Excerpt sizes and the mark that stands for a link.
LINK_MARK = "[ссылка]"
CONTEXT_WINDOW = 600
CONTEXT_LIMIT = 4000
LINK = r"(?i)https?://[^\s\x{feff}\p{Z}]+"
BLANK = r"[\s\x{feff}\x{a0}\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds an intermediate value once for use inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without Unicode blanks and byte-order marks at either end."""
    return F.regexp_replace(_col(c), f"^{BLANK}+|{BLANK}+$", "")


def right_trimmed(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"{BLANK}+$", "")


def collapsed(c: Column | str, limit: int | None = None) -> Column:
    """Runs of blanks as one space, trimmed, at most ``limit`` characters."""
    out = trimmed(F.regexp_replace(_col(c), f"{BLANK}+", " "))
    return F.substring(out, 1, limit) if limit else out


def content_hash(title: Column | str, text: Column | str) -> Column:
    """SHA-256 of both texts, trimmed and lower-cased, with a bar between."""
    return F.sha2(F.concat_ws("|", F.lower(trimmed(F.coalesce(_col(title), F.lit("")))), F.lower(trimmed(F.coalesce(_col(text), F.lit(""))))), 256)


def salted_hash(salt: str, key: Column | str) -> Column:
    """SHA-256 of ``salt:key``, for keys of derived rows."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), _col(key).cast("string")), 256)


def truncated(c: Column | str, limit: int) -> Column:
    """Trimmed, and cut with an ellipsis after the last ink if longer."""
    t = trimmed(c)
    return F.when(F.length(t) > limit, F.concat(right_trimmed(F.substring(t, 1, limit)), F.lit("…"))).otherwise(t)


def escaped(c: Column | str) -> Column:
    """``&``, ``<`` and ``>`` for HTML text."""
    out = _col(c)
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def escaped_attribute(c: Column | str) -> Column:
    return F.replace(escaped(c), F.lit('"'), F.lit("&quot;"))


def without_links(c: Column | str, mark: str = LINK_MARK) -> Column:
    return F.regexp_replace(_col(c), LINK, mark.replace("\\", "\\\\").replace("$", "\\$"))


def contains_any(hay: Column, forms: Sequence[str]) -> Column:
    """Whether any non-blank form occurs, in either case; no form, no match."""
    wanted = sorted({f.strip().lower() for f in forms} - {""})
    low = F.lower(hay)
    out = F.lit(False)
    for form in wanted:
        out = out | low.contains(form)
    return F.coalesce(out, F.lit(False))


def haystack(title: Column | str, text: Column | str) -> Column:
    return F.concat_ws("\n", F.coalesce(_col(title), F.lit("")), F.coalesce(_col(text), F.lit("")))


def trigrams(c: Column | str) -> Column:
    """Distinct three-letter pieces of the lower-cased words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two trigram arrays; two empty ones are 0."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def similarity(a: Column | str, b: Column | str) -> Column:
    return trigram_similarity(trigrams(a), trigrams(b))


RANGE = "struct<s:int,e:int>"


def occurrences(low: Column, term: str) -> Column:
    """Starts of the non-overlapping occurrences of a lower-case term in a lower-case text."""
    parts = F.split(low, "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)

    def starts(p: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.length(x)
            return F.struct((at + len(term)).alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(F.slice(p, 1, F.size(p) - 1), zero, step, lambda acc: acc["out"])

    return let(parts, starts)


def merged_ranges(ranges: Column) -> Column:
    """Ranges ``(s, e)`` sorted, those that touch or overlap made one."""

    def step(acc: Column, r: Column) -> Column:
        open_ = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(open_["s"].alias("s"), F.greatest(open_["e"], r["e"]).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(r)).when(r["s"] <= open_["e"], joined).otherwise(F.concat(acc, F.array(r))).cast(f"array<{RANGE}>")

    return F.aggregate(F.array_sort(ranges), F.array().cast(f"array<{RANGE}>"), step)


def mention_context(title: Column | str, body: Column | str, terms: Sequence[str], window: int = CONTEXT_WINDOW, limit: int = CONTEXT_LIMIT) -> Column:
    """The title and the passages around every occurrence of a term; without one, the head of the body."""
    head = without_links(trimmed(F.coalesce(_col(title), F.lit(""))))
    whole = trimmed(without_links(F.regexp_replace(F.coalesce(_col(body), F.lit("")), f"{BLANK}+", " ")))
    wanted = [t for t in dict.fromkeys((t or "").strip().lower() for t in terms) if t]

    def excerpt(text: Column) -> Column:
        def around(term: str) -> Column:
            return F.transform(
                occurrences(F.lower(text), term),
                lambda at: F.struct(F.greatest(F.lit(0), at - window).alias("s"), F.least(F.length(text), at + len(term) + window).alias("e")),
            )

        if not wanted:
            return text
        found = merged_ranges(F.flatten(F.array(*[around(t) for t in wanted])).cast(f"array<{RANGE}>"))
        joined = let(found, lambda rs: F.array_join(F.transform(rs, lambda r: trimmed(F.substring(text, r["s"] + 1, r["e"] - r["s"]))), " … "))
        return let(joined, lambda j: F.when(j == "", text).otherwise(j))

    def composed(text: Column) -> Column:
        out = F.when(head == "", excerpt(text)).otherwise(F.concat(head, F.lit("\n\n"), excerpt(text)))
        cut = let(out, lambda o: F.when(F.length(o) > limit, F.concat(right_trimmed(F.substring(o, 1, limit)), F.lit("…"))).otherwise(o))
        return F.when(text == "", F.substring(head, 1, limit)).otherwise(cut)

    return let(whole, composed)


def error_text(c: Column | str, host: Column | str) -> Column:
    """A stored failure for people: links replaced by the host, common causes named, 500 characters at most."""
    h = _col(host)
    t = F.regexp_replace(_col(c), F.lit(LINK), F.concat(F.lit("<ссылка "), h, F.lit(">")))
    return (
        F.when(t.rlike("HTTP 404"), F.concat(F.lit("страница недоступна: HTTP 404 ("), h, F.lit(")")))
        .when(t.rlike("HTTP 40[13]"), F.concat(F.lit("доступ к странице закрыт ("), h, F.lit(")")))
        .when(t.rlike("(?i)abort|timeout"), F.concat(F.lit("превышено время ожидания ("), h, F.lit(")")))
        .otherwise(F.substring(t, 1, 500))
    )


def error_with_cause(message: Column | str, cause: Column | str) -> Column:
    m, c = _col(message), _col(cause)
    return F.when(c.isNotNull() & (c != "") & (c != m), F.concat(m, F.lit(": "), c)).otherwise(m)


def snippet(text: Column | str, start: Column, end: Column, least: int = 20) -> Column:
    """The whole line around a cited place (0-based, end exclusive), links of the form ``[label](address)`` reduced to their label; null if shorter than ``least``."""
    t = _col(text)
    before = F.substring_index(F.substring(t, F.lit(1), start.cast("int")), "\n", -1)
    inside = F.substring(t, (start + 1).cast("int"), (end - start).cast("int"))
    after = F.substring_index(F.substring(t, (end + 1).cast("int"), F.length(t)), "\n", 1)
    plain = F.regexp_replace(F.concat(before, inside, after), r"\(?\[([^\]]*)\]\([^)]*\)\)?", "$1")
    out = trimmed(F.regexp_replace(plain, r"[ \t]+", " "))
    return F.when(F.length(out) >= least, out)
