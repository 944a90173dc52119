"""Period input: presets, windows, their encoded form and labels.  Resolved on the driver before a plan is built; ``now`` is always given."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

# Periods that are offered, their names, and limits of configuration.
ALL_TIME_DAYS = 36_500
PERIOD_DAYS = (1, 3, 7, 14, 30, 60, 90, 180, 365, 730, ALL_TIME_DAYS)
PERIOD_NAMES = {1: "Сутки", 3: "3 дня", 7: "Неделя", 14: "Две недели", 30: "Месяц", 60: "2 месяца", 90: "3 месяца", 180: "Полгода", 365: "Год", 730: "2 года", ALL_TIME_DAYS: "Всё время"}
PRESETS = {"today": 0, "7d": 7, "30d": 30, "60d": 60, "90d": 90, "180d": 180, "365d": 365, "730d": 730, "all": ALL_TIME_DAYS}
PROGRESS_STEPS = 6
MIN_DURATION_MS, MAX_DURATION_MS = 30_000, 45_000
CALLBACK_BYTES = 64
ZONE = "Asia/Almaty"
NO_DATES = "Не вижу дат. Пример: 01.07.2026-15.10.2026"
TOO_MANY = "Дат должно быть не больше двух: начало и конец отрезка."


@dataclass(frozen=True)
class Window:
    """Either the last ``days`` or the inclusive range of dates."""

    days: int | None = None
    date_from: date | None = None
    date_to: date | None = None


class PeriodError(ValueError):
    """Period input that cannot be used; the message says why."""


def zoned(now: datetime, zone: str = ZONE) -> date:
    """Calendar date of an instant (UTC if naive) in a zone."""
    return (now if now.tzinfo else now.replace(tzinfo=UTC)).astimezone(ZoneInfo(zone)).date()


def as_window(period: Window | int) -> Window:
    return Window(days=period) if isinstance(period, int) else period


def bounds(period: Window | int, now: datetime, zone: str = ZONE, earliest: date | None = None) -> tuple[date, date]:
    """Inclusive dates; ``n`` days back from today are ``n + 1`` calendar days.  All time starts at ``earliest`` where that is known."""
    w = as_window(period)
    if w.days is None:
        return w.date_from, w.date_to
    today = zoned(now, zone)
    if w.days >= ALL_TIME_DAYS and earliest is not None:
        return min(earliest, today), today
    return today - timedelta(days=w.days), today


def span_days(period: Window | int) -> int:
    w = as_window(period)
    return w.days if w.days is not None else (w.date_to - w.date_from).days + 1


def encode(period: Window | int) -> str:
    w = as_window(period)
    return str(w.days) if w.days is not None else f"{w.date_from}~{w.date_to}"


def _date(text: str) -> date | None:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def decode(raw: str) -> Window | None:
    """The window that ``encode`` wrote, or None for anything else."""
    if re.fullmatch(r"[0-9]+", raw):
        return Window(days=int(raw)) if 0 < int(raw) <= ALL_TIME_DAYS else None
    ends = [_date(p) for p in raw.split("~")]
    if len(ends) != 2 or None in ends or ends[0] > ends[1]:
        return None
    return Window(date_from=ends[0], date_to=ends[1])


def known(raw: str, offered: tuple[int, ...] = PERIOD_DAYS) -> Window | None:
    """A decoded window, if a range or one of the offered periods."""
    w = decode(raw)
    return w if w and (w.days is None or w.days in offered) else None


def show(day: date) -> str:
    return day.strftime("%d.%m.%Y")


def parse_range(raw: str | None, now: datetime, zone: str = ZONE) -> Window:
    """One or two typed dates in either order of writing; one date runs until today."""
    text = (raw or "").strip()
    if not text:
        raise PeriodError(NO_DATES)
    wrong = PeriodError(f"Не понял даты: «{text}». Нужны одна или две даты в виде 01.07.2026 или 2026-07-01, например: 01.07.2026-15.10.2026")
    days = []
    for found in re.findall(r"[0-9]{1,4}[.\-/][0-9]{1,2}[.\-/][0-9]{1,4}", text):
        parts = re.split(r"[.\-/]", found)
        year, month, day = parts if len(parts[0]) == 4 else parts[::-1]
        got = _date(f"{year}-{month:0>2}-{day:0>2}") if len(year) == 4 else None
        if got is None:
            raise wrong
        days.append(got)
    if not days:
        raise wrong
    if len(days) > 2:
        raise PeriodError(TOO_MANY)
    start, end = days[0], days[1] if len(days) == 2 else zoned(now, zone)
    if start > end and len(days) == 1:
        raise PeriodError(f"{show(start)} — это будущее, а отрезок с одной датой идёт по сегодня ({show(end)}). Укажите вторую дату или возьмите дату в прошлом.")
    if start > end:
        raise PeriodError(f"Начало отрезка позже конца: с {show(start)} по {show(end)}. Поменяйте даты местами.")
    return Window(date_from=start, date_to=end)


def preset_range(period: str | None, date_from: datetime | None, date_to: datetime | None, now: datetime) -> tuple[datetime | None, datetime | None]:
    """Instants of a dashboard period: given ends win, ``today`` starts at midnight, no period means 7 days."""
    if date_from or date_to:
        return date_from, date_to
    name = period or "7d"
    if name not in PRESETS:
        raise PeriodError(f"unknown period {name!r}")
    if name == "today":
        return now.replace(hour=0, minute=0, second=0, microsecond=0), now
    return now - timedelta(days=PRESETS[name]), now


def previous_range(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The range of the same length that ends a millisecond before ``start``."""
    step = timedelta(milliseconds=1)
    return start - (end - start) - step, start - step


def clamp_page(limit: object, offset: object, most: int = 200, usual: int = 50) -> tuple[int, int]:
    """Page size between 1 and ``most`` and an offset from 0; what is no number gives the usual."""

    def number(x: object) -> int | None:
        try:
            return int(str(x))
        except ValueError:
            return None

    n, skip = number(limit), number(offset)
    return min(max(n, 1), most) if n is not None else usual, max(skip or 0, 0)


def label(period: Window | int) -> str:
    w = as_window(period)
    if w.days is None:
        return f"{show(w.date_from)} — {show(w.date_to)}"
    return PERIOD_NAMES.get(w.days, f"{w.days} дн.")


def period_list(raw: str | None) -> tuple[int, ...]:
    """A configured list of periods; the usual one unless it is whole, positive, in range and strictly ascending."""
    parts = [p.strip() for p in (raw or "").split(",")]
    if not all(re.fullmatch(r"[0-9]+", p) for p in parts):
        return PERIOD_DAYS
    days = tuple(map(int, parts))
    fine = all(0 < d <= ALL_TIME_DAYS for d in days) and all(a < b for a, b in zip(days, days[1:], strict=False))
    return days if fine else PERIOD_DAYS


def min_duration_ms(raw: str | None) -> int:
    text = (raw or "").strip()
    return min(int(text), MAX_DURATION_MS) if re.fullmatch(r"[0-9]+", text) else MIN_DURATION_MS


def progress_plan(total_ms: float, steps: float = PROGRESS_STEPS) -> list[tuple[int, int]]:
    """``(at ms, percent)`` of equal steps, the last at 100."""
    if not math.isfinite(total_ms) or total_ms <= 0:
        return []
    n = max(1, math.floor(steps) if math.isfinite(steps) and steps > 0 else PROGRESS_STEPS)
    near = lambda x: math.floor(x + 0.5)
    return [(near(total_ms * i / n), near(100 * i / n)) for i in range(1, n + 1)]


def callback(kind: str, period: Window | int, offset: int | None = None) -> str | None:
    """A button's payload, or None if it is longer than a button may carry."""
    data = f"{kind}:{encode(period)}" + ("" if offset is None else f":{offset}")
    return data if len(data.encode()) <= CALLBACK_BYTES else None


def bot_mode(raw: str | None, hosted: bool = False) -> str:
    """``webhook`` or ``polling``; where hosted, a webhook unless told otherwise."""
    mode = (raw or "").strip().lower()
    return mode if mode in ("webhook", "polling") else ("webhook" if hosted else "polling")


def number_flag(args: list[str], name: str, usual: int | None = None) -> int | None:
    """``--name=5`` of a command line, if it is a whole number from 0 on."""
    for a in args:
        if (m := re.fullmatch(rf"--{re.escape(name)}=([0-9]+)", a)) is not None:
            return int(m[1])
    return usual


def list_flag(args: list[str], name: str) -> list[str]:
    """``--name=a,b`` of a command line, blanks dropped."""
    for a in args:
        if a.startswith(f"--{name}="):
            return [x.strip() for x in a.split("=", 1)[1].split(",") if x.strip()]
    return []
