from datetime import date, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from echolens.plans import periods as p

NOW = datetime(2026, 9, 16, 20)


@pytest.mark.parametrize("raw", ["01.07.2026-15.10.2026", "2026-07-01 2026-10-15", "1.7.2026 – 15/10/2026", "01-07-2026..15-10-2026"])
def test_ranges(raw):
    assert p.parse_range(raw, NOW) == p.Window(date_from=date(2026, 7, 1), date_to=date(2026, 10, 15))


def test_single_date_runs_until_today_in_the_zone():
    assert p.parse_range("01.07.2026", NOW).date_to == date(2026, 9, 17)


@pytest.mark.parametrize("raw", ["", None, "вчера", "32.07.2026", "2026-13-01", "15.10.2026-01.07.2026", "01.01.2030", "01.01.2020 01.02.2020 01.03.2020"])
def test_unusable_ranges(raw):
    with pytest.raises(p.PeriodError):
        p.parse_range(raw, NOW)


@given(st.one_of(st.integers(1, p.ALL_TIME_DAYS).map(lambda n: p.Window(days=n)), st.tuples(st.dates(date(1990, 1, 1), date(2100, 1, 1)), st.integers(0, 900)).map(lambda x: p.Window(date_from=x[0], date_to=date.fromordinal(x[0].toordinal() + x[1])))))
def test_round_trip(window):
    assert p.decode(p.encode(window)) == window
    assert p.callback("search_more", window, 16) is not None


@pytest.mark.parametrize("raw", ["0", "36501", "x", "2026-01-02~2026-01-01", "2026-02-30~2026-03-01", "1~2~3", "-5"])
def test_foreign_periods(raw):
    assert p.decode(raw) is None


def test_bounds_and_labels():
    assert p.bounds(1, NOW) == (date(2026, 9, 16), date(2026, 9, 17))
    assert p.bounds(p.ALL_TIME_DAYS, NOW, earliest=date(2018, 6, 1))[0] == date(2018, 6, 1)
    assert p.span_days(p.Window(date_from=date(2026, 1, 1), date_to=date(2026, 1, 1))) == 1
    assert p.label(7) == "Неделя" and p.label(8) == "8 дн."
    assert p.known("8") is None and p.known("7") == p.Window(days=7)


def test_presets():
    assert p.preset_range("today", None, None, NOW) == (datetime(2026, 9, 16), NOW)
    assert p.preset_range(None, None, None, NOW)[0] == datetime(2026, 9, 9, 20)
    assert p.preset_range("bad", NOW, None, NOW) == (NOW, None)
    with pytest.raises(p.PeriodError):
        p.preset_range("bad", None, None, NOW)


@pytest.mark.parametrize(("raw", "want"), [(None, p.PERIOD_DAYS), ("1,7", (1, 7)), ("7,1", p.PERIOD_DAYS), ("1,1", p.PERIOD_DAYS), ("1,,2", p.PERIOD_DAYS), ("0", p.PERIOD_DAYS), ("36501", p.PERIOD_DAYS)])
def test_period_list(raw, want):
    assert p.period_list(raw) == want


def test_configuration():
    assert p.min_duration_ms("99999999") == p.MAX_DURATION_MS and p.min_duration_ms("x") == p.MIN_DURATION_MS and p.min_duration_ms("0") == 0
    assert p.progress_plan(30_000)[-1] == (30_000, 100) and len(p.progress_plan(30_000)) == 6 and p.progress_plan(0) == []
    assert p.clamp_page("500", "-3") == (200, 0) and p.clamp_page(None, None) == (50, 0) and p.clamp_page(0, 5) == (1, 5)
    assert p.bot_mode(" POLLING ", True) == "polling" and p.bot_mode(None, True) == "webhook" and p.bot_mode("?") == "polling"
    assert p.number_flag(["--limit=5"], "limit") == 5 and p.list_flag(["--hosts=a, ,b"], "hosts") == ["a", "b"]
