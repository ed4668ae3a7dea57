"""Date normalisers and the date-phrase ladder. `as_of` is always given, never the clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

SEOUL = "Asia/Seoul"


def to_event_date(value: Column) -> Column:
    """DATE from `yyyyMMdd`, `yyyy-MM-dd`, `yyyy/MM/dd` or `yyyy.MM.dd` text; null when none fits."""
    text = F.trim(value.cast("string"))
    return F.coalesce(
        F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")),
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")),
        F.when(text.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.try_to_date(text, "yyyy/MM/dd")),
        F.when(text.rlike(r"^\d{4}\.\d{2}\.\d{2}$"), F.try_to_date(text, "yyyy.MM.dd")),
    )


def to_yyyymmdd(value: Column) -> Column:
    return F.date_format(value, "yyyyMMdd")


def published_at(text: Column) -> Column:
    """Korean wall-clock text in one of four formats, as an instant; null when none fits.

    The same in a session of any time zone."""
    t = F.trim(text)
    full = r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"
    day = r"^(\d{4})([-./])(\d{1,2})\2(\d{1,2})$"

    def at(pattern: str, *groups: int) -> Column:
        part = [F.regexp_extract(t, pattern, g).try_cast("int") for g in groups]
        return F.try_make_timestamp(*part[:3], *(part[3:] or [F.lit(0)] * 3), F.lit(SEOUL))

    return F.when(t.rlike(full), at(full, 1, 2, 3, 4, 5, 6)).when(t.rlike(day), at(day, 1, 3, 4))


def seoul_clock(instant: Column) -> Column:
    """What a clock in Seoul shows at an instant, as a timestamp without a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(SEOUL), instant.cast("timestamp_ntz"))


def seoul_midnight(day: Column) -> Column:
    """The instant at which a day begins in Seoul."""
    return F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(0), F.lit(0), F.lit(0),
                            F.lit(SEOUL))


def seoul_text(instant: Column) -> Column:
    """An instant as `yyyy-MM-dd HH:mm:ss` on the Seoul clock."""
    return F.date_format(seoul_clock(instant), "yyyy-MM-dd HH:mm:ss")


def as_date(value: date | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("date")


def split_at_cutoff(start: Column, end: Column, now: Column, cutoff_hour: int = 23
                    ) -> tuple[Column, Column, Column, Column]:
    """(db_start, db_end, live_start, live_end): the stored part of a range and the live part.

    The stored part ends today once the cutoff hour has passed, else yesterday. A part that is
    empty has nulls.
    """
    today = F.to_date(now)
    db_last = F.when(F.hour(now) >= cutoff_hour, today).otherwise(F.date_sub(today, 1))
    live_first = F.date_add(db_last, 1)
    has_db = (start <= db_last) & (end >= start)
    has_live = live_first <= end
    return (
        F.when(has_db, start),
        F.when(has_db, F.least(db_last, end)),
        F.when(has_live, F.greatest(live_first, start)),
        F.when(has_live, end),
    )


def _months(as_of: Column, k: int) -> Column:
    return F.add_months(as_of, -k)


def _phrase_ranges(as_of: Column) -> list[tuple[str, Column, Column]]:
    """Relative phrases, longest first so that a short one cannot hide a longer one."""
    year = F.year(as_of)
    month_start = F.trunc(as_of, "month")
    week_start = F.date_sub(as_of, F.weekday(as_of))
    day = lambda k: F.date_sub(as_of, k)
    jan1 = lambda back: F.make_date(year - back, F.lit(1), F.lit(1))
    dec31 = lambda back: F.make_date(year - back, F.lit(12), F.lit(31))
    last_month_end = F.date_sub(month_start, 1)
    table = [
        # fixed values: phrase -> range
        ("어제", day(1), day(1)),
        ("그제", day(2), day(2)),
        ("오늘", as_of, as_of),
        ("이번주", week_start, as_of),
        ("지난주", F.date_sub(week_start, 7), F.date_sub(week_start, 1)),
        ("이번달", month_start, as_of),
        ("지난달", F.trunc(last_month_end, "month"), last_month_end),
        ("올해", jan1(0), as_of),
        ("작년", jan1(1), dec31(1)),
        ("재작년", jan1(2), dec31(2)),
        ("최근", day(7), as_of),
        ("요즘", day(14), as_of),
        ("근래", day(30), as_of),
        ("최근 일주일", day(7), as_of),
        ("최근 한달", day(30), as_of),
        ("최근 3개월", _months(as_of, 3), as_of),
        ("최근 6개월", _months(as_of, 6), as_of),
    ]
    return sorted(table, key=lambda row: -len(row[0]))


def date_context(text: Column, as_of: date | str | Column) -> Column:
    """struct(start date, end date) meant by the words of `text`; the last 30 days when none are.

    The ladder: quarter or half year with its year, then `N일/주/개월 전`, then relative phrases,
    then full date, month, year, then named eras.
    """
    as_of = as_date(as_of)
    t = F.lower(F.coalesce(text, F.lit("")))

    def num(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("int")

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"))

    def months_of(year: Column, first: Column, last: Column) -> Column:
        start = F.make_date(year, first, F.lit(1))
        end = F.last_day(F.make_date(year, last, F.lit(1)))
        return span(F.date_sub(start, 3), F.least(F.date_add(end, 3), as_of))

    rules: list[tuple[Column, Column]] = []

    quarter = r"(\d{4})년?\s*([1-4])\s*분기"
    q = num(quarter, 2)
    rules.append((t.rlike(quarter), months_of(num(quarter), (q - 1) * 3 + 1, q * 3)))

    this_year = F.year(as_of)
    spoken_year = (
        F.when(t.contains("올해") | t.contains("이번"), this_year)
        .when(t.contains("재작년"), this_year - 2)
        .when(t.contains("작년") | t.contains("지난해"), this_year - 1)
        .otherwise(F.coalesce(num(r"(\d{4})"), this_year))
    )
    halves = [("1분기", 1, 3), ("2분기", 4, 6), ("3분기", 7, 9), ("4분기", 10, 12),
              ("상반기", 1, 6), ("하반기", 7, 12)]
    for word, first, last in halves:
        rules.append((t.contains(word), months_of(spoken_year, F.lit(first), F.lit(last))))

    days, weeks, months = r"(\d{1,5})\s*일\s*전", r"(\d{1,4})\s*주\s*전", r"(\d{1,4})\s*개월\s*전"
    around = lambda centre, k: span(F.date_sub(centre, k), F.date_add(centre, k))
    rules.append((t.rlike(days), around(F.date_sub(as_of, num(days)), 1)))
    rules.append((t.rlike(weeks), around(F.date_sub(as_of, num(weeks) * 7), 3)))
    month_then = F.trunc(F.add_months(as_of, -num(months)), "month")
    rules.append((t.rlike(months), span(month_then, F.last_day(month_then))))

    for phrase, start, end in _phrase_ranges(as_of):
        rules.append((t.contains(phrase), span(start, end)))

    full = r"(\d{4})[년.\-/]\s*(\d{1,2})[월.\-/]\s*(\d{1,2})일?"
    on_day = F.try_to_date(
        F.concat_ws("-", *[F.regexp_extract(t, full, g) for g in (1, 2, 3)]), "yyyy-M-d")
    rules.append((t.rlike(full) & on_day.isNotNull(), around(on_day, 1)))

    month = r"(\d{4})[년.\-/]\s*(1[0-2]|0?[1-9])(?!\d)월?"
    rules.append((t.rlike(month), months_of(num(month), num(month, 2), num(month, 2))))
    short = r"(?<!\d)(\d{2})년\s*(1[0-2]|0?[1-9])월"
    yy = num(short)
    full_year = F.when(yy < 50, yy + 2000).otherwise(yy + 1900)
    rules.append((t.rlike(short), months_of(full_year, num(short, 2), num(short, 2))))

    year_only = r"(\d{4})년"
    y = num(year_only)
    rules.append((t.rlike(year_only) & (y == this_year), span(F.date_sub(as_of, 120), as_of)))
    rules.append((t.rlike(year_only) & (y > 0), span(
        F.make_date(y, F.lit(1), F.lit(1)),
        F.least(F.make_date(y, F.lit(12), F.lit(31)), as_of))))

    eras = [
        # fixed values: named period -> range
        ("코로나", F.lit("2020-01-01").cast("date"), F.lit("2023-05-11").cast("date")),
        ("러우전쟁", F.lit("2022-02-24").cast("date"), as_of),
        ("금융위기", F.lit("2008-09-01").cast("date"), F.lit("2009-06-30").cast("date")),
    ]
    for word, start, end in eras:
        rules.append((t.contains(word), span(start, end)))

    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(span(F.date_sub(as_of, 30), as_of))
