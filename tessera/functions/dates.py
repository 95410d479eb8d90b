"""Dates of events in Russian news texts, resolved against the date of publication, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months, words of relative days, and how far from the publication a date may lie.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
RELATIVE = {"позавчера": -2, "вчера": -1, "сегодня": 0, "завтра": 1, "послезавтра": 2}
MAX_SPAN_DAYS = 400

FLAGS = "(?iuU)"
NAMED = rf"{FLAGS}\b([0-9]{{1,2}})\s+({'|'.join(MONTHS)})(?:\s+([0-9]{{4}}))?"
NUMERIC = r"(?<![0-9])([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}|[0-9]{2})(?![0-9])"
WORDS = rf"{FLAGS}\b({'|'.join(RELATIVE)})\b"


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where the calendar has none."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(month), two(day)).try_cast("date")


def _matches(text: Column, pattern: str, groups: int) -> Column:
    """An array of structs g1, g2, ... of every match of the pattern."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]
    return F.transform(found[0], lambda x, i: F.struct(x.alias("g1"), *[F.get(f, i).alias(f"g{k}") for k, f in enumerate(found[1:], 2)]))


def event_dates(text: Column, published: Column) -> Column:
    """All dates that a text names, once each: named months, then numbers, then relative words, each in order of the text.

    A date without a year is taken in the year that brings it nearest to the publication (the earlier one of two); days that
    the calendar has not, and dates more than 400 days from the publication, are left out. Null text or publication: none."""
    t = F.coalesce(text, F.lit(""))
    month = lambda m: F.element_at(_table({x: i for i, x in enumerate(MONTHS, 1)}), F.lower(m))

    def named(m: Column) -> Column:
        day = m["g1"].cast("int")
        near = F.transform(F.array(*[F.lit(y) for y in (-1, 0, 1)]), lambda y: _date(F.year(published) + y, month(m["g2"]), day))
        near = F.transform(F.filter(near, lambda d: d.isNotNull()), lambda d: F.struct(F.abs(F.datediff(d, published)).alias("far"), d.alias("d")))
        return F.when(m["g3"] != "", _date(m["g3"].cast("int"), month(m["g2"]), day)).otherwise(F.array_min(near)["d"])

    def numeric(m: Column) -> Column:
        year = m["g3"].cast("int")
        return _date(F.when(year < 100, year + 2000).otherwise(year), m["g2"].cast("int"), m["g1"].cast("int"))

    found = F.concat(
        F.transform(_matches(t, NAMED, 3), named),
        F.transform(_matches(t, NUMERIC, 3), numeric),
        F.transform(_matches(t, WORDS, 1), lambda m: F.date_add(published, F.element_at(_table(RELATIVE), F.lower(m["g1"])))),
    )
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull() & (F.abs(F.datediff(d, published)) <= MAX_SPAN_DAYS)))


def anchor(dates: Column, published: Column, status: Column) -> Column:
    """The date of the event: of the future the first date after the publication, of the past the last one up to it; else null."""
    later, earlier = F.filter(dates, lambda d: d > published), F.filter(dates, lambda d: d <= published)
    return F.when(status == "future", F.array_min(later)).when(status == "past", F.array_max(earlier))
