"""Dates of application periods as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"
# The two written forms of a day that sources use; which periods parse must agree with them.
DAY_ATOM = r"(\d{4})[./-](\d{1,2})[./-](\d{1,2})\.?"
DAY_KOREAN = r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"


def program_state(start: Column, end: Column, day: Column) -> Column:
    """UNDATED, CLOSED, UPCOMING or OPEN, in this order of precedence."""
    return (
        F.when(start.isNull() & end.isNull(), "UNDATED").when(end < day, "CLOSED").when(start > day, "UPCOMING").otherwise("OPEN")
    )


def may_be_open(start: Column, end: Column, day: Column) -> Column:
    """The period contains day as far as its bounds are known."""
    return ~((end.isNotNull() & (end < day)) | (start.isNotNull() & (start > day)))


def surely_closed(end: Column, day: Column) -> Column:
    return end.isNotNull() & (end < day)


def parsed_period(raw: Column) -> Column:
    """struct<start, end, kind> of a stated range: DATE_RANGE, INVALID_DATE_RANGE, FREE_TEXT or UNAVAILABLE."""
    text = F.trim(raw)
    both = [f"^{atom}\\s*[~〜～]\\s*{atom}$" for atom in (DAY_ATOM, DAY_KOREAN)]

    def day(pattern: str, first: int) -> Column:
        part = lambda k, width: F.lpad(F.regexp_extract(text, pattern, k), width, "0")
        return F.try_to_date(F.concat_ws("-", part(first, 4), part(first + 1, 2), part(first + 2, 2)), "yyyy-MM-dd")

    ranged = text.rlike(both[0]) | text.rlike(both[1])
    start = F.when(text.rlike(both[0]), day(both[0], 1)).when(text.rlike(both[1]), day(both[1], 1))
    end = F.when(text.rlike(both[0]), day(both[0], 4)).when(text.rlike(both[1]), day(both[1], 4))
    good = start.isNotNull() & end.isNotNull() & (start <= end)
    kind = F.when(F.coalesce(text, F.lit("")) == "", "UNAVAILABLE").when(~ranged, "FREE_TEXT").when(good, "DATE_RANGE").otherwise("INVALID_DATE_RANGE")
    return F.struct(F.when(good, start).alias("start"), F.when(good, end).alias("end"), kind.alias("kind"))


def source_timestamp(raw: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss without a zone, else null."""
    strict = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), raw)
    return F.try_to_timestamp(strict, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def calendar_months(start: Column, day: Column) -> Column:
    """Difference of year and month, whatever the day of the month."""
    return (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start)


def completed_months(start: Column, day: Column) -> Column:
    """Whole months since start, a month counting only once its day is reached."""
    return calendar_months(start, day) - (F.dayofmonth(day) < F.dayofmonth(start)).cast("int")


def bucket(value: Column, bounds: Sequence[tuple[float | None, str]]) -> Column:
    """The name of the first bound that value is below; the last bound takes the rest. Null stays null."""
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for upper, name in bounds:
        chain = chain.when(F.lit(True) if upper is None else value < upper, name)
    return chain


def local_day(at: Column) -> Column:
    """Date in the service zone of an instant that is stored without a zone, in UTC."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), at))


def next_local_midnight(at: Column) -> Column:
    """The next midnight of the service zone, in UTC without a zone."""
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), F.date_add(local_day(at), 1).cast("timestamp_ntz"))
