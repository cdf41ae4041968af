"""Dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billgrid.functions import lexicon as lx
from billgrid.functions.text import let, null_if_empty, strip_ws, text_or_empty

_MONTH_NAME, _SEPARATED, _COMPACT, _SHORT_SEPARATED = lx.MONTH_NAME_DATE, lx.SEPARATED_DATE, lx.COMPACT_DATE, lx.SHORT_SEPARATED_DATE


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL when the parts name no day of the calendar."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def full_year(year: Column) -> Column:
    return F.when(year >= 100, year).when(year < 70, year + 2000).otherwise(year + 1900)


def _month_first(year: Column, a: Column, b: Column) -> Column:
    """Month-first unless the first number cannot be a month."""
    return F.when(a > 12, safe_date(year, b, a)).otherwise(safe_date(year, a, b))


def _ints(text: Column, pattern: str, groups=(1, 2, 3)) -> Column:
    """Numbers captured by the first match of a pattern; NULLs without a match."""
    return F.array(*[F.regexp_extract(text, pattern, i).try_cast("int") for i in groups])


def _hit(raw: Column, day: Column) -> Column:
    return let(
        day.cast("string"),
        lambda d: F.when(d.isNotNull(), F.struct(raw.alias("raw"), d.alias("value"))),
    )


def parse_date(text: Column) -> Column:
    """First date of a text as ``struct<raw, value>`` with an ISO value, else NULL."""
    months = F.create_map(*[F.lit(x) for kv in lx.MONTHS.items() for x in kv])

    def named(t: Column) -> Column:
        parts = F.array(*[F.regexp_extract(t, _MONTH_NAME, i) for i in range(7)])

        def read(p: Column) -> Column:
            pick = lambda i, j: F.when(p[2] != "", p[i]).otherwise(p[j])
            month = F.try_element_at(months, F.lower(pick(2, 4)))
            year = let(pick(3, 6).try_cast("int"), full_year)
            return _hit(p[0], safe_date(year, month, pick(1, 5).try_cast("int")))

        return F.when(t.rlike(_MONTH_NAME), let(parts, read))

    def separated(t: Column) -> Column:
        def read(p: Column) -> Column:
            a, b, c = p[0], p[1], p[2]
            return (
                F.when(a > 1900, safe_date(a, b, c)).when(c > 1900, _month_first(c, a, b))
                .when(c < 100, _month_first(full_year(c), a, b))
            )

        return F.when(t.rlike(_SEPARATED), _hit(F.regexp_extract(t, _SEPARATED, 0), let(_ints(t, _SEPARATED), read)))

    def compact(t: Column) -> Column:
        def read(run: Column) -> Column:
            part = lambda start, length: F.substring(run, start, length).try_cast("int")
            day = (
                F.when(run.rlike("^(?:19|20)[0-9]{6}$"), safe_date(part(1, 4), part(5, 2), part(7, 2)))
                .when(F.length(run) == 8, _month_first(part(5, 4), part(1, 2), part(3, 2)))
                .otherwise(_month_first(full_year(part(5, 2)), part(1, 2), part(3, 2)))
            )
            return _hit(run, day)

        return F.when(t.rlike(_COMPACT), let(F.regexp_extract(t, _COMPACT, 1), read))

    def read(t: Column) -> Column:
        return F.when(t.rlike(r"\d"), F.coalesce(named(t), separated(t), compact(t)))

    return let(strip_ws(text_or_empty(text)), read)


def _both_readings(year: Column, first: Column, second: Column) -> Column:
    return F.array_distinct(
        F.array_compact(F.array(safe_date(year, second, first), safe_date(year, first, second)))
    )


def possible_dates(raw: Column) -> Column:
    """Every valid reading of a numeric date, day-first before month-first."""

    def of_digits(digits: Column) -> Column:
        part = lambda start, length: F.substring(digits, start, length).try_cast("int")
        return (
            F.when(
                digits.rlike("^(?:19|20)[0-9]{6}$"),
                F.array_compact(F.array(safe_date(part(1, 4), part(5, 2), part(7, 2)))),
            )
            .when(F.length(digits) == 8, _both_readings(part(5, 4), part(1, 2), part(3, 2)))
            .when(F.length(digits) == 6, _both_readings(full_year(part(5, 2)), part(1, 2), part(3, 2)))
        )

    short = let(
        _ints(text_or_empty(raw), _SHORT_SEPARATED), lambda p: _both_readings(full_year(p[2]), p[0], p[1])
    )
    return F.coalesce(let(F.regexp_replace(text_or_empty(raw), r"\D", ""), of_digits), short)


def date_or_null(c: Column) -> Column:
    """Date of the first ten characters, NULL when they are not ISO."""
    return F.try_to_date(F.regexp_extract(text_or_empty(c), r"(?U)^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def normalize_date(c: Column) -> Column:
    """ISO text of the date, the original text when it is none, NULL when blank."""
    return F.coalesce(date_or_null(c).cast("string"), F.nullif(strip_ws(text_or_empty(c)), F.lit("")))


def date_candidates(value: Column, raw: Column) -> Column:
    """Texts an expected date may equal: the value plus both readings of a numeric raw.

    Readings that are no calendar day stay in the set as text, as the value itself does.
    """

    def readings(digits: Column) -> Column:
        year = F.when(F.length(digits) == 8, F.substring(digits, 5, 4)).otherwise(
            F.concat(F.lit("20"), F.substring(digits, 5, 2))
        )
        first, second = F.substring(digits, 1, 2), F.substring(digits, 3, 2)
        return F.when(
            F.length(digits).isin(6, 8), F.array(F.concat_ws("-", year, second, first), F.concat_ws("-", year, first, second))
        ).otherwise(F.expr("cast(array() as array<string>)"))

    numeric = let(F.regexp_replace(text_or_empty(raw), r"\D", ""), readings)
    return F.array_distinct(F.array_compact(F.concat(F.array(normalize_date(value)), numeric)))


def rfc3339(c: Column) -> Column:
    return F.try_to_timestamp(null_if_empty(strip_ws(text_or_empty(c))))


def rfc2822(c: Column) -> Column:
    """Mail ``Date`` header to a UTC timestamp; a missing zone means UTC."""
    text = strip_ws(text_or_empty(c))
    parts = r"(?i)^(?:[a-z]{3},\s*)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*([+-]\d{4})?"
    day, mon, year, clock, zone = (F.regexp_extract(text, parts, i) for i in range(1, 6))
    months = F.create_map(*[F.lit(x) for kv in lx.MONTHS.items() for x in kv])
    month = F.try_element_at(months, F.lower(mon))
    full_clock = F.when(F.length(clock) <= 5, F.concat(F.lpad(clock, 5, "0"), F.lit(":00"))).otherwise(F.lpad(clock, 8, "0"))
    offset = F.when(zone == "", F.lit("+00:00")).otherwise(
        F.concat(F.left(zone, F.lit(3)), F.lit(":"), F.right(zone, F.lit(2)))
    )
    iso = F.concat(
        year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"),
        F.lit(" "), full_clock, offset,
    )
    return F.try_to_timestamp(iso)


def received_at(epoch_ms: Column, date_header: Column) -> Column:
    """Provider epoch milliseconds when numeric, else the mail date header."""
    return F.coalesce(F.timestamp_millis(epoch_ms.try_cast("long")), rfc2822(date_header))
