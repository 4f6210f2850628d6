"""Date handling (F5, F11, F12) and the fixed calendars the reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, TimestampNTZType, TimestampType, DateType

from ledgerlens.functions.numbers import round2, number_text
from ledgerlens.functions.text import strip

# Calendar month names in calendar order, and the fiscal
# (April-March) order the month-trend report uses.
ALL_MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
FISCAL_MONTHS = [
    "April", "May", "June", "July", "August", "September",
    "October", "November", "December", "January", "February", "March",
]

# Written dates: the numbers or names in the order in which a form has them, an
# optional time after them.  The month comes first; a day first is only read
# where the month would be impossible.  A year of two digits is the one within
# fifty years of today.  Seconds keep six digits of their fraction.
_TIME = r"(?:[T ]\s*([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}(?:\.[0-9]{1,6})?))?(?:(?<=\.[0-9]{6})[0-9]+)?\s*([AaPp])?[Mm.]*)?$"
_NUMBERS = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})" + _TIME
_YEAR_FIRST = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + _TIME
_DAY_NAME = r"^([0-9]{1,2})[- ]([A-Za-z]{3})[a-z]*[-, ]+([0-9]{4}|[0-9]{2})" + _TIME
_NAME_DAY = r"^([A-Za-z]{3})[a-z]*[- ]([0-9]{1,2})[-, ]+([0-9]{4}|[0-9]{2})" + _TIME
_SHORT_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_EXCEL_EPOCH_UNIX_DAYS = 25569  # 1899-12-30 -> 1970-01-01
# Serials of the dates that a nanosecond clock can hold, 1677-09-22 to 2262-04-11; others are no dates.
_SERIAL_RANGE = (-81182.0, 132320.0)


def excel_date(col: Column | str, dtype=None) -> Column:
    """Excel serial day number (fractions kept) or date text -> timestamp.

    ``dtype`` is the input column's Spark type when known: timestamps pass
    through, numbers are serials, strings try serial first, then written
    forms.  Whatever is no date (text, nan, a serial out of
    range) becomes null; no cell ends the job.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, (TimestampType, TimestampNTZType, DateType)):
        return c.cast("timestamp")

    def from_serial(n: Column) -> Column:
        fine = n.between(*[F.lit(v) for v in _SERIAL_RANGE])
        micros = F.rint((F.when(fine, n) - F.lit(_EXCEL_EPOCH_UNIX_DAYS)) * F.lit(86400e6))
        return F.timestamp_micros(micros.cast("bigint"))

    if isinstance(dtype, NumericType):
        return from_serial(c.cast("double"))
    text = strip(c.cast("string"))
    serial = text.try_cast("double")
    zoned = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+(Z|[+-][0-9:]+)$"), text.try_cast("timestamp"))
    return F.when(serial.isNotNull(), from_serial(serial)).otherwise(F.coalesce(zoned, _written_date(text)))


def _written_date(text: Column) -> Column:
    """The timestamp that a text spells out in one of the forms above; null for anything else."""
    form = F.when(text.rlike(_NUMBERS), F.lit(_NUMBERS)).when(text.rlike(_YEAR_FIRST), F.lit(_YEAR_FIRST)).when(
        text.rlike(_DAY_NAME), F.lit(_DAY_NAME)).when(text.rlike(_NAME_DAY), F.lit(_NAME_DAY))
    # The parts of the one form that fits, found once.
    parts = F.array(form, *[F.call_function("regexp_extract", text, form, F.lit(i)) for i in range(1, 8)])
    return F.element_at(F.transform(F.array(parts), _from_parts), 1)


def _from_parts(parts: Column) -> Column:
    form = parts[0]
    number = lambda i: parts[i].try_cast("int")
    named = lambda i: ((F.instr(F.lit(_SHORT_MONTHS), F.lower(parts[i])) + 2) / 3).cast("int")
    swapped = (form == _NUMBERS) & (number(1) > 12)
    year = F.when(form == _YEAR_FIRST, number(1)).otherwise(number(3))
    today = F.year(F.current_date())
    near = year + 2000
    near = F.when(near >= today + 50, near - 100).otherwise(near)
    year = F.when((year < 100) & (form != _YEAR_FIRST), near).otherwise(year)
    month = F.when(form == _YEAR_FIRST, number(2)).when(form == _DAY_NAME, named(2)).when(form == _NAME_DAY, named(1)).when(
        swapped, number(2)).otherwise(number(1))
    day = F.when(form == _YEAR_FIRST, number(3)).when(form == _DAY_NAME, number(1)).when(form == _NAME_DAY, number(2)).when(
        swapped, number(1)).otherwise(number(2))
    hour, half = F.coalesce(number(4), F.lit(0)), F.lower(parts[7])
    hour = F.when(half == "a", hour % 12).when(half == "p", hour % 12 + 12).otherwise(hour)
    second = F.coalesce(parts[6].try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
    return F.try_make_timestamp(year, month, day, hour, F.coalesce(number(5), F.lit(0)), second)


def month_name(ts: Column | str) -> Column:
    """full English month name; null -> 'Unknown'."""
    c = F.col(ts) if isinstance(ts, str) else ts
    # Array lookup instead of a per-row formatter; same English names.
    names = F.array(*[F.lit(m) for m in ALL_MONTHS])
    return F.when(c.isNull(), F.lit("Unknown")).otherwise(F.element_at(names, F.month(c)))


def year_or_zero(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(F.year(c), F.lit(0)).cast("int")


def tax_desc(cgst: Column | str, sgst: Column | str) -> Column:
    """'{cgst}% CGST, {sgst}% SGST' with Python float text ('9.0')."""
    a = F.col(cgst) if isinstance(cgst, str) else cgst
    b = F.col(sgst) if isinstance(sgst, str) else sgst
    return F.concat(round2(a).cast("string"), F.lit("% CGST, "), round2(b).cast("string"), F.lit("% SGST"))


def fiscal_year_label(ts: Column | str) -> Column:
    """April-March year label, e.g. 1995-05-01 -> '1995-96', 1996-02-01 -> '1995-96'."""
    c = F.col(ts) if isinstance(ts, str) else ts
    start = F.when(F.month(c) >= 4, F.year(c)).otherwise(F.year(c) - 1)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def month_ordinal(month_col: Column | str, order: list[str] = FISCAL_MONTHS) -> Column:
    """1-based position of a month name in ``order`` (0 when absent)."""
    c = F.col(month_col) if isinstance(month_col, str) else month_col
    return F.array_position(F.array(*[F.lit(m) for m in order]), c)


__all__ = [
    "ALL_MONTHS", "FISCAL_MONTHS", "excel_date", "month_name", "year_or_zero",
    "tax_desc", "fiscal_year_label", "month_ordinal", "number_text",
]
