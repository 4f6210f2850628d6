"""Numeric coercion, rounding and money formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import strip


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_even(col: Column | str, digits: int = 2) -> Column:
    """NumPy/pandas ``round``: scale, round half to even, unscale.

    ``F.round`` is half-up on the decimal representation and differs on ties
    (0.125 -> 0.13); ``rint`` matches NumPy bit for bit.
    """
    scale = float(10 ** digits)
    return F.rint(_c(col).cast("double") * scale) / scale


def round2(col: Column | str) -> Column:
    return round_half_even(col, 2)


def round1(col: Column | str) -> Column:
    return round_half_even(col, 1)


def to_number(col: Column | str) -> Column:
    """``pd.to_numeric(errors='coerce').fillna(0)`` -- unparsable -> 0.0."""
    c = _c(col)
    parsed = strip(c).try_cast("double")
    return F.nanvl(F.coalesce(parsed, F.lit(0.0)), F.lit(0.0))


def money_sum(col: Column | str, scale: int = 2, wide: bool = False) -> Column:
    """Exact, order-independent sum of money values with ``scale`` decimals; double out.

    Values are summed as integer units of 10^-scale (a long accumulator --
    far cheaper than BigDecimal), and divided once at the end in decimal,
    so the result equals the decimal sum cast to double.  Under ANSI mode a
    long overflow raises instead of wrapping.  ``wide=True`` accumulates in
    decimal(38) instead: for groups whose total can approach 9e18 units
    (vendor / month / global totals at full scale).
    """
    if wide:
        return F.sum(_c(col).cast(f"decimal(18,{scale})")).cast("double")
    units = F.rint(_c(col).cast("double") * float(10 ** scale)).cast("long")
    return (F.sum(units).cast("decimal(38,0)") / F.lit(10 ** scale).cast("decimal(38,0)")).cast("double")


def number_text(col: Column | str) -> Column:
    """Python's ``str(int(r)) if r == int(r) else str(r)`` for a double."""
    c = _c(col)
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def rate_list(arr: Column | str) -> Column:
    """sorted numeric array -> '5, 12, 2.5' style text."""
    return F.array_join(F.transform(F.array_sort(_c(arr)), number_text), ", ")


def percent_list(col: Column | str) -> Column:
    """'5, 12' -> '5%, 12%' (items trimmed, blanks dropped, '%' not doubled)."""
    items = F.transform(F.split(F.coalesce(_c(col), F.lit("")), ","), lambda v: F.trim(v))
    items = F.filter(items, lambda v: v != "")
    items = F.transform(items, lambda v: F.when(v.endswith("%"), v).otherwise(F.concat(v, F.lit("%"))))
    return F.array_join(items, ", ")


def js_round(col: Column | str) -> Column:
    """JavaScript ``Math.round``: floor(x + 0.5)."""
    return F.floor(_c(col).cast("double") + F.lit(0.5))


def indian_grouping(int_col: Column) -> Column:
    """12345678 -> '1,23,45,678' (last three digits, then pairs)."""
    s = int_col.cast("string")
    return F.regexp_replace(s, "(?<=\\d)(?=(\\d\\d)+\\d$)", ",")


def inr(col: Column | str) -> Column:
    """rupee amount with Indian digit grouping; null/NaN -> 0."""
    v = F.nanvl(F.coalesce(_c(col).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.concat(F.lit("₹"), indian_grouping(js_round(v)))


def inr_short(col: Column | str) -> Column:
    """'Cr' from 1e7, 'L' from 1e5 (2 decimals), else full grouping."""
    v = js_round(F.nanvl(F.coalesce(_c(col).cast("double"), F.lit(0.0)), F.lit(0.0)))
    return (
        F.when(F.abs(v) >= 1e7, F.concat(F.lit("₹"), F.format_string("%.2f", v / 1e7), F.lit(" Cr")))
        .when(F.abs(v) >= 1e5, F.concat(F.lit("₹"), F.format_string("%.2f", v / 1e5), F.lit(" L")))
        .otherwise(F.concat(F.lit("₹"), indian_grouping(v)))
    )


def inr_crore(col: Column | str) -> Column:
    """always crores, 2 decimals, a trailing '.00' removed."""
    v = js_round(F.nanvl(F.coalesce(_c(col).cast("double"), F.lit(0.0)), F.lit(0.0)))
    text = F.regexp_replace(F.format_string("%.2f", v / 1e7), "\\.00$", "")
    return F.concat(F.lit("₹"), text, F.lit(" Cr"))


def percent_int(col: Column | str, null_dash: bool = True) -> Column:
    """F16: ``Math.round(v*100) + '%'``; null -> an em dash (or 0% for diffs)."""
    c = _c(col).cast("double")
    text = F.concat(js_round(F.coalesce(c, F.lit(0.0)) * 100).cast("string"), F.lit("%"))
    if null_dash:
        return F.when(c.isNull(), F.lit("—")).otherwise(text)
    return text
