"""Scalar column expressions.  All JVM-side, codegen-friendly."""

from ledgerlens.functions.dates import (
    ALL_MONTHS,
    FISCAL_MONTHS,
    excel_date,
    fiscal_year_label,
    month_name,
    month_ordinal,
    tax_desc,
    year_or_zero,
)
from ledgerlens.functions.numbers import (
    money_sum,
    inr,
    inr_crore,
    inr_short,
    js_round,
    number_text,
    percent_int,
    percent_list,
    rate_list,
    round1,
    round2,
    round_half_even,
    to_number,
)
from ledgerlens.functions.text import (
    audit_header_name,
    blank_default,
    canonical_header,
    canonical_header_name,
    entity_key,
    first_nonblank,
    issue_slug,
    plus_to_comma,
    python_title,
    safe_text,
    safe_value,
    safe_values,
    slug,
    strip,
    vendor_title_case,
)

__all__ = [name for name in dir() if not name.startswith("_")]
