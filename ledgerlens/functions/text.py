"""Text cleaning and key-building expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Python's str.strip() removes every character for which str.isspace() is
# true (Java's \s covers only ASCII).  This is that set, used with
# ``btrim`` so strip() below removes exactly what Python's strip() removes.
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(_c(col).cast("string"), F.lit(PY_WHITESPACE_CHARS))


def strip_mostly_clean(col: Column | str) -> Column:
    """``strip`` for texts that seldom have white space at their ends.

    ``btrim`` with a set of characters measures every character of a text, so
    it is left to the texts that begin or end with anything but visible ASCII.
    The longer expression is not for plans that clean dozens of columns: their
    generated code would grow too large to compile.
    """
    text = _c(col).cast("string")
    clean = F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)
    return F.when(clean, text).otherwise(strip(text))


def safe_value(col: Column | str) -> Column:
    """null -> '', else stripped text; the word 'nan' (any case) -> ''."""
    # A comparison, not a regex: ~6x cheaper per value.  Whole-stage
    # codegen evaluates the shared trimmed value once.
    s = F.coalesce(strip(col), F.lit(""))
    return F.when(F.lower(s) == "nan", F.lit("")).otherwise(s)


def safe_values(columns: list[Column | str]) -> Column:
    """F1 for many columns at once: an array of their cleaned values, in their order.

    One function goes over the array, so the generated code stays small however
    many columns there are, and clean texts skip ``btrim`` at little cost.
    """
    stripped = F.transform(F.array(*[_c(c).cast("string") for c in columns]), lambda x: F.coalesce(strip_mostly_clean(x), F.lit("")))
    return F.transform(stripped, lambda x: F.when((F.octet_length(x) == 3) & (F.lower(x) == "nan"), F.lit("")).otherwise(x))


def safe_text(col: Column | str, default: str = "") -> Column:
    """null -> default, else stripped text (does not blank 'nan')."""
    return F.coalesce(strip_mostly_clean(col), F.lit(default))


def blank_default(col: Column | str, default: str) -> Column:
    """Empty string -> default (pandas ``replace('', default)``)."""
    c = _c(col)
    return F.when(c == "", F.lit(default)).otherwise(c)


def first_nonblank(*cols: Column, default: str | None = None) -> Column:
    """Python ``a or b or default`` over already-cleaned text columns."""
    parts = [F.nullif(c, F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def canonical_header_name(name: str) -> str:
    """F6 for column names (schema metadata, evaluated on the driver)."""
    return re.sub(r"[^a-zA-Z0-9]+", "", str(name)).lower()


def audit_header_name(name: str) -> str:
    """Audit-trail header key: lower-case first, then drop non [a-z0-9]."""
    return re.sub(r"[^a-z0-9]+", "", str(name).strip().lower())


def canonical_header(col: Column | str) -> Column:
    """F6 as a column expression."""
    return F.lower(F.regexp_replace(_c(col), "[^A-Za-z0-9]+", ""))


def slug(col: Column | str) -> Column:
    """runs of non-alphanumerics -> '_', edges trimmed of '_', lower-cased."""
    s = F.regexp_replace(_c(col), "[^a-zA-Z0-9]+", "_")
    return F.lower(F.regexp_replace(s, "^_+|_+$", ""))


def python_title(col: Column | str) -> Column:
    """Python ``str.title()``: upper-case each letter run's first letter.

    Spark's ``initcap`` only starts a word after a space ("o'neil" ->
    "O'neil"); Python starts one after any non-letter ("O'Neil", "3M").
    Putting a marker + space after every non-letter makes ``initcap`` see
    those word starts; the markers are removed afterwards.  No lambda, so
    the expression stays inside whole-stage codegen.
    """
    marked = F.regexp_replace(F.lower(_c(col)), "([^\\p{L}])", "$1\uE000 ")
    return F.regexp_replace(F.initcap(marked), "\uE000 ", "")


# Vendor spellings the audit-trail loader keeps verbatim
# (lower-cased input -> display form).
VENDOR_FIXED_SPELLINGS = {
    "axis bank": "Axis Bank",
    "qatar bank": "Qatar Bank",
    "hdfc bank limited": "HDFC Bank Limited",
}


def vendor_title_case(col: Column | str) -> Column:
    """F8: three fixed spellings, blank/'Unspecified' -> 'Unspecified', else title()."""
    c = _c(col)
    low = F.lower(c)
    out = F.when(F.lit(False), F.lit(None))
    for key, value in VENDOR_FIXED_SPELLINGS.items():
        out = out.when(low == key, F.lit(value))
    return (
        out.when((c == "") | (c == "Unspecified") | c.isNull(), F.lit("Unspecified"))
        .otherwise(python_title(c))
    )


def issue_slug(col: Column | str) -> Column:
    """lower-case, whitespace runs -> '-'."""
    return F.regexp_replace(F.lower(_c(col)), "\\s+", "-")


def plus_to_comma(col: Column | str) -> Column:
    """'+' separators in value lists shown as ', '."""
    return F.replace(_c(col), F.lit("+"), F.lit(", "))


def entity_key(title: Column | str, table_name: Column | str, row_num: Column | str) -> Column:
    """Blank key -> slug(title or table_name or 'row-N'); empty slug -> 'row-N'."""
    fallback = F.concat(F.lit("row-"), _c(row_num).cast("string"))
    base = first_nonblank(_c(title), _c(table_name))
    base = F.coalesce(base, fallback)
    s = slug(base)
    return F.when(s == "", fallback).otherwise(s)
