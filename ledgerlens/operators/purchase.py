"""Purchase-line derivations, formula checks, rollups and vendor ranking.

SURVEY ids: P1 purchase_enrich, P2 purchase_project, P9 gst_check,
P10 disc_check, A1 purchase_rollup, A3 blocked_vendors, A19 dimension_values,
W1/W2 filter_dims.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import (
    ALL_MONTHS,
    blank_default,
    excel_date,
    money_sum,
    month_name,
    round2,
    safe_text,
    tax_desc,
    to_number,
    year_or_zero,
)

# The 20 workbook columns the purchase loader keeps.
USE_COLUMNS = [
    "bill no", "store code", "store name", "ordering channel", "source", "region",
    "product code", "product name", "product cgst rate", "product sgst rate",
    "product cgst amount", "product sgst amount", "net sale", "gross sale",
    "item price", "quantity", "marketing discount amount", "loyalty discount amount",
    "bill date time", "business day date",
]
# Which of them are text, and which are numbers.
TEXT_COLUMNS = [
    "bill no", "store code", "store name", "ordering channel", "source", "region",
    "product code", "product name",
]
NUMERIC_COLUMNS = [
    "product cgst rate", "product sgst rate", "product cgst amount", "product sgst amount",
    "net sale", "gross sale", "item price", "quantity",
    "marketing discount amount", "loyalty discount amount",
]
# Regions always offered by the dimension lists.
PROMINENT_REGIONS = ["Bangalore", "Mumbai", "Delhi NCR", "Hyderabad", "Chennai", "Kolkata", "Pune", "Ahmedabad"]

# Dimensions and measures of the rollup, columns of the purchase table.
DIMENSIONS = ["COMP_NM", "COMP_STATE", "PROD_NM", "CUST_NM", "CUST_STATE", "MONTH", "YEAR"]
MEASURES = ["INVOICE_AMT", "GST_AMT", "TOTAL_AMT", "DISCOUNT", "CALC_DISCOUNT", "DISC_DIFF"]
PURCHASE_COLUMNS = [
    "INVOICE_NO", "COMP_NM", "COMP_STATE", "PROD_NM", "PROD_CODE", "CUST_NM", "CUST_STATE",
    "MONTH", "YEAR", "GST_RATE", "TAX_DESC", "INVOICE_AMT", "GST_AMT", "TOTAL_AMT",
    "DISCOUNT", "CALC_DISCOUNT", "DISC_DIFF",
]
NUMBER_COLUMNS = ["GST_RATE"] + MEASURES


def normalize_columns(df: DataFrame) -> DataFrame:
    """S2 header rule: column names stripped and lower-cased (metadata only)."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def purchase_scan(df: DataFrame) -> DataFrame:
    """Keep the 20 workbook columns (missing ones become null)."""
    df = normalize_columns(df)
    present = set(df.columns)
    keep = [F.col(f"`{c}`") if c in present else F.lit(None).cast("string").alias(c) for c in USE_COLUMNS]
    extra = [F.col(c) for c in ("_ord", "_line", "_nationkey") if c in present]
    return df.select(*keep, *extra)


def purchase_enrich(raw: DataFrame) -> DataFrame:
    """All derived purchase columns, computed unrounded (as the reference does)."""
    df = purchase_scan(raw)
    types = {f.name: f.dataType for f in df.schema.fields}
    text = {c: safe_text(F.col(f"`{c}`")) for c in TEXT_COLUMNS}
    num = {c: to_number(F.col(f"`{c}`")) if not _is_double(types[c]) else _clean_double(F.col(f"`{c}`"))
           for c in NUMERIC_COLUMNS}
    # A date column that the source lacks is read from the other one; a cell that is missing stays missing.
    given = [c.strip().lower() for c in raw.columns]
    bill_col = "bill date time" if "bill date time" in given else "business day date"
    day_col = "business day date" if "business day date" in given else "bill date time"
    day = excel_date(F.col(f"`{day_col}`"), types[day_col])
    made = measures(num)
    extra = [F.col(c) for c in ("_ord", "_line", "_nationkey") if c in df.columns]
    return df.select(
        *[text[c].alias(c) for c in TEXT_COLUMNS],
        *[num[c].alias(c) for c in NUMERIC_COLUMNS],
        excel_date(F.col(f"`{bill_col}`"), types[bill_col]).alias("bill date time"),
        day.alias("business day date"),
        month_name(day).alias("MONTH"),
        year_or_zero(day).alias("YEAR"),
        made["GST_RATE"].alias("GST_RATE"),
        tax_desc(num["product cgst rate"], num["product sgst rate"]).alias("TAX_DESC"),
        *[made[c].alias(c) for c in MEASURES],
        blank_default(text["store name"], "Unknown Store").alias("COMP_NM"),
        blank_default(text["region"], "Unknown").alias("COMP_STATE"),
        blank_default(text["ordering channel"], "Unknown").alias("CUST_NM"),
        blank_default(text["source"], "Unknown").alias("CUST_STATE"),
        blank_default(text["product name"], "Unknown Product").alias("PROD_NM"),
        blank_default(text["product code"], "Unknown").alias("PROD_CODE"),
        *extra,
    )


def measures(num: dict[str, Column]) -> dict[str, Column]:
    """The rate and the measures of P1, unrounded, from the workbook's numbers."""
    discount = num["marketing discount amount"] + num["loyalty discount amount"]
    calculated = num["item price"] * num["quantity"] - num["net sale"]
    return {
        "GST_RATE": num["product cgst rate"] + num["product sgst rate"],
        "INVOICE_AMT": num["net sale"],
        "GST_AMT": num["product cgst amount"] + num["product sgst amount"],
        "TOTAL_AMT": num["gross sale"],
        "DISCOUNT": discount,
        "CALC_DISCOUNT": calculated,
        "DISC_DIFF": discount - calculated,
    }


def _is_double(dtype) -> bool:
    return dtype.typeName() in ("double", "float", "integer", "long", "short", "decimal")


def _clean_double(col: Column) -> Column:
    """Numeric input column: null / NaN -> 0.0."""
    return F.nanvl(F.coalesce(col.cast("double"), F.lit(0.0)), F.lit(0.0))


def purchase_project(enriched: DataFrame, keep_order: bool = False) -> DataFrame:
    """The published purchase table -- renamed, measures rounded to 2.

    ``enriched`` is P1's output, whose texts are stripped already.
    """
    cols = [F.col("`bill no`").alias("INVOICE_NO")]
    cols += [F.col(c) for c in ["COMP_NM", "COMP_STATE", "PROD_NM", "PROD_CODE", "CUST_NM", "CUST_STATE", "MONTH"]]
    cols.append(F.col("YEAR").cast("int").alias("YEAR"))
    cols.append(round2(F.col("GST_RATE")).alias("GST_RATE"))
    cols.append(F.col("TAX_DESC"))
    for c in MEASURES:
        cols.append(round2(F.nanvl(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))).alias(c))
    if keep_order and "_ord" in enriched.columns:
        cols.append(F.col("_ord"))
    return enriched.select(*cols)


def purchases(raw: DataFrame, keep_order: bool = False) -> DataFrame:
    """P1 + P2 in one plan (a single projection over the scan)."""
    return purchase_project(purchase_enrich(raw), keep_order)


# ------------------------------------------------------------- checks --
def _status(diff: Column) -> Column:
    return F.when(F.abs(diff) < 1, F.lit("OK")).otherwise(F.lit("Error"))


def gst_check(purchases_df: DataFrame) -> DataFrame:
    """Expected GST from invoice amount and rate; |diff| < 1 is OK."""
    expected = round2(F.col("INVOICE_AMT") * F.col("GST_RATE") / 100)
    diff = round2(F.col("GST_AMT") - expected)
    return purchases_df.select(
        "INVOICE_NO", "INVOICE_AMT", "GST_RATE", "GST_AMT",
        expected.alias("EXPECTED_GST"), diff.alias("DIFF"), _status(diff).alias("STATUS"),
    )


def disc_check(purchases_df: DataFrame) -> DataFrame:
    """P10: discount vs price×quantity − net sale; |diff| < 1 is OK."""
    return purchases_df.select(
        "INVOICE_NO", "INVOICE_AMT", "DISCOUNT", "CALC_DISCOUNT", "DISC_DIFF",
        _status(F.col("DISC_DIFF")).alias("STATUS"),
    )


def check_summary(check_df: DataFrame) -> DataFrame:
    """Counts per STATUS of a formula check (map-side combined)."""
    return check_df.groupBy("STATUS").agg(F.count(F.lit(1)).alias("ROWS"))


# ------------------------------------------------------------ rollups --
def purchase_rollup(purchases_df: DataFrame) -> DataFrame:
    """A1: 7-dimension rollup (nulls kept as a group), 6 measures summed, round 2.

    Sums are exact (``money_sum``) so the result does not depend on partitioning;
    partial aggregation runs before the shuffle.
    """
    aggs = [round2(money_sum(F.col(m), 2)).alias(m) for m in MEASURES]
    return (
        purchases_df.groupBy(*DIMENSIONS)
        .agg(*aggs)
        .select(
            F.lit("Aggregated purchase data").alias("INVOICE_NO"),
            *DIMENSIONS,
            F.lit(0.0).alias("GST_RATE"),
            F.lit("").alias("TAX_DESC"),
            *MEASURES,
        )
    )


def blocked_vendors(enriched: DataFrame, ord_col: str = "_ord", n: int = 4) -> DataFrame:
    """A3: vendors with the highest discount / invoice ratio (top ``n``).

    ``enriched`` carries unrounded measures (P1 output).  The first invoice
    per vendor is the one with the smallest ``ord_col`` (source order).
    """
    stats = enriched.groupBy("COMP_NM").agg(
        money_sum(F.col("DISCOUNT"), 4, wide=True).alias("disc"),
        money_sum(F.col("INVOICE_AMT"), 4, wide=True).alias("inv"),
        F.min(F.struct(F.col(ord_col), F.col("`bill no`"))).getField("bill no").alias("INV_NO"),
    )
    ratio = F.when(F.col("inv") == 0, F.lit(0.0)).otherwise(F.col("disc") / F.col("inv"))
    return (
        stats.filter(F.col("COMP_NM") != "")
        .select(
            F.col("COMP_NM").alias("VENDOR"),
            F.lit("High discount ratio / unusual pricing").alias("REASON"),
            "INV_NO",
            round2(F.col("inv")).alias("AMT"),
            ratio.alias("RATIO"),
        )
        .orderBy(F.desc("RATIO"), F.asc("VENDOR"))
        .limit(n)
        .drop("RATIO")
    )


def dimension_values(purchases_df: DataFrame) -> DataFrame:
    """Filter-list values per dimension as (DIMENSION, VALUE) rows.

    companies / products / customers: distinct values; states: the fixed
    regions ∪ distinct non-blank, non-'Unknown' regions; months: fixed 12.
    One shuffle (distinct over an exploded projection).
    """
    spark = purchases_df.sparkSession
    pairs = F.array(
        F.struct(F.lit("companies").alias("DIMENSION"), F.col("COMP_NM").alias("VALUE")),
        F.struct(F.lit("products").alias("DIMENSION"), F.col("PROD_NM").alias("VALUE")),
        F.struct(F.lit("customers").alias("DIMENSION"), F.col("CUST_NM").alias("VALUE")),
        F.struct(F.lit("states").alias("DIMENSION"),
                 F.when((F.col("COMP_STATE") != "") & (F.col("COMP_STATE") != "Unknown"),
                        F.col("COMP_STATE")).alias("VALUE")),
    )
    observed = (
        purchases_df.select(F.explode(pairs).alias("p"))
        .select("p.DIMENSION", "p.VALUE")
        .filter(F.col("VALUE").isNotNull())
    )
    fixed = spark.createDataFrame(
        [("states", r) for r in PROMINENT_REGIONS] + [("months", m) for m in ALL_MONTHS],
        "DIMENSION string, VALUE string",
    )
    return observed.unionByName(fixed).distinct()


# ------------------------------------------------------------- filters --
def filter_dims(df: DataFrame, filters: dict[str, list] | None = None) -> DataFrame:
    """AND of IN-lists per dimension; an empty list is no restriction.

    Keys may be the UI names (company, state, product, customer, month) or
    column names.  The predicate is a plain ``isin`` so it pushes into scans.
    """
    names = {"company": "COMP_NM", "state": "COMP_STATE", "product": "PROD_NM",
             "customer": "CUST_NM", "month": "MONTH"}
    preds = [F.col(names.get(k, k)).isin(list(v)) for k, v in (filters or {}).items() if v]
    if not preds:
        return df
    return df.filter(reduce(lambda a, b: a & b, preds))


__all__ = [
    "USE_COLUMNS", "PURCHASE_COLUMNS", "DIMENSIONS", "MEASURES", "PROMINENT_REGIONS",
    "normalize_columns", "purchase_scan", "purchase_enrich", "purchase_project", "purchases",
    "gst_check", "disc_check", "check_summary", "purchase_rollup", "blocked_vendors",
    "dimension_values", "filter_dims",
]
