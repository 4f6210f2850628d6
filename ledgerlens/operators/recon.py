"""PO / GRN / bank reconciliation.

All "first row per invoice" logic is an aggregation (``min`` over a struct
led by the order column), never a window: aggregation combines map-side, so
an invoice with a third of all rows is reduced before the shuffle instead
of being sorted inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import money_sum, round1, round2


def invoice_rollup(enriched: DataFrame, line_col: str = "_line", extra: list[str] | None = None) -> DataFrame:
    """A2: one row per bill number -- values of its first line, summed amount.

    Company, customer, month, year and the ``extra`` columns all come from the
    line with the smallest ``line_col`` (of lines that tie, the one with the
    smallest values).  The sum is exact (integer units, see ``money_sum``) and
    rounded half-even to 2 at the end.
    """
    carried = ["COMP_NM", "CUST_NM", "MONTH", "YEAR", *(extra or [])]
    g = enriched.groupBy(F.col("`bill no`").alias("INVOICE_NO")).agg(
        F.min(F.struct(F.col(line_col).alias("_line"), *carried)).alias("first"),
        round2(money_sum(F.col("INVOICE_AMT"), 4)).alias("INVOICE_AMT"),
    )
    return g.select("INVOICE_NO", *[F.col(f"first.{c}").alias(c) for c in carried[:4]], "INVOICE_AMT",
                    *[F.col(f"first.{c}").alias(c) for c in carried[4:]])


def invoice_universe(po: DataFrame, grn: DataFrame, bank: DataFrame) -> DataFrame:
    """Distinct invoice numbers across the three tables."""
    return (
        po.select("INVOICE_NO")
        .unionByName(grn.select("INVOICE_NO"))
        .unionByName(bank.select("INVOICE_NO"))
        .distinct()
    )


def three_way_match(po: DataFrame, grn: DataFrame, bank: DataFrame, limit: int | None = 45,
                    ord_col: str = "ORD") -> DataFrame:
    """PO vs GRN vs bank per invoice, first row of each side.

    Union of the three tagged inputs + one ``groupBy(INVOICE_NO)``: a single
    shuffle, partial aggregation, no full-outer-join chain.  MATCH depends
    on GRN and bank presence only (PO and amounts are ignored).  The month
    of the PO is carried so a month filter works (W3).
    """
    null_s = F.lit(None).cast("string")

    def side(df: DataFrame, tag: int, no: str, amt: str, extra: dict[str, Column]) -> DataFrame:
        cols = {
            "INVOICE_NO": F.col("INVOICE_NO"),
            "src": F.lit(tag),
            "ord": F.col(ord_col).cast("long"),
            "comp": F.col("COMP_NM"),
            "no": F.col(no).cast("string"),
            "amt": F.col(amt).cast("double"),
            "month": extra.get("month", null_s),
            "year": extra.get("year", F.lit(None).cast("int")),
        }
        return df.select(*[v.alias(k) for k, v in cols.items()])

    u = (
        side(po, 0, "PO_NO", "AMT", {"month": F.col("MONTH"), "year": F.col("YEAR").cast("int")})
        .unionByName(side(grn, 1, "GRN_NO", "AMT", {}))
        .unionByName(side(bank, 2, "BANK", "AMT", {}))
    )

    def first_of(tag: int) -> Column:
        return F.min(F.when(F.col("src") == tag, F.struct("ord", "no", "amt", "comp", "month", "year")))

    g = u.groupBy("INVOICE_NO").agg(first_of(0).alias("p"), first_of(1).alias("g"), first_of(2).alias("b"))
    has_g, has_b = F.col("g").isNotNull(), F.col("b").isNotNull()
    out = g.select(
        "INVOICE_NO",
        F.coalesce(F.col("p.comp"), F.col("g.comp"), F.col("b.comp"), F.lit("-")).alias("COMP_NM"),
        F.coalesce(F.col("p.no"), F.lit("Missing")).alias("PO_NO"),
        F.coalesce(F.col("p.amt"), F.lit(0.0)).alias("PO_AMT"),
        F.coalesce(F.col("g.no"), F.lit("Missing")).alias("GRN_NO"),
        F.coalesce(F.col("g.amt"), F.lit(0.0)).alias("GRN_AMT"),
        F.coalesce(F.col("b.no"), F.lit("Missing")).alias("BANK"),
        F.coalesce(F.col("b.amt"), F.lit(0.0)).alias("BANK_AMT"),
        F.when(has_g & has_b, F.lit("✓ Match"))
        .when(has_g | has_b, F.lit("⚠ Partial"))
        .otherwise(F.lit("✗ Missing")).alias("MATCH"),
        F.col("p.month").alias("MONTH"),
        F.col("p.year").alias("YEAR"),
    )
    if limit is not None:
        out = out.orderBy("INVOICE_NO").limit(limit)
    return out


def display_diff(match: DataFrame) -> DataFrame:
    """GRN − bank amount, or 'Missing' when either is 0 / not finite."""
    g, b = F.col("GRN_AMT").cast("double"), F.col("BANK_AMT").cast("double")
    bad = g.isNull() | b.isNull() | F.isnan(g) | F.isnan(b) | (g == 0) | (b == 0)
    return match.withColumn("DIFF", F.when(bad, F.lit(None)).otherwise(round2(g - b))).withColumn(
        "DIFF_STATUS", F.when(bad, F.lit("Missing")).otherwise(F.lit("OK"))
    )


def grn_without_invoice(grn: DataFrame, po: DataFrame, limit: int | None = 15, ord_col: str = "ORD") -> DataFrame:
    """GRN rows whose invoice has no PO (hash anti join), first ``limit`` by source order."""
    out = grn.join(po.select("INVOICE_NO"), "INVOICE_NO", "left_anti")
    if limit is not None:
        out = out.orderBy(ord_col, "INVOICE_NO", "GRN_NO").limit(limit)
    return out


def open_po(po: DataFrame, grn: DataFrame, limit: int | None = 15, ord_col: str = "ORD") -> DataFrame:
    """PO rows whose invoice has no GRN, first ``limit`` by source order."""
    out = po.join(grn.select("INVOICE_NO"), "INVOICE_NO", "left_anti")
    if limit is not None:
        out = out.orderBy(ord_col, "INVOICE_NO", "PO_NO").limit(limit)
    return out


def bank_summary(bank: DataFrame) -> DataFrame:
    """Distinct banks per company -- count and sorted list.

    The list is bounded by the number of distinct banks, not by rows;
    ``collect_set`` is combined map-side.
    """
    return bank.groupBy("COMP_NM").agg(F.array_sort(F.collect_set("BANK")).alias("banks")).select(
        "COMP_NM", F.size("banks").alias("BANK_COUNT"), F.array_join("banks", ", ").alias("BANKS"),
    )


def pay_summary(bank: DataFrame, slow_days: float = 60) -> DataFrame:
    """A10 (+P12 flag): mean payment days per company (round 1) and row count."""
    avg = round1(F.avg(F.col("PAYMENT_DAYS").cast("double")))
    return bank.groupBy("COMP_NM").agg(avg.alias("AVG_DAYS"), F.count(F.lit(1)).alias("COUNT")).withColumn(
        "PAY_FLAG", F.when(F.col("AVG_DAYS") > slow_days, F.lit("Slow")).otherwise(F.lit("OK"))
    )


def po_kpis(match: DataFrame) -> DataFrame:
    """Invoice count and positive PO / GRN / bank totals, total PO."""
    def pos(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return money_sum(F.when(v > 0, v).otherwise(F.lit(0.0)), 2, wide=True)

    return match.agg(
        F.count(F.lit(1)).alias("TOTAL_INVOICES"),
        round2(pos("PO_AMT")).alias("INVOICE_AMOUNT"),
        round2(pos("GRN_AMT")).alias("GRN_AMOUNT"),
        round2(pos("BANK_AMT")).alias("BANK_AMOUNT"),
        round2(money_sum(F.coalesce(F.col("PO_AMT").cast("double"), F.lit(0.0)), 2, wide=True))
        .alias("TOTAL_PO_VALUE"),
    )


def match_counts(match: DataFrame) -> DataFrame:
    """Rows per MATCH status (for the reconciliation summary)."""
    return match.groupBy("MATCH").agg(F.count(F.lit(1)).alias("ROWS"))
