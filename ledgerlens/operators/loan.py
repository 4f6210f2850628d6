"""Loan schedule comparison (J5, J6, W5, F16 display).

The calculated and bank schedules are joined on (person, month) -- an
equi-join both sides shuffle on the same key, so the plan is one exchange
per side and a sort-merge (or runtime broadcast) join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import inr, percent_int

LOAN_MEASURES = ["opening", "interest", "principal", "emi", "closing", "rate"]


def loan_diff(calc: DataFrame, bank: DataFrame) -> DataFrame:
    """Bank − calc for the six measures; a missing value counts as 0.

    Full outer join so a month present on one side only is still reported.
    ``DIFF_HIT`` flags rows with any non-zero difference, and months without
    a counterpart (P12).
    """
    c = calc.select("person", "month", *[F.col(m).alias(f"calc_{m}") for m in LOAN_MEASURES],
                    *([F.col("other_charge")] if "other_charge" in calc.columns else []))
    b = bank.select("person", "month", *[F.col(m).alias(f"bank_{m}") for m in LOAN_MEASURES])
    j = c.join(b, ["person", "month"], "full_outer")
    diffs = [
        F.coalesce(F.col(f"bank_{m}") - F.col(f"calc_{m}"), F.lit(0)).alias(f"diff_{m}") for m in LOAN_MEASURES
    ]
    out = j.select("*", *diffs)
    # A month that only one side has is the worst exception of all.
    hit = F.col("calc_opening").isNull() != F.col("bank_opening").isNull()
    for m in LOAN_MEASURES:
        hit = hit | (F.col(f"diff_{m}") != 0)
    return out.withColumn("DIFF_HIT", hit)


def with_loan_meta(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Borrower -> loan type / location (unknown borrower -> nulls).

    The meta table grows with the number of borrowers, so it is a plain
    join; AQE broadcasts it at runtime only when it is measured small.
    """
    return df.join(meta, "person", "left")


def filter_loan(df: DataFrame, loan_type: str | None = None, location: str | None = None) -> DataFrame:
    """Equality on type / location; borrowers without meta drop out when filtered."""
    if loan_type:
        df = df.filter(F.col("loan_type") == loan_type)
    if location:
        df = df.filter(F.col("location") == location)
    return df


def loan_display(diff: DataFrame) -> DataFrame:
    """F13 / F16 display columns for the comparison table."""
    cols = [F.col("person"), F.col("month")]
    for side in ("calc", "bank"):
        for m in LOAN_MEASURES:
            c = F.col(f"{side}_{m}")
            text = percent_int(c) if m == "rate" else F.when(c.isNull(), F.lit("—")).otherwise(inr(c))
            cols.append(text.alias(f"{side}_{m}_text"))
    for m in LOAN_MEASURES:
        c = F.col(f"diff_{m}")
        cols.append((percent_int(c, null_dash=False) if m == "rate" else inr(c)).alias(f"diff_{m}_text"))
    return diff.select(*cols, "DIFF_HIT")
