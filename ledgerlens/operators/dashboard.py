"""Dashboard aggregates over the purchase rollup.

Inputs are the A1 rollup (or any table with the T1 columns).  Every
aggregate is a single ``groupBy`` with exact decimal sums; top-k uses
``orderBy().limit()`` (TakeOrderedAndProject: a per-partition top-k, then
one merge of k rows per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import ALL_MONTHS, FISCAL_MONTHS, money_sum, month_ordinal, round2


def _money_sum(c: str) -> Column:
    # Dashboard groups (month, company, label, global) are large: wide accumulator.
    return round2(money_sum(F.col(c), 2, wide=True))


def _months(spark, order: list[str]) -> DataFrame:
    """Fixed 12-row month dimension (literal, so broadcasting it is bounded)."""
    return spark.createDataFrame([(m, i + 1) for i, m in enumerate(order)], "MONTH string, MONTH_NO int")


def monthly_purchase(rollup: DataFrame) -> DataFrame:
    """Σ invoice amount per calendar month, all 12 months (zero-filled)."""
    sums = rollup.groupBy("MONTH").agg(_money_sum("INVOICE_AMT").alias("PURCHASE"))
    months = F.broadcast(_months(rollup.sparkSession, ALL_MONTHS))
    return months.join(sums, "MONTH", "left").select(
        "MONTH", "MONTH_NO", F.coalesce(F.col("PURCHASE"), F.lit(0.0)).alias("PURCHASE")
    )


def pie_top(rollup: DataFrame, dimension: str, n: int = 8) -> DataFrame:
    """Σ amount per dimension value (blank -> 'Unknown'), top ``n``, share of the top-n total.

    The share window runs over the ``n`` selected rows only.
    """
    raw = F.col(dimension)
    numeric = dict(rollup.dtypes)[dimension] not in ("string",)
    falsy = raw.isNull() | ((raw == 0) if numeric else (raw == ""))  # JS `value || 'Unknown'`
    key = F.when(falsy, F.lit("Unknown")).otherwise(raw.cast("string"))
    top = (
        rollup.groupBy(key.alias("LABEL"))
        .agg(_money_sum("INVOICE_AMT").alias("AMOUNT"), F.count(F.lit(1)).alias("ROWS"))
        .orderBy(F.desc("AMOUNT"), F.asc("LABEL"))
        .limit(n)
    )
    from pyspark.sql.window import Window

    total = F.sum(F.col("AMOUNT").cast("decimal(18,2)")).over(Window.partitionBy(F.lit(1))).cast("double")
    share = F.floor(F.try_divide(F.col("AMOUNT"), total) * 1000 + 0.5) / 10
    return top.select("LABEL", "AMOUNT", "ROWS", share.alias("SHARE_PCT"))


def month_trend(rollup: DataFrame) -> DataFrame:
    """Per month in fiscal order (Apr..Mar), months with rows only: Σ amt, Σ gst, count."""
    g = rollup.filter(F.col("MONTH").isin(FISCAL_MONTHS)).groupBy("MONTH").agg(
        _money_sum("INVOICE_AMT").alias("AMOUNT"),
        _money_sum("GST_AMT").alias("GST"),
        F.count(F.lit(1)).alias("ROWS"),
    )
    return g.select("MONTH", month_ordinal(F.col("MONTH")).alias("FISCAL_NO"), "AMOUNT", "GST", "ROWS")


def company_bar(rollup: DataFrame) -> DataFrame:
    """Per company Σ amount, rows, Σ GST and average amount per row; the largest amount first."""
    g = rollup.groupBy("COMP_NM").agg(
        money_sum(F.col("INVOICE_AMT"), 2, wide=True).alias("amt"),
        _money_sum("GST_AMT").alias("GST"),
        F.count(F.lit(1)).alias("ROWS"),
    )
    amount = round2(F.col("amt").cast("double"))
    return g.select(
        "COMP_NM", amount.alias("AMOUNT"), "ROWS", "GST",
        round2(F.col("amt").cast("double") / F.col("ROWS")).alias("AVG_AMOUNT"),
    ).orderBy(F.desc("AMOUNT"), "COMP_NM")


def ai_kpis(rollup: DataFrame) -> DataFrame:
    """Σ amount, Σ GST, distinct companies, rows, amount per row."""
    g = rollup.agg(
        money_sum(F.col("INVOICE_AMT"), 2, wide=True).alias("amt"),
        _money_sum("GST_AMT").alias("TOTAL_GST"),
        F.count_distinct("COMP_NM").alias("COMPANIES"),
        F.count(F.lit(1)).alias("ROWS"),
    )
    rows = F.when(F.col("ROWS") == 0, F.lit(1)).otherwise(F.col("ROWS"))
    return g.select(
        round2(F.coalesce(F.col("amt"), F.lit(0)).cast("double")).alias("TOTAL_AMOUNT"),
        F.coalesce(F.col("TOTAL_GST"), F.lit(0.0)).alias("TOTAL_GST"),
        "COMPANIES", "ROWS",
        round2(F.coalesce(F.col("amt"), F.lit(0)).cast("double") / rows).alias("AVG_PER_ROW"),
    )


def purchase_register(rollup: DataFrame, n: int = 100) -> DataFrame:
    """First ``n`` rollup rows (dimension order) with a 'MONTH YEAR' period."""
    order = ["COMP_NM", "COMP_STATE", "PROD_NM", "CUST_NM", "CUST_STATE", "MONTH", "YEAR"]
    return rollup.orderBy(*[F.asc_nulls_first(c) for c in order]).limit(n).select(
        "INVOICE_NO", "COMP_NM", "PROD_NM", "YEAR", "MONTH",
        F.concat_ws(" ", F.col("MONTH"), F.col("YEAR").cast("string")).alias("PERIOD"),
        "CUST_NM", "INVOICE_AMT", "GST_AMT", "TOTAL_AMT",
    )
