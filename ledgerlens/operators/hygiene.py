"""Master-data hygiene checks (A4-A8 server form, H1-H5 filtered form, J4, P8).

Checks are one ``groupBy`` each with map-side partial aggregation.  Lists of
rates come from ``collect_set`` (rates have two decimals).  Lists of codes are
not bounded: A5 and A6 show three, and H3 and H5, which show all, come in two
forms, one row per issue as the report has it, and numbered chunks of bounded
size (``prod_name_chunks``, ``dup_customers_chunks``), which hold no name in
one task.  Lists are emitted sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import number_text, rate_list, round2, strip
from ledgerlens.operators.ranks import ranked_in_groups


def _count() -> Column:
    return F.count(F.lit(1)).alias("COUNT")


def _nonblank_set(col: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(col != "", col)))


# ------------------------------------------------------- server (A4-A8) --
def multi_tax(enriched: DataFrame) -> DataFrame:
    """A4: product codes with >1 distinct rate (rounded to 2) or >1 tax description."""
    g = enriched.groupBy("PROD_CODE").agg(
        F.array_sort(F.collect_set(round2(F.col("GST_RATE")))).alias("rates"),
        _nonblank_set(strip(F.col("TAX_DESC"))).alias("descs"),
        _count(),
    )
    return g.filter((F.size("rates") > 1) | (F.size("descs") > 1)).select(
        "PROD_CODE",
        rate_list(F.col("rates")).alias("GST_RATE"),
        F.array_join("descs", ", ").alias("TAX_DESC"),
        "COUNT",
    )


def _first_codes(enriched: DataFrame, key: str, code: Column, shown: int = 3) -> DataFrame:
    """(k, codes, n, COUNT): per key its number of distinct non-blank codes and the first ``shown`` of them.

    Rows are reduced to (key, code) pairs first, so a key with a third of all
    rows is spread over its codes; the rank filter keeps ``shown`` pairs per
    key and task before anything is gathered by key.
    """
    pairs = enriched.groupBy(F.col(key).alias("k"), F.nullif(code, F.lit("")).alias("code")).agg(F.count(F.lit(1)).alias("rows"))
    totals = pairs.groupBy("k").agg(F.count("code").alias("n"), F.sum("rows").alias("COUNT")).filter("n > 1")
    # Both branches use all columns of the pairs and filter none of their keys, so that the pairs are made once.
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.asc_nulls_last("code")))
    first = pairs.withColumn("place", rank).filter(F.col("place") <= shown)
    lists = first.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("code", "rows"))).alias("first"))
    codes = F.array_join(F.transform("first", lambda pair: pair["code"]), ", ")
    return totals.join(lists, "k").select("k", codes.alias("codes"), "COUNT")


def dup_customers(enriched: DataFrame) -> DataFrame:
    """A5: companies with >1 distinct non-blank store code; first 3 codes shown."""
    g = _first_codes(enriched, "COMP_NM", strip(F.col("`store code`")))
    return g.select(F.col("k").alias("CUST_NM"), F.col("codes").alias("CUST_CD"), "COUNT")


def prod_name_issues(enriched: DataFrame) -> DataFrame:
    """Product names carrying >1 product code; first 3 codes shown."""
    g = _first_codes(enriched, "PROD_NM", strip(F.col("PROD_CODE")))
    return g.select(F.col("k").alias("PROD_NM"), F.col("codes").alias("PROD_CODE"), "COUNT")


def prod_gst_issues(enriched: DataFrame) -> DataFrame:
    """Product names with >1 distinct rate (rounded to 2)."""
    g = enriched.groupBy("PROD_NM").agg(F.array_sort(F.collect_set(round2(F.col("GST_RATE")))).alias("rates"), _count())
    return g.filter(F.size("rates") > 1).select("PROD_NM", rate_list(F.col("rates")).alias("GST_RATE"), "COUNT")


def prod_code_check(enriched: DataFrame) -> DataFrame:
    """Blank code -> 'Missing code'; a code used for >1 product name -> 'Multiple products'."""
    code = strip(F.col("PROD_CODE"))
    g = enriched.groupBy(code.alias("code")).agg(
        F.count_distinct(F.when(strip(F.col("PROD_NM")) != "", strip(F.col("PROD_NM")))).alias("names")
    )
    return g.filter((F.col("code") == "") | (F.col("names") > 1)).select(
        F.when(F.col("code") == "", F.lit("Unknown")).otherwise(F.col("code")).alias("PROD_CODE"),
        F.when(F.col("code") == "", F.lit("Missing code")).otherwise(F.lit("Multiple products")).alias("STATUS"),
    )


# ---------------------------------------------- filtered form (H1-H5) --
def _js_text(col: Column, default: str) -> Column:
    """``String(v || default).trim() || default`` for text columns."""
    s = F.coalesce(strip(col.cast("string")), F.lit(""))
    return F.when(s == "", F.lit(default)).otherwise(s)


def _js_rate(col: Column) -> Column:
    """``String(rate || '')``: zero / null rate -> '' (JS falsy), else number text."""
    r = col.cast("double")
    return F.when(r.isNull() | (r == 0) | F.isnan(r), F.lit("")).otherwise(number_text(r))


def _issue(category: str, key: Column) -> list[Column]:
    return [
        F.concat(F.lit(category + ":"), key).alias("ISSUE_ID"),
        F.lit(category).alias("CATEGORY"),
        key.alias("ENTITY_KEY"),
    ]


def _sorted_rates(arr: Column) -> Column:
    """Rate texts ('' removed) sorted numerically, joined with ', '."""
    nums = F.transform(F.filter(arr, lambda s: s != ""), lambda s: s.cast("double"))
    return rate_list(nums)


def multi_tax_filtered(rows: DataFrame) -> DataFrame:
    """H1: zero rate is blank and not counted; keyed output."""
    code = _js_text(F.col("PROD_CODE"), "Unknown")
    rate = _js_rate(F.col("GST_RATE"))
    desc = F.coalesce(strip(F.col("TAX_DESC")), F.lit(""))
    g = rows.groupBy(code.alias("k")).agg(
        F.collect_set(F.when(rate != "", rate)).alias("rates"),
        _nonblank_set(desc).alias("descs"),
        _count(),
    )
    return g.filter((F.size("rates") > 1) | (F.size("descs") > 1)).select(
        *_issue("multi_tax", F.col("k")),
        _sorted_rates(F.col("rates")).alias("GST_RATE"),
        F.array_join("descs", ", ").alias("TAX_DESC"),
        "COUNT",
    )


def prod_gst_filtered(rows: DataFrame) -> DataFrame:
    """H2: a zero rate counts as a distinct value ('') but is not printed."""
    name = _js_text(F.col("PROD_NM"), "Unknown Product")
    g = rows.groupBy(name.alias("k")).agg(F.collect_set(_js_rate(F.col("GST_RATE"))).alias("rates"), _count())
    return g.filter(F.size("rates") > 1).select(
        *_issue("prod_gst", F.col("k")), F.col("k").alias("PROD_NM"),
        _sorted_rates(F.col("rates")).alias("GST_RATE"), "COUNT",
    )


def prod_name_filtered(rows: DataFrame) -> DataFrame:
    """H3: product names with >1 code; all codes listed."""
    name = _js_text(F.col("PROD_NM"), "Unknown Product")
    code = _js_text(F.col("PROD_CODE"), "Unknown")
    g = rows.groupBy(name.alias("k")).agg(F.array_sort(F.collect_set(code)).alias("codes"), _count())
    return g.filter(F.size("codes") > 1).select(
        *_issue("prod_name", F.col("k")), F.col("k").alias("PROD_NM"),
        F.array_join("codes", ", ").alias("PROD_CODE"), "COUNT",
    )


def prod_code_filtered(rows: DataFrame) -> DataFrame:
    """H4: code 'Unknown' always 'Missing code'; others with >1 name 'Multiple products'."""
    code = _js_text(F.col("PROD_CODE"), "Unknown")
    name = _js_text(F.col("PROD_NM"), "Unknown Product")
    g = rows.groupBy(code.alias("k")).agg(F.count_distinct(name).alias("names"))
    missing = F.col("k") == "Unknown"
    return g.filter(missing | (F.col("names") > 1)).select(
        *_issue("prod_code", F.col("k")), F.col("k").alias("PROD_CODE"),
        F.when(missing, F.lit("Missing code")).otherwise(F.lit("Multiple products")).alias("STATUS"),
    )


def dup_customers_filtered(rows: DataFrame) -> DataFrame:
    """H5: customer names (CUST_NM) seen with >1 CUST_STATE; all codes listed."""
    name = _js_text(F.col("CUST_NM"), "Unknown")
    code = _js_text(F.col("CUST_STATE"), "Unknown")
    g = rows.groupBy(name.alias("k")).agg(F.array_sort(F.collect_set(code)).alias("codes"), _count())
    return g.filter(F.size("codes") > 1).select(
        *_issue("dup_cust", F.col("k")), F.col("k").alias("CUST_NM"),
        F.array_join("codes", ", ").alias("CUST_CD"), "COUNT",
    )


def _in_chunks(rows: DataFrame, category: str, key: Column, code: Column, shown: str, listed: str, size: int) -> DataFrame:
    """Issues of ``key`` with more than one ``code``: all codes, in numbered lists of ``size`` codes.

    Rows become (key, code) pairs first.  Pairs are ranked by ranges, so that
    neither the rows nor the codes of one key meet in one task or one list.
    """
    pairs = rows.groupBy(key.alias("k"), code.alias("code")).agg(F.count(F.lit(1)).alias("rows"))
    ranked = ranked_in_groups(pairs, ["k"], ["code"])
    lists = ranked.groupBy("k", F.floor(F.col("place") / size).alias("CHUNK")).agg(
        F.array_sort(F.collect_list("code")).alias("held"), F.sum("rows").alias("rows"))
    totals = lists.groupBy("k").agg(F.sum(F.size("held")).alias("CODES"), F.sum("rows").alias("COUNT")).filter("CODES > 1")
    return lists.drop("rows").join(totals, "k").select(
        *_issue(category, F.col("k")), F.col("k").alias(shown), F.col("CHUNK").cast("long").alias("CHUNK"),
        F.array_join("held", ", ").alias(listed), "CODES", "COUNT")


def prod_name_chunks(rows: DataFrame, size: int = 1000) -> DataFrame:
    """H3 in chunks: product names with >1 code, ``size`` codes a row, numbered from 0."""
    return _in_chunks(rows, "prod_name", _js_text(F.col("PROD_NM"), "Unknown Product"), _js_text(F.col("PROD_CODE"), "Unknown"),
                      "PROD_NM", "PROD_CODE", size)


def dup_customers_chunks(rows: DataFrame, size: int = 1000) -> DataFrame:
    """H5 in chunks: customer names with >1 CUST_STATE, ``size`` states a row, numbered from 0."""
    return _in_chunks(rows, "dup_cust", _js_text(F.col("CUST_NM"), "Unknown"), _js_text(F.col("CUST_STATE"), "Unknown"),
                      "CUST_NM", "CUST_CD", size)


FILTERED_CHECKS = {
    "multi_tax": multi_tax_filtered,
    "prod_gst": prod_gst_filtered,
    "prod_name": prod_name_filtered,
    "prod_code": prod_code_filtered,
    "dup_cust": dup_customers_filtered,
}


def with_remarks(issues: DataFrame, remarks: DataFrame) -> DataFrame:
    """Each issue left-joined to its saved remark ('' when none).

    ``remarks`` is the compacted remark table (one row per issue id).  The
    planner sizes the join at runtime (AQE); nothing is force-broadcast.
    """
    r = remarks.select(F.col("issue_id").alias("ISSUE_ID"), F.col("remark").alias("_remark"))
    return issues.join(r, "ISSUE_ID", "left").withColumn(
        "REMARK", F.coalesce(F.col("_remark"), F.lit(""))
    ).drop("_remark")


# Export layouts (header label, column) per hygiene category.
EXPORT_LAYOUTS = {
    "multi_tax": [("GST Rate (%)", "GST_RATE"), ("Tax Description", "TAX_DESC"), ("Count", "COUNT"), ("Remark", "REMARK")],
    "prod_gst": [("Product Name", "PROD_NM"), ("GST Rate (%)", "GST_RATE"), ("Count", "COUNT"), ("Remark", "REMARK")],
    "dup_cust": [("Customer Name", "CUST_NM"), ("Customer Code", "CUST_CD"), ("Count", "COUNT"), ("Remark", "REMARK")],
    "prod_name": [("Product Name", "PROD_NM"), ("Product Code", "PROD_CODE"), ("Count", "COUNT"), ("Remark", "REMARK")],
    "prod_code": [("Product Code", "PROD_CODE"), ("Status", "STATUS"), ("Remark", "REMARK")],
}


def export_frame(issues: DataFrame, category: str) -> DataFrame:
    """K8 projection: labelled columns; a null STATUS reads 'Not in Master'."""
    cols = []
    for label, key in EXPORT_LAYOUTS[category]:
        c = F.col(key)
        if key == "STATUS":
            c = F.coalesce(c, F.lit("Not in Master"))
        cols.append(c.alias(label))
    return issues.select(*cols)


# When a row of a hygiene or bank summary is marked, by category.
_MARKED = {
    "multi_tax": lambda: F.col("COUNT") > 30,
    "prod_name": lambda: F.col("COUNT") <= 3,
    "dup_cust": lambda: F.col("COUNT") == 1,
    "bank": lambda: F.col("BANK_COUNT") > 2,
}


def with_risk_flag(rows: DataFrame, category: str) -> DataFrame:
    """``RISK_FLAG`` marks the rows of a category that stand out by their count."""
    return rows.withColumn("RISK_FLAG", _MARKED[category]())
