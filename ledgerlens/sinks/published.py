"""The twelve published tables, and whether the stored ones still hold.

A publication is a folder of versions.  A version has a folder per table and a
manifest, written last: the input files it was made from (path, length, time of
change).  The highest version with a complete manifest counts.  It is read
again as long as the input files are those of the manifest; otherwise the
tables are made anew.  PO, GRN and bank rows are bucketed and sorted by
invoice, so that matching them needs no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import round2
from ledgerlens.operators import hygiene as H
from ledgerlens.operators import purchase as P
from ledgerlens.sinks.tables import child_names, compressed, exists, list_files, remove, set_within

# Columns of the published tables.
TABLE_COLUMNS = {
    "po": ["PO_NO", "INVOICE_NO", "COMP_NM", "CUST_NM", "AMT", "MONTH", "YEAR"],
    "grn": ["GRN_NO", "INVOICE_NO", "COMP_NM", "CUST_NM", "AMT"],
    "bank": ["BANK", "INVOICE_NO", "COMP_NM", "PAYMENT_DAYS", "AMT"],
    "blocked_vendors": ["VENDOR", "REASON", "INV_NO", "AMT"],
    "multi_tax": ["GST_RATE", "TAX_DESC", "COUNT"],
    "dup_customers": ["CUST_NM", "CUST_CD", "COUNT"],
    "prod_name_issues": ["PROD_NM", "PROD_CODE", "COUNT"],
    "prod_gst_issues": ["PROD_NM", "GST_RATE", "COUNT"],
    "prod_code_check": ["PROD_CODE", "STATUS"],
    "gst_check": ["INVOICE_NO", "INVOICE_AMT", "GST_RATE", "GST_AMT", "EXPECTED_GST", "DIFF", "STATUS"],
    "disc_check": ["INVOICE_NO", "INVOICE_AMT", "DISCOUNT", "CALC_DISCOUNT", "DISC_DIFF", "STATUS"],
}
#: Derived columns of the purchase table, after the workbook's own.
DERIVED = ["MONTH", "YEAR", "GST_RATE", "TAX_DESC", "INVOICE_AMT", "GST_AMT", "TOTAL_AMT", "DISCOUNT", "CALC_DISCOUNT", "DISC_DIFF",
           "COMP_NM", "COMP_STATE", "CUST_NM", "CUST_STATE", "PROD_NM", "PROD_CODE"]
ALL_TABLES = ["purchases", *TABLE_COLUMNS]
BY_INVOICE = ("po", "grn", "bank")
_VERSION = re.compile(r"v(\d{6})$")
#: While tables are written, a query's shuffle files go when it ends, not when the driver happens to collect its garbage; and a
#: bucketed table is read by its buckets, also where a table in the same buckets is all that is made from it.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
#: Named tables, or a function from those written so far to the next ones.
Tables = dict[str, DataFrame] | Callable[[dict[str, DataFrame]], Iterator[tuple[str, DataFrame]]]


def purchase_table(enriched: DataFrame) -> DataFrame:
    """The purchase lines as published: names in lower case with underscores, dates as text, measures rounded."""
    dates = {"bill date time": "yyyy-MM-dd HH:mm:ss", "business day date": "yyyy-MM-dd"}
    own = [(F.date_format(F.col(f"`{c}`"), dates[c]) if c in dates else F.col(f"`{c}`")).alias(c.replace(" ", "_")) for c in P.USE_COLUMNS]
    rounded = [(round2(F.col(c)) if c in P.NUMBER_COLUMNS else F.col(c)).alias(c.lower()) for c in DERIVED]
    return enriched.select(*own, *rounded).withColumnRenamed("bill_no", "invoice_no")


def published_lines(purchases: DataFrame) -> DataFrame:
    """Lines as P1 makes them, from the published purchases, for the tables that need neither dates nor the lines' order.

    The workbook's own columns are published as they are, so the unrounded measures come out of them again.
    """
    own = {c: F.col("invoice_no" if c == "bill no" else c.replace(" ", "_")) for c in [*P.TEXT_COLUMNS, *P.NUMERIC_COLUMNS]}
    made = P.measures(own)
    return purchases.select(*[col.alias(c) for c, col in own.items()], *[made.get(c, F.col(c.lower())).alias(c) for c in DERIVED])


def ordered_tables(enriched: DataFrame, po: DataFrame, grn: DataFrame, bank: DataFrame) -> dict[str, DataFrame]:
    """The reconciliation inputs, and the tables that need all of P1's lines, the purchases last."""
    made = {"po": po, "grn": grn, "bank": bank, "blocked_vendors": P.blocked_vendors(enriched)}
    return {**_fixed_columns(made), "purchases": purchase_table(enriched)}


def derived_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """The other seven, from P1's lines or those of the published purchases."""
    purchases = P.purchase_project(lines)
    return _fixed_columns({
        "multi_tax": H.multi_tax(lines), "dup_customers": H.dup_customers(lines), "prod_name_issues": H.prod_name_issues(lines),
        "prod_gst_issues": H.prod_gst_issues(lines), "prod_code_check": H.prod_code_check(lines),
        "gst_check": P.gst_check(purchases), "disc_check": P.disc_check(purchases),
    })


def _fixed_columns(made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: table.select(*TABLE_COLUMNS[name]) for name, table in made.items()}


def result_tables(enriched: DataFrame, po: DataFrame, grn: DataFrame, bank: DataFrame) -> dict[str, DataFrame]:
    """All twelve, from enriched lines (P1, best a written table: most tables read it) and the reconciliation inputs."""
    return {**ordered_tables(enriched, po, grn, bank), **derived_tables(enriched)}


def _input_files(spark: SparkSession, inputs: list[str]) -> set[tuple[str, int, int]]:
    return {file for path in inputs for file in list_files(spark, path)}


def publish(spark: SparkSession, tables: Tables, out_dir: str, inputs: list[str], buckets: int | None = None) -> dict[str, DataFrame]:
    """Write the tables as the next version; its manifest, which names the input files, is the commit.

    ``tables`` may be a function that gets the tables written so far and yields the next: one can be made from another's
    files, and what it was made from can go before the next is written.
    """
    buckets = buckets or bucket_count(spark)
    files = _input_files(spark, inputs)  # as they are before they are read
    numbers = [int(m[1]) for m in map(_VERSION.match, child_names(spark, out_dir)) if m]
    version = f"{out_dir}/v{max(numbers, default=0) + 1:06d}"
    written = {}
    with set_within(spark, WHILE_WRITING):
        for name, table in tables(written) if callable(tables) else tables.items():
            path = f"{version}/{name}"
            if name in BY_INVOICE:
                written[name] = bucketed(table, path, buckets)
            else:
                compressed(table).mode("error").parquet(path)
                written[name] = spark.read.parquet(path)
    rows = [(*file, buckets) for file in sorted(files)] or [(None, None, None, buckets)]
    spark.createDataFrame(rows, "path string, length long, changed long, buckets int").coalesce(1).write.json(f"{version}/manifest")
    return written


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(table: DataFrame, path: str, buckets: int) -> DataFrame:
    """The table written in buckets by invoice, and read as such: what is made from it goes into as many buckets without a shuffle."""
    # A file per bucket: the rows are dealt to tasks as they are to buckets.
    writer = compressed(table.repartition(buckets, "INVOICE_NO")).bucketBy(buckets, "INVOICE_NO").sortBy("INVOICE_NO")
    writer.option("path", path).mode("error").saveAsTable(_registered(path))
    return table.sparkSession.table(_registered(path))


def drop_bucketed(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE {_registered(path)}")
    remove(spark, path)


def _registered(path: str) -> str:
    """A catalog name for a table's folder; bucketing is only known to tables of the catalog."""
    return f"ledgerlens_{hashlib.sha256(path.encode()).hexdigest()[:20]}"


def _open(spark: SparkSession, version: str, names: list[str], buckets: int) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        path = f"{version}/{name}"
        if name in BY_INVOICE:
            known = _registered(path)
            if not spark.catalog.tableExists(known):
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
                spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY (INVOICE_NO) SORTED BY (INVOICE_NO) "
                          f"INTO {buckets} BUCKETS LOCATION '{path}'")
            out[name] = spark.table(known)
        else:
            out[name] = spark.read.parquet(path)
    return out


def stored(spark: SparkSession, out_dir: str, inputs: list[str], names: list[str]) -> dict[str, DataFrame] | None:
    """The named tables of the latest version, if it has them all, its purchases are not empty, and its input files are those there now."""
    found = sorted(n for n in child_names(spark, out_dir) if _VERSION.match(n))
    complete = [n for n in found if exists(spark, f"{out_dir}/{n}/manifest/_SUCCESS")]
    if not complete:
        return None
    version = f"{out_dir}/{complete[-1]}"
    rows = spark.read.schema("path string, length long, changed long, buckets int").json(f"{version}/manifest").collect()
    if {tuple(r)[:3] for r in rows if r.path is not None} != _input_files(spark, inputs):
        return None
    if not set(names) <= set(child_names(spark, version)):
        return None
    tables = _open(spark, version, names, rows[0].buckets)
    return None if "purchases" in tables and tables["purchases"].isEmpty() else tables


def stored_or_computed(spark: SparkSession, out_dir: str, inputs: list[str], names: list[str],
                       compute: Callable[[], Tables], buckets: int | None = None) -> dict[str, DataFrame]:
    """The stored tables where they still hold, else made anew, published and read."""
    return stored(spark, out_dir, inputs, names) or publish(spark, compute(), out_dir, inputs, buckets)


def with_order(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PO, GRN and bank for the match; published rows have no order but their numbers, the smallest comes first."""
    return tuple(tables[name].withColumn("ORD", F.lit(0)) for name in BY_INVOICE)
