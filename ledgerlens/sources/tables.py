"""Table scans of stored / uploaded data.

S4 (stored tables, else recompute) lives in ``ledgerlens.sinks.tables``
next to the writer it mirrors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.audit_trail import audit_trail_normalize
from ledgerlens.operators.observations import dense_ids, observations_list  # noqa: F401  (S5)
from ledgerlens.operators.purchase import purchase_scan  # noqa: F401  (S2)
from ledgerlens.operators.remarks import remarks_scan  # noqa: F401  (S7)
from ledgerlens.sinks.tables import audit_trail_replace, child_names, current_snapshot, materialize
from ledgerlens.sources.workbook import workbook_columns, workbook_headers

# Tokens pandas reads as missing in an all-text read.
NA_TOKENS = ["", "#N/A", "N/A", "NA", "NULL", "NaN", "nan", "null", "None", "<NA>", "n/a", "-NaN", "-nan"]


def text_scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """S3: all-text tabular read (CSV with header); missing tokens -> null.

    With ``columns`` the schema is fixed (no inference pass over the data).
    """
    reader = spark.read.option("header", True)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    else:
        reader = reader.option("inferSchema", False)
    df = reader.csv(path)
    return df.select(*[
        F.when(F.col(f"`{c}`").isin(NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
        for c in df.columns
    ])


def audit_trail_scan(stored: DataFrame) -> DataFrame:
    """Stored audit-trail rows in load order, nulls read as ''."""
    order = "id" if "id" in stored.columns else ("row_idx" if "row_idx" in stored.columns else None)
    df = stored.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if t == "string" else F.col(c)
        for c, t in stored.dtypes
    ])
    return df.orderBy(order) if order else df


def audit_trail_current(spark: SparkSession, books_dir: str, table_dir: str) -> DataFrame | None:
    """The audit trail from its workbooks where they hold rows, else from the stored table.

    Rows of workbooks are numbered by workbook and row, normalised, and saved as
    the table's next version, under the folder's name.  None where there are
    neither rows nor a table.
    """
    if any(name.endswith(".xlsx") for name in child_names(spark, books_dir)):
        heads = materialize(workbook_headers(spark, books_dir), "workbook-headers")
        first = heads.orderBy("path").first()
        if first is not None:
            # Headers in the first workbook's order (of two that mean one field the last counts), then those of others.
            others = heads.select(F.explode("names").alias("name")).distinct().collect()
            headers = [*first.names, *sorted({r.name for r in others} - set(first.names))]
            # Stored before the ids, which read their input twice: every workbook is parsed once.
            rows = materialize(workbook_columns(spark, books_dir, headers), "workbook-rows")
            fresh = audit_trail_normalize(dense_ids(rows, 0, "_at"))
            return audit_trail_replace(fresh, books_dir.rstrip("/").rsplit("/", 1)[-1], table_dir)
    return current_snapshot(spark, table_dir)
