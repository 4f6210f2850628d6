"""Named inputs shared by the registered queries (all lazily planned).

Each function returns a DataFrame plan over the parquet tables in
``sf_dir``; nothing is materialised or remembered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators import purchase as P
from ledgerlens.operators import recon as R
from ledgerlens.sources import testdata as T


def enriched(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """P1 output over V1 (or V1c)."""
    return P.purchase_enrich(T.purchase_source(spark, sf_dir, coarse=coarse))


def purchases(spark: SparkSession, sf_dir: str, coarse: bool = False, keep_order: bool = False) -> DataFrame:
    """T1 purchases (P1 + P2) over V1 (or V1c)."""
    return P.purchase_project(enriched(spark, sf_dir, coarse), keep_order=keep_order)


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over the coarse purchase view: the dashboard's input."""
    return P.purchase_rollup(purchases(spark, sf_dir, coarse=True))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 invoice rollup over V1 (values of each invoice's first line)."""
    return R.invoice_rollup(enriched(spark, sf_dir), line_col="_line", extra=["_ord", "_nationkey"])


def recon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V2 (po, grn, bank)."""
    return T.recon_tables(invoices(spark, sf_dir))
