"""K5, K6 on a stored table: only the categories that a change touches are written.

The table keeps a folder of rows per category.  A commit is a small list that
names the folder of every category, and the highest id there has ever been; the
latest complete commit is the table.  A change looks up the categories of the
rows it is about, writes those categories anew beside the old ones, and commits
a list in which the other categories keep their folders.  Readers never see
half a change.  One writer at a time: a second commit of one number fails.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import strip
from ledgerlens.operators.observations import observations_delete, observations_upsert
from ledgerlens.sinks.tables import child_names, exists

_COMMIT = "category string, folder string, highest long"


def _commits(spark: SparkSession, table_dir: str) -> list[str]:
    return sorted(n for n in child_names(spark, f"{table_dir}/commits") if exists(spark, f"{table_dir}/commits/{n}/_SUCCESS"))


def _latest(spark: SparkSession, table_dir: str) -> tuple[int, dict[str, str], int]:
    """(number, folder by category, highest id) of the latest commit."""
    numbers = _commits(spark, table_dir)
    if not numbers:
        return 0, {}, 0
    rows = spark.read.schema(_COMMIT).json(f"{table_dir}/commits/{numbers[-1]}").collect()
    return int(numbers[-1]), {r.category: r.folder for r in rows if r.folder}, max(r.highest for r in rows)


def _part(category: str) -> str:
    return hashlib.sha256(category.encode()).hexdigest()[:24]


def read_parts(spark: SparkSession, table_dir: str, categories: list[str] | None = None) -> DataFrame | None:
    """The table, or those of its categories; None before the first commit."""
    number, folders, _ = _latest(spark, table_dir)
    if not number:
        return None
    schema = spark.read.parquet(f"{table_dir}/schema").schema
    paths = [f"{table_dir}/{f}" for c, f in sorted(folders.items()) if categories is None or c in categories]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, table_dir: str, rows: DataFrame, touched: set[str], highest: int) -> None:
    number, folders, _ = _latest(spark, table_dir)
    data = f"data/{number + 1:012d}"
    part = F.substring(F.sha2(F.col("category"), 256), 1, 24)
    rows.withColumn("part", part).write.mode("error").partitionBy("part").parquet(f"{table_dir}/{data}")
    made = set(child_names(spark, f"{table_dir}/{data}"))
    listed = {c: f for c, f in folders.items() if c not in touched}
    listed |= {c: f"{data}/part={_part(c)}" for c in touched if f"part={_part(c)}" in made}
    entries = [(c, f, highest) for c, f in sorted(listed.items())] or [(None, None, highest)]
    spark.createDataFrame(entries, _COMMIT).coalesce(1).write.mode("error").json(f"{table_dir}/commits/{number + 1:012d}")


def _categories(rows: DataFrame) -> set[str]:
    return {r.category for r in rows.select("category").distinct().collect()}


def create_parts(rows: DataFrame, table_dir: str) -> None:
    """First commit: all rows (with ``id`` and ``category``), a folder per category."""
    spark = rows.sparkSession
    rows = rows.withColumn("category", F.coalesce("category", F.lit("")))
    rows.limit(0).write.mode("error").parquet(f"{table_dir}/schema")
    rows.withColumn("part", F.substring(F.sha2(F.col("category"), 256), 1, 24)).write.mode("error").partitionBy("part").parquet(f"{table_dir}/load")
    loaded = spark.read.schema(rows.schema).parquet(f"{table_dir}/load")
    stats = loaded.groupBy("category").agg(F.max("id").alias("top")).collect()
    entries = [(r.category, f"load/part={_part(r.category)}", max(s.top for s in stats)) for r in stats] or [(None, None, 0)]
    spark.createDataFrame(entries, _COMMIT).coalesce(1).write.mode("error").json(f"{table_dir}/commits/{1:012d}")


def upsert_parts(spark: SparkSession, table_dir: str, changes: DataFrame, order_col: str = "seq", stamped: Column | None = None) -> set[str]:
    """K5 as one commit; the categories that were written.  New rows get ids after the highest ever given."""
    _, folders, highest = _latest(spark, table_dir)
    whole = read_parts(spark, table_dir)
    hit = whole.select("id", "category").join(changes.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    # Where rows are now, and where they or new ones go; of a change without a row to change nothing comes.
    now = F.coalesce(strip(F.col("category").cast("string")), F.lit("")) if "category" in changes.columns else F.lit("")
    goes = changes.select(F.col("id").cast("long").alias("id"), now.alias("category"))
    goes = goes.filter("id is null").select("category").unionByName(goes.join(hit.select("id"), "id", "left_semi").select("category"))
    touched = _categories(hit) | _categories(goes)
    if not touched:
        return touched
    rows = read_parts(spark, table_dir, sorted(touched))
    new = changes.filter("id is null").count()
    _commit(spark, table_dir, observations_upsert(rows, changes, order_col, stamped, highest), touched, highest + new)
    return touched


def delete_parts(spark: SparkSession, table_dir: str, ids: DataFrame) -> set[str]:
    """K6 as one commit; the categories that were written."""
    _, _, highest = _latest(spark, table_dir)
    listed = ids.select(F.col("id").cast("long").alias("id"))
    touched = _categories(read_parts(spark, table_dir).select("id", "category").join(listed, "id", "left_semi"))
    if touched:
        _commit(spark, table_dir, observations_delete(read_parts(spark, table_dir, sorted(touched)), listed), touched, highest)
    return touched
