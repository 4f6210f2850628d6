"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition sorts the digests of its documents into a run that holds each
digest once.  Runs are then exchanged in rounds of a binomial tree of radix
``fan_in``: in round r the runs whose numbers agree after dropping r digits
meet, separately for each range of digests, and are merged in one sorted pass.
Each level keeps, per digest, the row that stays and the number of rows it
stands for.  A merge is verified by the full SHA-256 and the normalised length.
A digest held by a third of all rows occurs once per run, so no task ever
sees a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACES, own_prefix, prepare, shuffle_width, stage, utf8

DIGEST_SCHEMA = "row long, doc_id {id}, text_hash long, n_chars long, n_norm long, sha binary"
RUN_FIELDS = ("range", "run", "sha", "n_norm", "n_chars", "doc_id", "row", "n_rows")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.translate(None, SPACES) for t in batch.column("text").to_pylist()]
        columns = {name: batch.column(name) for name in ("row", "doc_id", "text_hash", "n_chars")}
        columns["n_norm"] = pa.array([len(t) for t in texts], pa.int64())
        columns["sha"] = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_pydict(columns)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: its digest after deleting white space, and a row number."""
    prepare(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), utf8().alias("text"),
    )
    return rows.mapInArrow(_digest, DIGEST_SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge adjacent rows of equal digest; the first of them stays, counts add up."""
    held: list | None = None
    schema = None
    for batch in batches:
        schema = batch.schema
        out = []
        for values in zip(*(batch.column(f).to_pylist() for f in RUN_FIELDS), strict=True):
            if held is not None and values[:4] == tuple(held[:4]):
                held[-1] += values[-1]
            else:
                if held is not None:
                    out.append(held)
                held = list(values)
        if out:
            yield _batch(out, schema)
    if held is not None:
        yield _batch([held], schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, schema.field(f).type) for f, column in zip(RUN_FIELDS, zip(*rows, strict=True), strict=True)],
        names=list(RUN_FIELDS),
    )


def _merged(runs: DataFrame) -> DataFrame:
    """Sort each partition so that rows to merge are adjacent, the one that stays first."""
    ordered = runs.select(*RUN_FIELDS).sortWithinPartitions(
        "range", "run", "sha", "n_norm", F.desc("n_chars"), F.asc_nulls_last("doc_id"), "row")
    return ordered.mapInArrow(_merge, ordered.schema)


def merge_runs(table: DataFrame, fan_in: int = 8) -> DataFrame:
    """The single run that all partitions' runs merge to: a row per digest."""
    spark = table.sparkSession
    width = shuffle_width(spark)
    # Ranges are classes of the digest's head modulo the width; runs are sorted within each.
    head = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
    runs = stage(_merged(table.select(
        "*", (head % width).cast("int").alias("range"), F.spark_partition_id().alias("run"),
        F.lit(1).cast("long").alias("n_rows"))), "digest-runs")
    last = runs.agg(F.max("run")).first()[0] or 0
    rounds = 0
    while last >= fan_in**rounds:
        rounds += 1
        met = runs.withColumn("run", F.floor(F.col("run") / F.lit(fan_in)).cast("int"))
        runs = stage(_merged(met.repartition(width, "range", "run")), f"digest-round-{rounds}")
    return runs


def exact_dedup(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """Which rows stay when rows of equal text (white space apart) are merged.

    Returns a row per input row: doc_id, text_hash (of the text as it is),
    keep_id, group_size, kept, text_sha256.  Of equal texts the longest in code
    points stays, then the smallest doc_id (null last), then any one of rows
    that are equal in both.  Null texts count as empty; empty texts are equal.
    An empty table gives an empty result; other columns are ignored.
    """
    table = stage(digests(docs), "digests")
    groups = merge_runs(table, fan_in).select(
        "sha", "n_norm", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"),
        F.col("n_rows").alias("group_size"))
    return table.join(groups, ["sha", "n_norm"]).select(
        "doc_id", "text_hash", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "row")


def drop_copies(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that agree in doc_id and text are one row here: the first stays.
    Columns of any name are kept as they are.
    """
    own = own_prefix(docs)
    table = exact_dedup(docs, fan_in)
    staying = stage(table.filter("kept").select("doc_id", "text_hash", "group_size"), "staying")
    keyed = docs.withColumn(f"{own}hash", F.xxhash64("text"))
    stays = keyed.join(
        staying.select(F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}text"), F.col("group_size").alias(f"{own}n")),
        F.col("doc_id").eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}hash") == F.col(f"{own}text")))
    alone = stays.filter(F.col(f"{own}n") == 1).select(*docs.columns)
    # Only a text that occurred more than once can have a second row of the same id.
    several = stays.filter(F.col(f"{own}n") > 1).dropDuplicates([f"{own}id", f"{own}hash"]).select(*docs.columns)
    return alone.unionByName(several)
