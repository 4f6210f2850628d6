"""K7 as a Structured Streaming job with state per issue.

Requests arrive as files (parquet) in a folder.  ``RemarkState`` keeps, per
issue, the position of its last delete, the saves after it (one map entry per
save), and the first and last of them.  A micro-batch reads and writes the
state of its own issues only, and the state store (RocksDB) commits changes.
Requests may come in any order: a late delete removes the saves before it, a
late save counts only if no delete follows it.

What a batch changes is appended to a change table, one folder per batch,
named by the batch and written whole, so a replayed batch writes the same
folder again.  ``current_remarks`` is the latest row per issue;
``compact_changes`` replaces the folders by one, when there are many.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlens.session import ship_package
from ledgerlens.sinks.tables import child_names, exists, remove

REQUEST_SCHEMA = (
    "issue_id string, category string, entity_key string, remark string, "
    "action string, ts timestamp, seq long"
)
CHANGE_SCHEMA = "issue_id string, category string, entity_key string, remark string, updated_us long, removed boolean"

_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch uploads what it changed, not the whole store.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_FOLDER = re.compile(r"(batch|upto)-(\d{12})$")
_NEVER = (-(2**63), -(2**63))

Position = tuple[int, int]


def _least(value: str | None) -> tuple[bool, str]:
    """Orders texts as Spark does: null first."""
    return (value is not None, value or "")


class RemarkState(StatefulProcessor):
    """Folds the requests of an issue into its state; tells the remark that results."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cut = handle.getValueState("cut", "ts long, seq long")
        self.ends = handle.getValueState("ends", "first_ts long, first_seq long, last_ts long, last_seq long")
        self.saves = handle.getMapState("saves", "ts long, seq long", "category string, entity_key string, remark string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        cut: Position = self.cut.get() if self.cut.exists() else _NEVER
        old_cut = cut
        held: dict[Position, tuple] = {}
        for frame in rows:
            for ts, seq, action, category, entity, remark in zip(
                    frame.ts_us, frame.seq, frame.action, frame.category, frame.entity_key, frame.remark, strict=True):
                place = (int(ts), int(seq))
                if action == "delete":
                    cut = max(cut, place)
                    held = {p: v for p, v in held.items() if p > cut}
                elif place > cut:
                    held[place] = _both(held.get(place), (category, entity, remark))
        ends = tuple(self.ends.get()) if self.ends.exists() else None
        if cut != old_cut:
            self.cut.update(cut)
            if ends and ends[:2] <= cut:
                # The delete removes saves: those that stay tell the new ends.
                stay = []
                for place in [tuple(p) for p in self.saves.keys()]:
                    if place > cut:
                        stay.append(place)
                    else:
                        self.saves.removeKey(place)
                ends = (*min(stay), *max(stay)) if stay else None
        for place, value in held.items():
            known = tuple(self.saves.getValue(place)) if self.saves.containsKey(place) else None
            self.saves.updateValue(place, _both(known, value))
            ends = (*min(place, ends[:2]), *max(place, ends[2:])) if ends else (*place, *place)
        if ends:
            self.ends.update(ends)
            category, entity, _ = self.saves.getValue(ends[:2])
            remark = self.saves.getValue(ends[2:])[2]
            yield _change(key[0], category or "", entity or "", remark or "", ends[2], False)
        else:
            self.ends.clear()
            yield _change(key[0], "", "", "", cut[0], True)

    def close(self) -> None:
        pass


def _both(known: tuple | None, new: tuple) -> tuple:
    """Two saves of one position: the smallest category and key, the largest remark, as the batch form has it."""
    if known is None:
        return new
    return (*min(known[:2], new[:2], key=lambda v: tuple(map(_least, v))), max(known[2], new[2], key=_least))


def _change(issue: str, category: str, entity: str, remark: str, updated_us: int, removed: bool) -> pd.DataFrame:
    return pd.DataFrame({"issue_id": [issue], "category": [category], "entity_key": [entity], "remark": [remark],
                         "updated_us": [updated_us], "removed": [removed]})


def remark_changes(requests: DataFrame) -> DataFrame:
    """The changed remark of every issue that a micro-batch of requests touches."""
    ship_package(requests.sparkSession)
    none = F.lit(_NEVER[0])
    told = requests.filter("coalesce(issue_id, '') != '' or coalesce(action, '') = 'delete'").select(
        "issue_id", "category", "entity_key", "remark", "action",
        F.coalesce(F.unix_micros("ts"), none).alias("ts_us"), F.coalesce("seq", none).alias("seq"))
    return told.groupBy("issue_id").transformWithStateInPandas(
        statefulProcessor=RemarkState(), outputStructType=CHANGE_SCHEMA, outputMode="Update", timeMode="None")


def append_changes(table_dir: str):
    """foreachBatch function: write a batch's changes as its folder of the change table."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id > compacted_upto(batch.sparkSession, table_dir):
            batch.write.mode("overwrite").parquet(f"{table_dir}/batch-{batch_id:012d}")

    return run


def _folders(spark: SparkSession, table_dir: str) -> list[tuple[int, str]]:
    """(batch, folder) of the complete folders that count: the last compacted one and the batches after it."""
    found = sorted((int(m[2]), m[1], f"{table_dir}/{m[0]}") for m in map(_FOLDER.match, child_names(spark, table_dir)) if m)
    found = [f for f in found if exists(spark, f"{f[2]}/_SUCCESS")]
    low = max((n for n, kind, _ in found if kind == "upto"), default=-1)
    return [(n, path) for n, kind, path in found if (n > low and kind == "batch") or (n == low and kind == "upto")]


def compacted_upto(spark: SparkSession, table_dir: str) -> int:
    """The last batch that compaction has taken in; -1 before the first."""
    return max((n for n, path in _folders(spark, table_dir) if "/upto-" in path), default=-1)


def _latest(spark: SparkSession, table_dir: str) -> DataFrame | None:
    folders = _folders(spark, table_dir)
    if not folders:
        return None
    tables = [spark.read.schema(CHANGE_SCHEMA).parquet(path).withColumn("batch", F.lit(n)) for n, path in folders]
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    fields = [f.split()[0] for f in CHANGE_SCHEMA.split(", ")]
    return rows.groupBy("issue_id").agg(F.max(F.struct("batch", *fields[1:])).alias("row")).select(
        "issue_id", *[F.col(f"row.{f}").alias(f) for f in fields[1:]])


def current_remarks(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The remark table as of the last applied batch; None before the first."""
    rows = _latest(spark, table_dir)
    if rows is None:
        return None
    updated = F.when(F.col("updated_us") != _NEVER[0], F.timestamp_micros("updated_us"))
    return rows.filter("not removed").select("issue_id", "category", "entity_key", "remark", updated.alias("updated_at"))


def compact_changes(spark: SparkSession, table_dir: str) -> None:
    """One folder in place of those of all batches so far; readers find either the old ones or the new one."""
    folders = _folders(spark, table_dir)
    if len(folders) > 1:
        _latest(spark, table_dir).write.mode("overwrite").parquet(f"{table_dir}/upto-{folders[-1][0]:012d}")
        for _, path in folders:
            remove(spark, path)


def start_remarks_stream(spark: SparkSession, requests_dir: str, table_dir: str,
                         checkpoint_location: str, available_now: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there, then stops."""
    for name, value in _STORE.items():
        spark.conf.set(name, value)
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    changes = remark_changes(reader.parquet(requests_dir))
    writer = changes.writeStream.outputMode("update").foreachBatch(append_changes(table_dir)).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
