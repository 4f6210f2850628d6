"""Hygiene remarks as a compacted change log.

The reference upserts one remark per issue id (``ON CONFLICT DO UPDATE``
sets remark + timestamp only, so category / entity key keep the values of
the first save since the last delete) and deletes on request.  Over an
append-only log of requests that is:

1. per issue id, the position of the last delete (one aggregation);
2. keep the saves after it (join on issue id -- AQE splits a hot key);
3. per issue id: latest remark / time, earliest category / entity key
   (a second aggregation, combined map-side).

No window over the whole key: a key with a third of the log is never
sorted inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REMARK_COLUMNS = ["issue_id", "category", "entity_key", "remark", "updated_at"]


def _is_delete() -> Column:
    """A request without an action is a save."""
    return F.col("action").eqNullSafe(F.lit("delete"))


def remarks_merge(log: DataFrame, ts_col: str = "ts", seq_col: str = "seq",
                  updated_col: str | None = None) -> DataFrame:
    """K7: compact a (issue_id, category, entity_key, remark, action, ts, seq) log.

    ``(ts, seq)`` orders the requests.  ``updated_col`` (default ``ts``) is
    the value reported as ``updated_at`` for the winning save.
    """
    pos = F.struct(F.col(ts_col).alias("t"), F.col(seq_col).alias("s"))
    upd = F.col(updated_col or ts_col)
    is_delete = _is_delete()
    cuts = log.filter(is_delete).groupBy("issue_id").agg(F.max(pos).alias("cut"))
    saves = log.filter(~is_delete).filter(F.col("issue_id").isNotNull() & (F.col("issue_id") != ""))
    live = saves.join(cuts, "issue_id", "left").filter(F.col("cut").isNull() | (pos > F.col("cut")))
    g = live.groupBy("issue_id").agg(
        F.max(F.struct(pos.alias("p"), F.col("remark").alias("v"), upd.alias("u"))).alias("last"),
        F.min(F.struct(pos.alias("p"), F.col("category").alias("c"), F.col("entity_key").alias("e"))).alias("first"),
    )
    return g.select(
        "issue_id",
        F.coalesce(F.col("first.c"), F.lit("")).alias("category"),
        F.coalesce(F.col("first.e"), F.lit("")).alias("entity_key"),
        F.coalesce(F.col("last.v"), F.lit("")).alias("remark"),
        F.col("last.u").alias("updated_at"),
    )


def remarks_scan(remarks: DataFrame) -> DataFrame:
    """(issue_id, remark) with null remark -> ''."""
    return remarks.select("issue_id", F.coalesce(F.col("remark"), F.lit("")).alias("remark"))


LOG_COLUMNS = ["issue_id", "category", "entity_key", "remark", "action", "ts", "seq"]


def fold_log(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Incremental form of K7: the part of the log that can still matter, after a batch of requests.

    The state is a log itself: per issue its last delete, and the saves after
    it.  ``remarks_merge`` of the state equals that of the full history, in
    whatever order and batches the requests come: a late delete removes the
    saves before it, a late save counts only where no kept delete follows it.
    """
    batch = changes.select(*LOG_COLUMNS)
    log = batch if state is None else state.select(*LOG_COLUMNS).unionByName(batch)
    pos = F.struct("ts", "seq")
    cuts = log.filter(_is_delete()).groupBy("issue_id").agg(F.max(pos).alias("cut"))
    live = log.filter(~_is_delete()).join(cuts, "issue_id", "left").filter(F.col("cut").isNull() | (pos > F.col("cut")))
    none = F.lit(None).cast("string")
    deletes = cuts.select("issue_id", none.alias("category"), none.alias("entity_key"), none.alias("remark"),
                          F.lit("delete").alias("action"), F.col("cut.ts").alias("ts"), F.col("cut.seq").alias("seq"))
    return live.select(*LOG_COLUMNS).unionByName(deletes)
