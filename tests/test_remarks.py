"""K7: remark upsert/delete log compaction, batch, incremental and streaming forms."""

import datetime as dt
import os
import random

from ledgerlens.operators.remarks import fold_log, remarks_merge

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "issue_id string, category string, entity_key string, remark string, action string, ts timestamp, seq long"


def _log(spark, rows):
    return spark.createDataFrame(
        [(i, c, e, r, a, T0 + dt.timedelta(minutes=m), m) for i, c, e, r, a, m in rows], SCHEMA)


LOG = [
    ("a", "c1", "k1", "first", "save", 1),
    ("a", "c2", "k2", "second", "save", 2),       # category stays c1 (first insert)
    ("b", "c1", "k1", "x", "save", 3),
    ("b", "", "", "", "delete", 4),               # b removed
    ("c", "c1", "k1", "old", "save", 5),
    ("c", "", "", "", "delete", 6),
    ("c", "c3", "k3", "new", "save", 7),          # after delete: new first insert
]


def _table(df):
    return {r["issue_id"]: (r["category"], r["entity_key"], r["remark"]) for r in df.collect()}


def test_merge_semantics(spark):
    got = _table(remarks_merge(_log(spark, LOG)))
    assert got == {"a": ("c1", "k1", "second"), "c": ("c3", "k3", "new")}


def test_incremental_equals_full(spark):
    state = fold_log(fold_log(None, _log(spark, LOG[:3])), _log(spark, LOG[3:]))
    assert _table(remarks_merge(state)) == _table(remarks_merge(_log(spark, LOG)))


def test_batches_in_any_order_equal_the_full_history(spark):
    rng = random.Random(4)
    log = [(rng.choice("abc"), f"c{m}", f"k{m}", f"r{m}", rng.choice(["save", "save", None, "delete"]), m) for m in range(24)]
    want = _table(remarks_merge(_log(spark, log)))
    for _ in range(3):
        rng.shuffle(log)
        state = None
        for start in range(0, len(log), 8):
            folded = fold_log(state, _log(spark, log[start : start + 8])).collect()
            state = spark.createDataFrame(folded, SCHEMA)
        assert _table(remarks_merge(state)) == want


def test_a_request_without_action_is_a_save(spark):
    assert _table(remarks_merge(_log(spark, [("a", "c", "k", "kept", None, 1)]))) == {"a": ("c", "k", "kept")}


def _run(spark, req, table, ckpt, **more):
    from ledgerlens.streaming.remarks_stream import start_remarks_stream

    query = start_remarks_stream(spark, os.path.join(req, "*"), table, ckpt, **more)
    query.awaitTermination(180)
    assert query.exception() is None


def _full(df):
    return {tuple(r) for r in df.collect()}


def test_stream_keeps_state_per_issue(spark, tmp_dir):
    """Late saves and late deletes over several batches; a replayed batch changes nothing; compaction neither."""
    from ledgerlens.streaming import remarks_stream as S

    rng = random.Random(9)
    log = [(rng.choice("abcd"), rng.choice([f"c{m}", None]), f"k{m}", rng.choice([f"r{m}", None]), rng.choice(["save", "save", None, "delete"]), m)
           for m in range(40)]
    log += [("e", "c", "k", "r1", "save", 50), ("e", "b", "z", "r2", "save", 50), ("", "c", "k", "nobody", "save", 51)]
    rng.shuffle(log)
    req, table, ckpt = (os.path.join(tmp_dir, n) for n in ("requests", "remarks", "ckpt"))
    for part in range(3):
        _log(spark, log[part::3]).coalesce(1).write.parquet(os.path.join(req, f"batch{part}"))
        _run(spark, req, table, ckpt)
        if part == 1:
            S.compact_changes(spark, table)
            assert S.compacted_upto(spark, table) == 1 and sorted(S.child_names(spark, table)) == ["upto-000000000001"]
    want = _full(remarks_merge(_log(spark, log)))
    assert _full(S.current_remarks(spark, f"file://{table}")) == want
    again = spark.createDataFrame([("z", "c", "k", "again", 0, False)], S.CHANGE_SCHEMA)
    S.append_changes(table)(again, 1)  # taken in by compaction already
    assert _full(S.current_remarks(spark, table)) == want


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(p, f)) for p, _, names in os.walk(folder) for f in names)


def test_stream_writes_follow_the_batch(spark, tmp_dir):
    """After a large first batch, a batch of one request writes little, to state and to table."""
    req, table, ckpt = (os.path.join(tmp_dir, n) for n in ("requests", "remarks", "ckpt"))
    many = [(f"i{n}", "c", f"k{n}", f"remark number {n * 7919}", "save", n) for n in range(20_000)]
    _log(spark, many).coalesce(2).write.parquet(os.path.join(req, "batch1"))
    _run(spark, req, table, ckpt)
    table_bytes, state_bytes = _bytes(table), _bytes(os.path.join(ckpt, "state"))
    _log(spark, [("i5", "c", "k", "changed", "save", 30_000), ("i6", "", "", "", "delete", 30_001)]).coalesce(1).write.parquet(os.path.join(req, "batch2"))
    _run(spark, req, table, ckpt)
    assert _bytes(table) - table_bytes < table_bytes / 20
    assert _bytes(os.path.join(ckpt, "state")) - state_bytes < state_bytes / 5
    from ledgerlens.streaming.remarks_stream import current_remarks

    now = _table(current_remarks(spark, table))
    assert len(now) == 19_999 and now["i5"] == ("c", "k5", "changed") and "i6" not in now
