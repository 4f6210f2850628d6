"""The trie of conversation prefixes, by van Emde Boas recursion on depth.

A trie of height 2^J is cut at half its depth into an upper trie and a forest
of lower tries, and each of them again, down to single turns.  All parts of
one recursion level are worked on by the same Spark job, keyed by conversation
and part, so J levels are J jobs and no conversation is ever held in one row
or one task.

1. *Names of pieces.*  A turn's name is a digest of its role and text.  The
   name of a piece of 2^(j+1) turns is the digest of its halves' names.
2. *Names of cut prefixes*, from the top: a prefix that ends at half depth is
   named by the prefix that its part starts from and the upper half's piece.
   Equal prefixes get equal names, whichever conversation they come from; a
   (depth, name) is a node.
3. *Grafting.*  Every node starts with its own totals.  Level by level, the
   lower tries' roots hand their totals to all nodes above them in the upper
   trie that they hang from, found on the path of the root's smallest member.

Names are 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import prepare, shuffle_width, stage

ROOT = bytes(16)
#: Conversations are rebuilt from the first turns of the first one of their hundred.
HUNDRED, MOST_SHARED = 100, 6
#: Bytes of joined ids that travel in one row.
CHUNK_BYTES = 1 << 16

NODE_SCHEMA = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
               "saved_tokens long, ends_sha256 string")


def _named(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def turn_name(role: Column, text: Column) -> Column:
    """The name of a turn; role and text can't run into each other."""
    return _named(F.char_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of every conversation within a sorted partition, from 0; tell where it is."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        new = np.r_[last is None or ids[0] != last, ids[1:] != ids[:-1]]
        starts = np.flatnonzero(new)
        place = np.arange(len(ids))
        first = np.full(len(ids), -count, np.int64)
        if len(starts):
            at = np.searchsorted(starts, place, "right") - 1
            first = np.where(at >= 0, starts[np.maximum(at, 0)], -count)
        place = place - first
        last, count = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(place, pa.int64()), pa.array(np.full(len(ids), part, np.int32)),
             batch.column("name"), batch.column("chars")], names=["conv_id", "place", "part", "name", "chars"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, name, chars): every conversation's turns in order, written.

    Turns are dealt by ranges of (conv_id, turn), so one conversation may span
    many partitions; each partition's count of it shifts those after it.
    """
    spark = conversations.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        turn_name(F.coalesce("role", F.lit("")), text).alias("name"), F.char_length(text).cast("long").alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "name"]
    ranged = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    local = stage(ranged.mapInArrow(_number, "conv_id long, place long, part int, name binary, chars long"), "trie-turns")
    # Only conversations that go on in a later partition matter: at most one a partition.
    sizes = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    spans = sizes.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("high > low")
    held = sizes.join(F.broadcast(spans.select("conv_id")), "conv_id")
    before = held.alias("a").join(F.broadcast(held.alias("b")), F.expr("a.conv_id = b.conv_id and b.part < a.part")) \
        .groupBy(F.col("a.conv_id").alias("conv_id"), F.col("a.part").alias("part")).agg(F.sum("b.n").alias("shift"))
    return local.join(F.broadcast(before), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("shift", F.lit(0)) + 1).alias("place"), "name", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, place, name, chars), and (conv_id, n_turns) of all, turnless ones too.

    Conversation c is the first h turns of the first one of its hundred, then
    its own turns after the first h, with h = crc32(c) mod 6.
    """
    table = stage(turns, "trie-ordered")
    sizes = table.groupBy("conv_id").agg(F.max("place").alias("size"))
    convs = sizes.select(
        "conv_id", "size", (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("shared"))
    heads = table.filter(F.col("place") < MOST_SHARED).select(F.col("conv_id").alias("base"), "place", "name", "chars")
    lengths = heads.groupBy("base").agg(F.max("place").alias("head"))
    plan = stage(convs.join(lengths, "base", "left").withColumn(
        "taken", F.least("shared", F.coalesce("head", F.lit(0)))), "trie-plan")
    front = plan.filter("taken > 0").join(heads, "base").filter("place <= taken").select("conv_id", "place", "name", "chars")
    rest = table.join(plan.select("conv_id", "shared", "taken"), "conv_id").filter("place > shared").select(
        "conv_id", (F.col("place") - F.col("shared") + F.col("taken")).alias("place"), "name", "chars")
    sizes = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("size") - F.col("shared"), F.lit(0))).alias("n_turns"))
    return front.unionByName(rest), sizes


def named_prefixes(rows: DataFrame, height: int) -> DataFrame:
    """(conv_id, depth, name): the name of every prefix, from the empty one on; ``rows`` must be written."""
    # Names of pieces, from the turns up; piece i of level j covers turns i*2^j+1 to (i+1)*2^j.
    pieces = [rows.select("conv_id", (F.col("place") - 1).alias("piece"), "name")]
    for _ in range(height - 1):
        lower = pieces[-1]
        half = F.col("piece") % 2
        joined = lower.groupBy("conv_id", F.shiftright("piece", 1).alias("piece")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"))
        pieces.append(joined.filter("right is not null").select("conv_id", "piece", _named(F.col("left"), F.col("right")).alias("name")))
        if len(pieces) % 4 == 0:
            pieces[-1] = stage(pieces[-1], "trie-pieces")
    # Names of cut prefixes, from the whole trie down.
    start = rows.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("cut"), F.lit(ROOT).alias("name"))
    for level in range(height - 1, -1, -1):
        # The upper half's piece (an even one) leads from the start of a part to its cut.
        upper = pieces[level].filter("piece % 2 = 0").select(
            "conv_id", F.shiftright("piece", 1).alias("cut"), F.col("name").alias("half"))
        both = start.join(upper, ["conv_id", "cut"], "left")
        cut = F.struct((F.col("cut") * 2 + 1).alias("cut"), _named(F.col("name"), F.col("half")).alias("name"))
        same = F.struct((F.col("cut") * 2).alias("cut"), F.col("name"))
        ways = F.when(F.col("half").isNull(), F.array(same)).otherwise(F.array(same, cut))
        start = both.select("conv_id", F.explode(ways).alias("way")).select("conv_id", "way.cut", "way.name")
        if level % 4 == 0:
            start = stage(start, "trie-prefixes")
    return start.withColumnRenamed("cut", "depth")


def grafted(own: DataFrame, paths: DataFrame, height: int, totals: list[str]) -> DataFrame:
    """Sums of ``totals`` over every node's subtree.

    ``own`` has (depth, name, conv_id, *totals), conv_id a member of the node;
    ``paths`` has (conv_id, depth, name) of all prefixes.  Both must be written.
    """
    held = own
    for level in range(height):
        part = F.shiftright("depth", level)
        # Roots of lower tries: the first depth of every odd part.
        roots = held.filter((part % 2 == 1) & (F.col("depth") % (1 << level) == 0)).select(
            "conv_id", (part - 1).alias("part"), *totals)
        above = paths.filter(part % 2 == 0).withColumn("part", part)
        handed = roots.join(above, ["conv_id", "part"]).groupBy("depth", "name").agg(*(F.sum(t).alias(t) for t in totals))
        summed = held.unionByName(handed, allowMissingColumns=True).groupBy("depth", "name").agg(
            F.max("conv_id").alias("conv_id"), *(F.sum(t).alias(t) for t in totals))
        held = stage(summed, "trie-grafted")
    return held


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the ids of every node within a sorted partition.

    The nodes at a partition's ends may go on in its neighbours: their ids
    leave as texts of bounded size; those between are complete.
    """
    out: list[tuple] = []
    node, ids, size, first, opening = None, [], 0, 0, True

    def chunk() -> None:
        nonlocal ids, size
        out.append((node, first, ",".join(ids), None))
        ids, size = [], 0

    for batch in batches:
        for name, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("name", "depth", "conv_id")), strict=True):
            if (name, depth) != node:
                if node is not None:
                    if opening or node == split:
                        chunk()
                    else:
                        out.append((node, first, None, hashlib.sha256(",".join(ids).encode()).hexdigest()))
                    opening = False
                node, ids, size, first, split = (name, depth), [], 0, conv, None
            if not ids:
                first = conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
            if size > CHUNK_BYTES:
                chunk()
                split = node
        if len(out) > 4096:
            yield _run_batch(out)
            out.clear()
    if ids:
        chunk()
    if out:
        yield _run_batch(out)


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r[0][0] for r in rows], pa.binary()), pa.array([r[0][1] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()),
        pa.array([r[3] for r in rows], pa.string())], names=["name", "depth", "first", "ids", "sha"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over texts of ids that arrive in order; holds one text at a time."""
    node, sha = None, None
    for batch in batches:
        out = []
        for name, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("name", "depth", "ids")), strict=True):
            if (name, depth) != node:
                if node is not None:
                    out.append((node, None, None, sha.hexdigest()))
                node, sha = (name, depth), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield _run_batch(out).select(["name", "depth", "sha"])
    if node is not None:
        yield _run_batch([(node, None, None, sha.hexdigest())]).select(["name", "depth", "sha"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, name, sha): SHA-256 of the ascending ids of the conversations that end at each node.

    Ids are dealt by ranges of (node, id), so a node where a third of all
    conversations end is joined by many tasks; only its joined texts meet.
    """
    width = shuffle_width(ends.sparkSession)
    order = ["name", "depth", "conv_id"]
    ranged = ends.select(*order).repartitionByRange(width, *order).sortWithinPartitions(*order)
    runs = stage(ranged.mapInArrow(_digest_runs, "name binary, depth long, first long, ids string, sha string"), "trie-ends")
    open_runs = runs.filter("sha is null").repartition(width, "name", "depth").sortWithinPartitions("name", "depth", "first")
    closed = open_runs.select("name", "depth", "ids").mapInArrow(_finish, "name binary, depth long, sha string")
    return runs.filter("sha is not null").select("name", "depth", "sha").unionByName(closed)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, with totals of their subtrees.

    Turns are ordered by turn (null first); turns of equal number by a digest
    of role and text.  Null roles and texts are empty.  Rows without conv_id
    are left out, repeated rows are turns like others, other columns are
    ignored.  An empty table has no nodes.

    Per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves (childless nodes of its subtree, itself included),
    saved_tokens (code points that sharing saves in its subtree), ends_sha256
    (of the ids of the conversations that end there).  (conv_id, depth) is
    unique.
    """
    spark = conversations.sparkSession
    prepare(spark)
    rows, lengths = rebuilt(ordered_turns(conversations))
    rows, lengths = stage(rows, "trie-rebuilt"), stage(lengths, "trie-lengths")
    deepest = lengths.agg(F.max("n_turns")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], NODE_SCHEMA)
    height = int(deepest).bit_length()
    paths = stage(_all_paths(rows, lengths, height), "trie-paths")

    turns = rows.select("conv_id", F.col("place").alias("depth"), "chars")
    members = paths.join(turns, ["conv_id", "depth"], "left")
    nodes = stage(members.groupBy("depth", "name").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "trie-nodes")
    # A node's parent is the prefix before it on its smallest member's path.
    step = nodes.filter("depth > 0").select("conv_id", "depth").join(
        paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent")), ["conv_id", "depth"])
    step = stage(step, "trie-steps")
    children = step.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    known = stage(nodes.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-known")
    own = stage(known.select(
        "depth", "name", "conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).alias("saved_tokens")), "trie-own")
    sums = grafted(own, paths, height, ["n_leaves", "saved_tokens"]).select("depth", "name", "n_leaves", "saved_tokens")

    ending = paths.join(lengths, "conv_id").filter("depth = n_turns").select("conv_id", "depth", "name")
    above = known.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = step.join(above, ["depth", "parent"]).select("conv_id", "depth", "parent_conv_id")
    result = known.join(sums, ["depth", "name"]).join(end_digests(ending), ["depth", "name"], "left").join(
        parents, ["conv_id", "depth"], "left")
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def _all_paths(rows: DataFrame, lengths: DataFrame, height: int) -> DataFrame:
    """Named prefixes of all conversations; turnless ones have the root only."""
    if not height:
        return lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"))
    none = lengths.filter("n_turns = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"))
    return named_prefixes(rows, height).select("conv_id", "depth", "name").unionByName(none)
