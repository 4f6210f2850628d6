"""Near duplicates: an exact join in the metric space of Jaccard distance over word shingles.

The distance 1 - J of shingle sets is a metric, and pairs within radius
1 - threshold are wanted.  Sets that are equal are one point first.

Cells.  The first pivots are sets of one shingle.  A set is nearest to the
pivots of its own shingles, all equally near; a global order of shingles breaks
the tie.  Two sets within the radius differ in so few shingles that both still
contain their first common one when each keeps, of its n shingles, the first
n - ceil(threshold * n) + 1 in that order.  So a set is replicated into the
cells of that window, and every wanted pair meets in a cell.  The order is by
hash, with shingles that occur in very many windows moved to the end, which
keeps text that unrelated documents repeat out of the windows.  Shingles with
the same points are one cell, which weighs as many as it stands for.

Regions.  Within the cells, documents are pivots: the one that shares most of
its cells with others.  Each point goes to the region of the pivot it shares
most cells with, its distance to it is computed, and it is linked to it when
within the radius.  This is repeated for points that are not linked to the
pivot, and then the cells whose points are not yet one component are joined
directly.  Each point has its cells in one order, and a pair is passed over in
a cell where both have the same cell among the last few before: it meets there
already, so its first common cell never drops it.  Other pairs are left out
only by bounds on their distance: by their sizes, by the triangle inequality
through their pivot, and by the parities of their shingles over classes, whose
difference never exceeds that of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, distinct_sorted, gram_hashes, own_prefix, packed_texts, prepare, stage, unpacked, utf8, word_array
from ledgerlens.llm.components import joined_components

SHINGLE = 5
#: Wanted are pairs with 100 * intersection >= PERCENT * union.
PERCENT = 80
#: At most so many shingles are moved to the end of the order; bounds what is broadcast.
HOT_SHINGLES = 1_000_000
#: A shingle in fewer windows than this is never moved.
HOT_LEAST = 100
ORDER_ROUNDS = 2
PIVOT_ROUNDS = 2
#: Cells before this one that a point of a cell remembers.
EARLIER = 8
SKETCH_WORDS = 4
SHORT = [f"k{i}" for i in range(SKETCH_WORDS)]


def shingle_set(text: bytes, length: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles: of all words together if they are fewer; empty without words."""
    words = word_array(text.lower())
    return distinct_sorted(gram_hashes(words, min(length, len(words)))) if len(words) else words


def parity_sketch(values: np.ndarray) -> np.ndarray:
    """For each of so many classes of shingles, whether the set holds an odd number of them, as 64-bit words.

    The classes are a power of two, at least 256 and at least as many as the
    shingles.  A sketch of twice the classes is folded to one of these by the
    exclusive or of its halves.
    """
    classes = 64 * SKETCH_WORDS
    while classes < len(values):
        classes *= 2
    odd = np.bincount((values >> np.uint64(13) & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def short_sketch(sketch: np.ndarray) -> list[int]:
    """The sketch folded to the fewest classes."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH_WORDS), axis=0).tolist()


def window_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def window_of(own: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` of the shingles when those in ``last`` (sorted) come after all others; only as many as it takes are looked up."""
    if not len(last):
        return own[:size]
    for seen in (own[:size], own[: 2 * size], own):
        late = last[np.minimum(np.searchsorted(last, seen), len(last) - 1)] == seen
        others = seen[~late]
        if len(others) >= size:
            return others[:size]
    return np.concatenate([others, own[late]])[:size]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8().alias("text"))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _points(docs: DataFrame, length: int, percent: int) -> DataFrame:
    """Per row: the size of its set, a digest of it, its sketches, its window."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, length) for t in batch.column("text").to_pylist()]
            sketches = [parity_sketch(s) for s in sets]
            windows = [s[: window_size(len(s), percent)].view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 *[pa.array(c, pa.int64()) for c in zip(*map(short_sketch, sketches), strict=True)],
                 pa.array(sketches, pa.list_(pa.int64())), pa.array(windows, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "digest", *SHORT, "sketch", "shingles"])

    return _texts(docs).mapInArrow(
        take, f"doc_id {_id_type(docs)}, text_hash long, n long, digest binary, {', '.join(f'{k} long' for k in SHORT)}, "
              "sketch array<long>, shingles array<long>")


def _windows(docs: DataFrame, length: int, percent: int, last: np.ndarray) -> DataFrame:
    """Per row with words: the shingles of its window, those in ``last`` coming after all others."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(last))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, length)
                if not len(own):
                    found.append(None)
                    continue
                found.append(window_of(own, hot, window_size(len(own), percent)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "shingles"])

    return _texts(docs).mapInArrow(take, f"doc_id {_id_type(docs)}, text_hash long, shingles array<long>")


def _sets(texts: DataFrame, length: int) -> DataFrame:
    """(id, members): whole sets, for the points that are compared.

    Rows that repeat a point come one after another, sorted by the join; the first counts.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids, sets = [], []
            for i, packed in zip(batch.column("id").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if i != last:
                    last = i
                    ids.append(i)
                    sets.append(shingle_set(unpacked(packed), length).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(sets, pa.list_(pa.int64()))], names=["id", "members"])

    return texts.select("id", "packed").mapInArrow(take, f"id {texts.schema['id'].dataType.simpleString()}, members array<long>")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches (columns with suffixes ``a`` and ``b``) allow the pair."""
    m, n = F.col(f"n{a}"), F.col(f"n{b}")
    sizes = (100 * m >= percent * n) & (100 * n >= percent * m)
    odd = sum((F.bit_count(F.col(f"k{i}{a}").bitwiseXOR(F.col(f"k{i}{b}"))) for i in range(1, SKETCH_WORDS)),
              F.bit_count(F.col(f"k0{a}").bitwiseXOR(F.col(f"k0{b}"))))
    # |A symmetric difference B| <= (1 - t) / (1 + t) * (|A| + |B|) within the radius.
    return sizes & (odd * F.lit(100 + percent) <= F.lit(100 - percent) * (m + n))


def _likely(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and whole sketches allow, written."""
    sides = [points.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in ("a", "b")]
    m, n = F.col("na"), F.col("nb")
    both = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b")
    both = both.filter((100 * m >= percent * n) & (100 * n >= percent * m))
    words = F.least(F.size("sa"), F.size("sb"))

    def folded(name: str) -> Column:
        # Sizes that may link differ by less than two, and so do the numbers of classes at most twofold.
        halves = F.zip_with(F.slice(name, F.lit(1), words), F.slice(name, words + 1, words), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) > words, halves).otherwise(F.col(name))

    odd = F.aggregate(F.zip_with(folded("sa"), folded("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return stage(both.filter(odd * F.lit(100 + percent) <= F.lit(100 - percent) * (m + n)).select("a", "b"), "likely")


def _distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance, linked) of the pairs, from their whole sets."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("mb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ma", "mb")).cast("long")
    both = both.select("a", "b", common.alias("common"), (F.size("ma") + F.size("mb")).cast("long").alias("total"))
    union = F.col("total") - F.col("common")
    return both.select("a", "b", (1 - F.col("common") / union).alias("distance"),
                       (100 * F.col("common") >= percent * union).alias("linked"))


def _cells(docs: DataFrame, table: DataFrame, points: DataFrame, length: int, percent: int) -> DataFrame:
    """(shingle, weight, id) of every cell with at least two points, written; weight: shingles with these points."""
    mine = points.select("id", F.col("text_hash").alias("own"))
    n = F.col("n")
    total = points.agg(F.sum(n - F.ceil(F.lit(percent) * n / 100) + 1)).first()[0] or 0
    # At most HOT_SHINGLES shingles can be found in so many windows, over all rounds.
    least = max(HOT_LEAST, int(total) * (ORDER_ROUNDS + 1) // HOT_SHINGLES)

    def of_points(found: DataFrame) -> DataFrame:
        found = found.join(mine, (F.col("doc_id") == F.col("id")) & (F.col("text_hash") == F.col("own")))
        return stage(found.select("id", "shingles"), "shingle-windows")

    windows = of_points(table.select("doc_id", "text_hash", "shingles"))
    last = np.array([], np.uint64)
    for _ in range(ORDER_ROUNDS):
        counts = windows.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count()
        often = counts.filter(F.col("count") > least).select("shingle").collect()
        fresh = np.setdiff1d(np.array([r[0] for r in often], np.int64).view(np.uint64), last)
        if not len(fresh):
            break
        last = np.r_[last, fresh]
        discard(windows)
        windows = of_points(_windows(docs, length, percent, last))
    held = windows.select("id", F.explode("shingles").alias("shingle"))
    several = held.groupBy("shingle").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("points"), *[
        F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"mark{seed}") for seed in (0, 1)]).filter("low < high")
    alike = several.groupBy("low", "high", "points", "mark0", "mark1").agg(F.min("shingle").alias("shingle"), F.count("*").alias("weight"))
    cells = stage(held.join(stage(alike.select("shingle", "weight"), "shingle-several"), "shingle"), "shingle-cells")
    discard(windows)
    return cells


def link_components(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows with the id of their set's first row, and the components of those ids."""
    table = stage(_points(docs, length, percent), "shingle-points")
    # The first row of every distinct set stands for it.  Written, as are other counts by key
    # below: then the join deals both sides out itself and can split a hot key.
    first = stage(table.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id")), "shingle-first")
    rows = stage(table.select("doc_id", "text_hash", "n", "digest").join(first, "digest", "left").drop("digest"), "shingle-rows")
    own = first.select(F.col("digest").alias("of"), "id")
    points = table.join(own, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("id")))
    points = points.groupBy("id").agg(F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("n", *SHORT, "sketch")])
    points = stage(points, "shingle-distinct")
    cells = _cells(docs, table, points, length, percent)
    discard(table)
    # Points that share no cell are alone; the others are compared.
    weight = cells.groupBy("id").agg(F.sum("weight").alias("cells"))
    known = stage(points.join(weight, "id"), "shingle-active")
    discard(points)
    active = known.select("id", F.col("text_hash").alias("own"))
    texts = packed_texts(docs).join(active, (F.col("doc_id") == F.col("id")) & (F.col("text_hash") == F.col("own")))
    sets = stage(_sets(texts, length), "shingle-sets")
    labels, reached, distances = None, None, None
    for _ in range(PIVOT_ROUNDS):
        # The pivot of a cell: of its points outside the component of its last pivot, the one in most cells.
        open_ = cells
        if labels is not None:
            open_ = open_.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            open_ = stage(open_.join(reached, "shingle").filter("component != pivot_component").select("shingle", "weight", "id"), "cells-left")
        ranked = open_.join(known.select("id", "cells"), "id").groupBy("shingle")
        pivots = ranked.agg(F.max(F.struct("cells", (-F.col("id")).alias("order"))).alias("p"))
        pivots = stage(pivots.select("shingle", (-F.col("p.order")).alias("b")), "pivots")
        # A point belongs to the region of the pivot that it shares most cells with.
        region = open_.join(pivots, "shingle").filter("id != b").groupBy("id", "b").agg(F.sum("weight").alias("shared"))
        region = region.groupBy("id").agg(F.max(F.struct("shared", (-F.col("b")).alias("order"))).alias("r"))
        region = _likely(region.select(F.col("id").alias("a"), (-F.col("r.order")).alias("b")), known, percent)
        measured = stage(_distances(region, sets, percent), "regions")
        labels = joined_components(labels, measured.filter("linked"))
        reached = stage(pivots.join(labels.withColumnRenamed("id", "b"), "b", "left").select(
            "shingle", F.coalesce("component", "b").alias("pivot_component")), "pivots-reached")
        distances = measured if distances is None else distances.union(measured)
    links = stage(_rest(cells, known, labels, distances, sets, percent), "links")
    discard(sets)
    return rows, joined_components(labels, links)


def _rest(cells: DataFrame, known: DataFrame, labels: DataFrame, distances: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in a cell."""
    of = cells.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of = stage(of.select("shingle", "id", "component"), "cells-labelled")
    mixed = of.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = stage(mixed.filter("low < high").select("shingle"), "cells-open")
    held = of.join(mixed, "shingle").join(known.select("id", "n", *SHORT), "id")
    # The distance to the first pivot that was measured, for the bound by the triangle inequality.
    pivot = distances.groupBy("a").agg(F.min(F.struct("b", "distance")).alias("p"))
    held = held.join(pivot.select(F.col("a").alias("id"), F.col("p.b").alias("pivot"), F.col("p.distance").alias("far")), "id", "left")
    before = Window.partitionBy("id").orderBy("shingle").rowsBetween(-EARLIER, -1)
    held = stage(held.withColumn("earlier", F.collect_list("shingle").over(before)), "cells-mixed")
    left, right = (held.select("shingle", *[F.col(c).alias(c + x) for c in held.columns if c != "shingle"]) for x in ("a", "b"))
    near = (F.col("pivota") != F.col("pivotb")) | (F.abs(F.col("fara") - F.col("farb")) <= F.lit((100 - percent) / 100 + 1e-9))
    pairs = left.join(right, "shingle").filter(
        (F.col("ida") < F.col("idb")) & (F.col("componenta") != F.col("componentb"))
        & _may_link("a", "b", percent) & F.coalesce(near, F.lit(True)) & ~F.arrays_overlap("earliera", "earlierb"))
    pairs = _likely(pairs.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct(), known, percent)
    return _distances(pairs, sets, percent).filter("linked").select("a", "b")


def near_duplicates(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id): the smallest doc_id that links reach.

    Words are split by ASCII white space and A-Z count as a-z.  Fewer words
    than a shingle are one shingle; texts that are null or without words are
    empty sets, linked with nothing.  A null doc_id links only through an equal
    set.  Rows equal in doc_id and text are alike.  An empty table gives an
    empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows, labels = link_components(docs, length, percent)
    labelled = rows.join(labels, "id", "left")
    return labelled.select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                           F.coalesce("component", "id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents whose doc_id is their component's: one of each group of near duplicates, with all columns, of any name."""
    own = own_prefix(docs)
    found = near_duplicates(docs, length, percent)
    gone = stage(found.filter("component_id < doc_id").select(F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}text"))
                 .distinct(), "near-duplicates")
    keyed = docs.withColumn(f"{own}hash", F.xxhash64("text"))
    return keyed.join(gone, (F.col("doc_id") == F.col(f"{own}id")) & (F.col(f"{own}hash") == F.col(f"{own}text")), "left_anti").select(*docs.columns)
