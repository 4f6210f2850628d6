"""Nearest neighbours by inner product over balanced posting lists.

Centroids come from a balanced tree of two-way splits over a bounded sample;
all vectors are indexed.  A vector joins the list of its nearest centroid and,
when it lies near a border, those of others not much farther.  Centroids are
searched through an in-memory neighbour graph, and a query reads the lists
whose distance is within a ratio of its nearest one, up to a share of all
lists, so that what is read follows the index.  Inner products become
distances by one more coordinate, sqrt(M^2 - |x|^2), M the largest norm.

Equal vectors are one posting that carries their smallest ids, as many as a
result can show, so that a vector held by a third of all rows is one entry.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import prepare, stage


@dataclass(frozen=True)
class IndexSettings:
    """Bounds and ratios of the index.  ``sample_rows`` bounds what the centroids are fitted to."""

    sample_rows: int = 20_000
    list_rows: int = 128          # vectors a list should hold
    most_lists: int = 4096        # centroids at most: their size is what executors keep in memory
    replicas: int = 4             # lists that a border vector joins at most
    border: float = 0.08          # joins those at most this share farther than the nearest
    ratio: float = 0.25           # a query reads lists at most this share farther than its nearest
    probes: int = 96              # and at most so many,
    share: float = 0.125          # or this share of all lists, where that is more
    group_lists: int = 32         # lists beside each other in the tree that are read together
    block_rows: int = 20_000      # a longer list is read as several blocks
    query_rows: int = 100_000     # and more queries than these in several parts


def balanced_centroids(points: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of the leaves of a tree whose splits halve their points."""
    random = np.random.default_rng(seed)
    leaves = [points]
    while len(leaves) < lists:
        largest = max(range(len(leaves)), key=lambda i: len(leaves[i]))
        own = leaves[largest]
        if len(own) < 2:
            break
        a, b = own[random.choice(len(own), 2, replace=False)]
        for _ in range(4):
            side = ((own - a) ** 2).sum(1) - ((own - b) ** 2).sum(1)
            order = np.argsort(side, kind="stable")
            half = len(own) // 2
            a, b = own[order[:half]].mean(0), own[order[half:]].mean(0)
        leaves[largest : largest + 1] = [own[order[:half]], own[order[half:]]]
    return np.array([own.mean(0) for own in leaves])


class CentroidGraph:
    """Best-first search over the graph of each centroid's nearest neighbours."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.centroids = centroids
        n = len(centroids)
        self.squares = squares = (centroids**2).sum(1)
        self.neighbours = []
        for i in range(n):
            d = squares - 2 * centroids @ centroids[i]
            d[i] = np.inf
            self.neighbours.append(np.argsort(d, kind="stable")[: min(degree, n - 1)])
        # Links lead both ways, so that no centroid is out of reach of those near it.
        back: list[list[int]] = [[] for _ in range(n)]
        for i, own in enumerate(self.neighbours):
            for j in own:
                back[j].append(i)
        self.neighbours = [np.unique(np.r_[own, back[i]]).astype(int) for i, own in enumerate(self.neighbours)]
        most = max(map(len, self.neighbours), default=0)
        self.table = np.full((n, most), -1)
        for i, own in enumerate(self.neighbours):
            self.table[i, : len(own)] = own
        self.entries = np.linspace(0, n - 1, min(n, max(8, math.isqrt(n)))).astype(int)

    def search(self, query: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found and their distances, nearest first, at most ``width``."""
        distance = lambda which: np.sqrt(((self.centroids[which] - query) ** 2).sum(1))
        seen = set(self.entries.tolist())
        found = list(zip(distance(self.entries).tolist(), self.entries.tolist(), strict=True))
        frontier = heapq.nsmallest(8, found)
        heapq.heapify(frontier)
        best = [(-d, c) for d, c in found]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while frontier:
            d, c = heapq.heappop(frontier)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = [n for n in self.neighbours[c].tolist() if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for own, n in zip(distance(fresh).tolist(), fresh, strict=True):
                if len(best) < width or own < -best[0][0]:
                    heapq.heappush(frontier, (own, n))
                    heapq.heappush(best, (-own, n))
                    if len(best) > width:
                        heapq.heappop(best)
        ranked = sorted((-d, c) for d, c in best)
        return np.array([c for _, c in ranked]), np.array([d for d, _ in ranked])

    def search_many(self, queries: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """As ``search`` for many queries at once, which go on in step: each looks behind its nearest few not yet looked behind."""
        n, rows = len(self.centroids), len(queries)
        width = min(width, n)
        lengths = (queries**2).sum(1)

        def distances(row: np.ndarray, which: np.ndarray) -> np.ndarray:
            out = np.empty(len(row))
            for start in range(0, len(row), 1 << 16):
                r, c = row[start : start + (1 << 16)], which[start : start + (1 << 16)]
                out[start : start + (1 << 16)] = lengths[r] + self.squares[c] - 2 * np.einsum("ij,ij->i", queries[r], self.centroids[c])
            return np.sqrt(np.maximum(0.0, out))

        seen = np.zeros((rows, n), bool)
        seen[:, self.entries] = True
        every = np.repeat(np.arange(rows), len(self.entries))
        found = np.tile(self.entries, (rows, 1))
        far = distances(every, found.ravel()).reshape(rows, -1)
        done = np.zeros(found.shape, bool)
        going = np.arange(rows)
        while len(going):
            pick = np.argsort(np.where(done[going], np.inf, far[going]), axis=1, kind="stable")[:, :step]
            at = np.repeat(going, pick.shape[1]).reshape(pick.shape)
            fresh = ~done[at, pick] & np.isfinite(far[at, pick])
            done[at, pick] = True
            near = self.table[found[at, pick][fresh]]
            row = np.repeat(at[fresh], near.shape[1])
            pairs = np.unique(row[near.ravel() >= 0] * n + near.ravel()[near.ravel() >= 0])
            row, which = pairs // n, pairs % n
            new = ~seen[row, which]
            row, which = row[new], which[new]
            seen[row, which] = True
            # The new ones of each row behind those it has; the nearest ``width`` stay.
            count = np.bincount(row, minlength=rows)
            more = int(count.max(initial=0))
            place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            wide_far = np.concatenate([far, np.full((rows, more), np.inf)], 1)
            wide_found = np.concatenate([found, np.zeros((rows, more), found.dtype)], 1)
            wide_done = np.concatenate([done, np.zeros((rows, more), bool)], 1)
            wide_far[row, found.shape[1] + place] = distances(row, which)
            wide_found[row, found.shape[1] + place] = which
            order = np.argsort(wide_far, axis=1, kind="stable")[:, :width]
            far, found, done = (np.take_along_axis(w, order, 1) for w in (wide_far, wide_found, wide_done))
            going = np.flatnonzero((~done & np.isfinite(far)).any(1))
        order = np.lexsort((found, far), axis=1)
        return np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)


_GRAPHS: list[tuple] = []


def _graph(shared) -> CentroidGraph:
    # Holds the broadcast too: a later one's id may equal that of one let go.
    if not _GRAPHS or _GRAPHS[0][0] is not shared:
        _GRAPHS[:] = [(shared, CentroidGraph(shared.value))]
    return _GRAPHS[0][1]


def usable(column: str) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(column).isNotNull() & fine & F.exists(column, lambda x: x != 0)


def _lists(frame: DataFrame, shared, largest: float, width: int, ratio: float, scale_to: float | None) -> DataFrame:
    """``frame`` (key, vec) with the column lists: those within 1 + ratio of the nearest, at most ``width``."""

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        graph = _graph(shared)
        x = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, graph.centroids.shape[1] - 1))
        norm = np.sqrt((x**2).sum(1))
        if scale_to is None:
            x = np.c_[x, np.sqrt(np.maximum(0.0, largest * largest - norm * norm))]
        else:
            x = np.c_[x * (scale_to / norm)[:, None], np.zeros(len(x))]
        lists, far = graph.search_many(x, max(width, 16))
        lists, far = lists[:, :width], far[:, :width]
        within = far <= far[:, :1] * (1 + ratio)
        return pd.Series([own[fine].tolist() for own, fine in zip(lists, within, strict=True)])

    return frame.withColumn("lists", near("vec"))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, settings: IndexSettings = IndexSettings(),
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest rows of each query row by inner product: query_id, rank, vec_id, score.

    Candidates are all rows but those with the query's own id; ties go to the
    smaller id; fewer than k candidates give fewer rows.  Vectors that are
    null, zero, of another length than most, or that hold null or non-finite
    components take no part.  Rows equal in id and vector count once.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.filter(usable(vector_col)).select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vec"), is_query.alias("is_query"))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    rows = rows.filter((F.size("vec") == common["n"]) & F.col("vec_id").isNotNull())
    # The smallest k + 1 ids of each distinct vector: k, and one more where the query itself is among them.
    key = rows.withColumn("key", F.xxhash64("vec")).select("key", "vec", "vec_id")
    first = Window.partitionBy("key", "vec").orderBy("vec_id")
    ids = key.withColumn("n", F.dense_rank().over(first)).filter(F.col("n") <= k + 1)
    distinct = stage(ids.groupBy("key", "vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "ann-vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    total, largest = distinct.agg(F.count("*"), F.max(norm)).first()
    if not total:
        return empty
    sample = distinct.select("key", "vec").orderBy("key").limit(settings.sample_rows).select("vec").collect()
    points = np.array([r["vec"] for r in sample], float)
    points = np.c_[points, np.sqrt(np.maximum(0.0, largest**2 - (points**2).sum(1)))]
    count = min(settings.most_lists, max(1, math.ceil(total / settings.list_rows)))
    shared = spark.sparkContext.broadcast(balanced_centroids(points, count))
    blocks = max(1, math.ceil(total * settings.replicas * settings.group_lists / count / settings.block_rows))

    group_of = lambda own: F.floor(own / settings.group_lists).cast("int")
    posted = _lists(distinct, shared, largest, settings.replicas, settings.border, None)
    posted = posted.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    posted = posted.select(F.explode("lists").alias("list"), "block", "vec", "ids").withColumn("group", group_of(F.col("list")))
    asked = rows.filter("is_query").select("vec_id", "vec").distinct().withColumn("key", F.xxhash64("vec"))
    queries = asked.select("key", "vec").distinct()
    parts = max(1, math.ceil(queries.count() / settings.query_rows))
    probes = max(settings.probes, math.ceil(count * settings.share))
    probed = _lists(queries, shared, largest, probes, settings.ratio, largest)
    # A query is one row per group, with the lists it reads there; its vector is not repeated for each list.
    probed = probed.withColumn("group", F.explode(F.array_distinct(F.transform("lists", group_of))))
    probed = probed.withColumn("lists", F.filter("lists", lambda own: group_of(own) == F.col("group"))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    posted = posted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def scan(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(held):
            return pd.DataFrame({"key": [], "vec_id": [], "score": []}).astype({"key": "int64", "vec_id": "int64", "score": float})
        q, x = np.stack(wanted["vec"]).astype(float), np.stack(held["vec"]).astype(float)
        ids, of_list = held["ids"].to_numpy(), held.groupby("list").indices
        near: dict[int, list[np.ndarray]] = {}
        asker: dict[int, int] = {}
        keys = wanted["key"].to_numpy()
        row_of, read = np.repeat(np.arange(len(wanted)), wanted["lists"].map(len)), np.concatenate(wanted["lists"].tolist())
        for number, places in pd.Series(read).groupby(read).indices.items():
            asking = row_of[places]
            own = of_list.get(number)
            if own is None:
                continue
            for start in range(0, len(asking), 256):
                some = asking[start : start + 256]
                for row, scores in zip(some, q[some] @ x[own].T, strict=True):
                    best = own
                    if len(own) > k + 1:
                        # A margin, as these sums' last digits may differ from the exact ones below.
                        least = np.partition(scores, len(own) - k - 1)[len(own) - k - 1]
                        best = own[scores >= least - 1e-9 * (abs(least) + 1)]
                    near.setdefault(keys[row], []).append(best)
                    asker[keys[row]] = row
        out = []
        for key, parts in near.items():
            rows = np.concatenate(parts)
            exact = (x[rows] * q[asker[key]]).sum(1)
            found = np.concatenate([ids[j] for j in rows]).astype(np.int64)
            score = np.repeat(exact, [len(ids[j]) for j in rows])
            # A vector may be in several of the lists.
            found, first = np.unique(found, return_index=True)
            best = np.lexsort((found, -score[first]))[: k + 1]
            out.append((np.full(len(best), key), found[best], score[first][best]))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame({"key": parts[0], "vec_id": parts[1], "score": parts[2]})

    hits = probed.groupBy("group", "block", "part").cogroup(posted.groupBy("group", "block", "part")).applyInPandas(
        scan, "key long, vec_id long, score double")
    per_vector = hits.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = per_vector.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k + 1)
    joined = asked.select(F.col("vec_id").alias("query_id"), "key").join(top.select("key", "vec_id", "score"), "key")
    joined = joined.filter("vec_id != query_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = joined.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
