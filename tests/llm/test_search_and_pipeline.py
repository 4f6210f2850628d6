"""Nearest neighbours against brute force, and the corpus pipeline stage by stage."""

import math
import zlib
from collections import defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm.ann import CentroidGraph, IndexSettings, balanced_centroids, nearest
from ledgerlens.llm.exact_dedup import drop_copies
from ledgerlens.llm.mixing import apply_mix, mix_sources
from ledgerlens.llm.near_dup import drop_near_duplicates
from ledgerlens.llm.quality import Features, drop_poor, ratings_from_labels, train_quality
from samples import near_components

SMALL = "/root/testdata/sf0.001"


def _vectors(n: int, seed: int = 1, hot: int = 60):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, 16))) * rng.uniform(0.5, 2, (n, 1))
    x[100 : 100 + hot] = x[100]  # one vector many times
    return x.astype(np.float32)


def test_nearest_recall_and_exact_scores(spark):
    x = _vectors(1500)
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15),
           (2004, [float("inf")] + [1.0] * 15), (2005, [1.0, 2.0]), (None, [1.0] * 16), (7, x[7].tolist())]
    rows = [(i, v.tolist(), "label") for i, v in enumerate(x)] + [(i, v, "label") for i, v in bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")
    got = nearest(df, F.col("vec_id") % 20 == 0, settings=IndexSettings(list_rows=40, probes=24)).toPandas()
    wide = x.astype(float)
    hit = total = 0
    for q in range(0, 1500, 20):
        own = got[got.query_id == q].sort_values("rank")
        score = wide @ wide[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:20]
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, score[own.vec_id], rtol=1e-12)
        assert (np.lexsort((own.vec_id, -own.score)) == np.arange(20)).all()
        hit, total = hit + len(set(best) & set(own.vec_id)), total + 20
    assert hit / total >= 0.9
    assert not set(got.query_id) & {2000, 2001, 2002}


def test_nearest_reads_a_share_of_a_large_index(spark):
    x = np.random.default_rng(5).normal(size=(12_000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = range(0, 12_000, 100)
    got = nearest(df, F.col("vec_id") % 100 == 0, settings=IndexSettings(list_rows=64, probes=4)).toPandas().groupby("query_id")["vec_id"].agg(set)
    scores = x[asked].astype(float) @ x.T.astype(float)
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert sum(len(got[q] & set(own.tolist())) for q, own in zip(asked, best, strict=True)) >= 0.9 * best.size


def test_nearest_reads_bounded_blocks_of_queries(spark, monkeypatch):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_vectors(1500))], "vec_id long, embedding array<float>")
    settings = IndexSettings(list_rows=40, probes=24)
    whole = sorted(map(tuple, nearest(df, F.col("vec_id") % 5 == 0, settings=settings).collect()))
    apply = PandasCogroupedOps.applyInPandas

    def bounded(self, scan, schema):
        def checked(wanted, held):
            assert len(wanted) <= 60, len(wanted)
            return scan(wanted, held)
        return apply(self, checked, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", bounded)
    parts = nearest(df, F.col("vec_id") % 5 == 0, settings=replace(settings, query_rows=30, block_rows=2000)).collect()
    assert sorted(map(tuple, parts)) == whole and len(whole) == 6000


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_centroids_are_balanced_and_the_graph_finds_the_nearest():
    x = _vectors(800).astype(float)
    centroids = balanced_centroids(x, 64)
    assert len(centroids) == 64
    graph, found = CentroidGraph(centroids), 0
    for v in x[:200]:
        found += graph.search(v, 8)[0][0] == np.argmin(((centroids - v) ** 2).sum(1))
    assert found >= 195


def test_pipeline_stages_do_their_work(spark):
    docs = first = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SMALL).collect()
        seen[name] = rows
        docs = spark.createDataFrame(rows, first.schema)
        assert docs.columns == first.columns
    good = {r.doc_id for r in seen["quality"]}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert len(good & set(clean)) >= 0.95 * len(clean)
    plain = ["".join(r.text.split(" ")).translate({ord(c): None for c in "\t\n\v\f\r"}) for r in seen["exact_dedup"]]
    assert len(set(plain)) == len(plain) == len({"".join(r.text.split()) for r in seen["quality"]})
    parts = near_components([(r.doc_id, r.text) for r in seen["exact_dedup"]])
    assert {r.doc_id for r in seen["near_dedup"]} == {i for i, (_, c) in parts.items() if c == i}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in seen["mix"])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).agg(F.sum("length")).first()[0] == tokens


def test_stages_keep_columns_named_like_helpers(spark):
    names = ["__hash", "__id", "__text", "__N", "__quality", "__copy", "__whole", "__extra", "__size", "__source", "___hash", "keep", "taken"]
    plain = spark.createDataFrame(
        [(i, " ".join(f"w{i % 3}x{k}" for k in range(9 + i // 3 % 2)) if i else None, "en", f"s{i % 2}", 5) for i in range(9)],
        "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for work in (lambda d: drop_poor(d, labels), drop_copies, drop_near_duplicates, lambda d: apply_mix(d, mix_sources(d))):
        got, want = work(docs), work(plain)
        rows = got.collect()
        assert got.columns == docs.columns and rows
        assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in want.collect())
        assert all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)


def _plain_mix(rows, place):
    """(doc_id, text) of every repetition: capped water-filling by hand, the fraction drawn in the order of ``place``."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, budget = {s: 0.0 for s in names}, [s for s in names if sizes[s]], 1.5 * sum(sizes.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
            budget -= target[s]
        free = [s for s in free if s not in over] if over else []
    for s in names:
        own = sorted((r for r in rows if r.source == s), key=lambda r: place[r.doc_id])
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        left = round(target[s] - whole * sizes[s])
        for r in own:
            words = (r.text or "").encode().split()
            extra = min(left, len(words))
            left -= extra
            if words:
                yield from [(r.doc_id, r.text)] * (whole + (extra == len(words)))
                if 0 < extra < len(words):
                    yield r.doc_id, b" ".join(words[:extra]).decode()


def test_run_equals_five_plain_stages(spark):
    """Every piece of run() against a plain version of all five stages; only the model's fit and the draw's hash are Spark's."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = train_quality(docs, ratings_from_labels(spark.read.parquet(f"{SMALL}/labels.parquet")))
    features, rows = Features(), []
    for r in docs.collect():
        total = math.fsum(float(model.weights[k]) for k in features((r.text or "").encode()))
        if 0.5 * (1 + math.tanh(0.5 * (total - model.thresholds[-1]))) >= model.cutoff:
            rows.append(r)
    stays = {}
    for r in sorted(rows, key=lambda r: (-len(r.text or ""), r.doc_id)):
        stays.setdefault((r.text or "").encode().translate(None, b" \t\n\v\f\r"), r)
    parts = near_components([(r.doc_id, r.text) for r in stays.values()])
    rows = [r for r in stays.values() if parts[r.doc_id][1] == r.doc_id]
    drawn = docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text")).alias("place")).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(list)
    for doc, text in _plain_mix(rows, {r.doc_id: r.place % 2**64 for r in drawn}):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want[doc, len(ids)].append(ids)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r.doc_id, r.doc_tokens) for r in got} == set(want) and len(want) > 50
    times = {key: np.zeros(key[1], int) for key in want}
    for r in got:
        own = slice(r.start, r.start + r.length)
        assert r.ids_crc32 in {zlib.crc32(ids[own].tobytes()) for ids in want[r.doc_id, r.doc_tokens]}
        times[r.doc_id, r.doc_tokens][own] += 1
    assert all((times[key] == len(copies)).all() for key, copies in want.items())


def test_many_vectors_search_the_graph_at_once():
    """Each finds nearly all of its nearest centroids, in order, with their distances; there is no direct ranking beside it."""
    rng = np.random.default_rng(8)
    graph = CentroidGraph(rng.normal(size=(600, 24)))
    queries = rng.normal(size=(70, 24))
    found, far = graph.search_many(queries, 64)
    exact = np.sqrt(((queries[:, None, :] - graph.centroids[None, :, :]) ** 2).sum(2))
    want = np.argsort(exact, axis=1)[:, :64]
    assert np.mean([len(set(a) & set(b)) / 64 for a, b in zip(found, want, strict=True)]) > 0.95
    assert np.allclose(far, np.take_along_axis(exact, found, 1)) and (np.diff(far, axis=1) >= 0).all()
    assert all(len(set(row)) == 64 for row in found.tolist())
    few = CentroidGraph(rng.normal(size=(3, 24))).search_many(queries[:2], 64)[0]
    assert [sorted(r) for r in few.tolist()] == [[0, 1, 2]] * 2 and not hasattr(graph, "rank")
