"""Exact, substring and near-duplicate detection against brute force."""

import hashlib
import random

import numpy as np
import pytest

from ledgerlens.llm.common import distinct_sorted, gram_hashes, slide, word_array
from ledgerlens.llm.components import components, joined_components
from ledgerlens.llm.exact_dedup import drop_copies, exact_dedup
from ledgerlens.llm.fm_index import FMIndex
from ledgerlens.llm.near_dup import drop_near_duplicates, near_duplicates, parity_sketch, short_sketch, window_of, window_size
from ledgerlens.llm.substring_dedup import substring_dedup
from samples import corpus, frame, kept_words, near_components, text_of

DROP = {ord(c): None for c in " \t\n\v\f\r"}


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_dedup_equals_grouping(spark, fan_in):
    rows = corpus(2)
    got = {r.doc_id: r for r in exact_dedup(frame(spark, rows).repartition(7), fan_in).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(DROP), []).append((-len(t or ""), i))
    for i, t in rows:
        group = groups[(t or "").translate(DROP)]
        keep = min(group)[1]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(group), keep == i)
        assert got[i].text_sha256 == hashlib.sha256((t or "").translate(DROP).encode()).hexdigest()


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    rows = [(4, "a b"), (4, "a b"), (None, "ab"), (2, "a  b"), (9, "c"), (9, "c")]
    got = exact_dedup(frame(spark, rows)).collect()
    assert [r.group_size for r in got if r.keep_id == 2] == [4] * 4
    assert sum(r.kept for r in got) == 2
    kept = drop_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "a  b"), (9, "c")]
    assert exact_dedup(frame(spark, [])).count() == 0


def test_slide_and_grams():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 40).astype(np.uint64)
    for width in (1, 2, 5, 16, 25, 40):
        want = [values[k : k + width].min() for k in range(len(values) - width + 1)]
        assert slide(values, width, np.minimum).tolist() == want
        grams = gram_hashes(np.r_[values, values], width)
        assert len(grams) == 81 - width and (grams[: 41 - width] == grams[40 : 81 - width]).all()


@pytest.mark.parametrize("symbols,depth", [(2, 6), (4, 6), (4, 13), (1, 9), (40, 3)])
def test_fm_index_gives_matching_statistics_and_all_places(symbols, depth):
    rng = np.random.default_rng(symbols * depth)
    texts = [rng.integers(1, symbols + 1, rng.integers(1, 90)) for _ in range(9)]
    texts.append(np.r_[texts[0], texts[1]])
    index = FMIndex(texts, depth)
    held = [t.tobytes() for t in texts]
    foreign = [rng.integers(1, symbols + 2, 60) for _ in range(3)]
    for asked, least in ((texts, 2), (foreign, 1)):
        length, low, high = index.matches(asked, least)
        at = 0
        for text in asked:
            for k in range(len(text)):
                want = 0
                for n in range(1, min(depth, len(text) - k) + 1):
                    part = text[k : k + n].tobytes()
                    places = [s + i // 8 for s, t in zip(index.starts.tolist(), held, strict=True)
                              for i in range(0, len(t), 8) if t[i : i + 8 * n] == part]
                    if len(places) < least:
                        break
                    want, found = n, places
                assert length[at] == want
                if want:
                    assert sorted(index.locate(np.arange(low[at], high[at])).tolist()) == found
                at += 1


def test_fm_index_is_small():
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 3000, 75) for _ in range(1000)]
    index = FMIndex(texts, 50)
    arrays = [index.starts, index.first, index.positions, index.sampled.words, index.sampled.before, index.bwt.base, *index.common.levels]
    arrays += [a for _, bits, _ in index.bwt.levels for a in (bits.words, bits.before)]
    assert sum(a.nbytes for a in arrays) < 8 * index.size and not hasattr(index, "order")


@pytest.mark.parametrize("seed,window", [(3, 50), (4, 10)])
def test_substring_dedup_equals_brute_force(spark, seed, window):
    rows = corpus(seed)
    want = kept_words(rows, window)
    got = {r.doc_id: r for r in substring_dedup(frame(spark, rows), window).collect()}
    assert set(got) == set(want) and any(n for n, _ in want.values())
    for i, (gone, kept) in want.items():
        assert got[i].n_removed == gone
        assert got[i].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
        assert sum(s.end - s.start for s in got[i].removed) == gone


def test_substring_dedup_repeated_rows_nulls_and_empty_table(spark):
    rng = random.Random(5)
    long = text_of(rng, 60)
    rows = [(3, long), (3, long), (None, long), (8, "x " + long), (1, None)]
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup(frame(spark, rows)).collect()), key=str)
    assert got == [(1, 0), (3, 0), (3, 0), (8, 60), (None, 0)]
    assert substring_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [6, 7])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = corpus(seed, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == near_components(rows)


def test_near_duplicates_threshold_chains_and_hot_passage(spark):
    rng = random.Random(8)
    base = text_of(rng, 104).split()
    passage = text_of(rng, 30)
    rows = [(0, " ".join(base)), (1, " ".join(base[:-10])), (2, " ".join(base[:-30]))]  # 90 % and 70 % of the shingles
    rows += [(10 + k, f"{passage} {text_of(rng, 40)}") for k in range(130)]  # more than HOT_LEAST texts share a passage
    rows += [(200, rows[9][1].replace(passage, passage + " end"))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == near_components(rows)
    kept = drop_near_duplicates(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if c == i}
    assert kept.columns == frame(spark, rows).columns


@pytest.mark.parametrize("edits", [3, 9])
def test_near_duplicates_of_families_around_the_radius(spark, edits):
    # Texts of a family share many cells, are mostly farther apart than the radius, and link in chains.
    rng = random.Random(edits)
    rows, passage = [], text_of(rng, 60)
    for family in range(4):
        words = f"{passage} {text_of(rng, 90 + 60 * family)}".split()
        for _ in range(35):
            copy = list(words)
            for _ in range(rng.randrange(1, edits)):
                copy[rng.randrange(len(copy))] = rng.choice("pqrst") + str(rng.randrange(99))
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                words = copy
    want = near_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) >= (4 if edits == 3 else 20)


def test_near_duplicates_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c"), (7, "A B C"), (7, "A B C"), (4, "a b c"), (5, None), (None, "")]
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == [(4, 4), (5, 5), (7, 4), (7, 4), (None, 4), (None, None)]
    assert near_duplicates(frame(spark, [])).count() == 0


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.r_[a[: rng.integers(0, 300)], rng.integers(0, 2**63, 20).astype(np.uint64)])
        odd = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(short_sketch(parity_sketch(a)), short_sketch(parity_sketch(b)), strict=True))
        assert odd <= len(np.setxor1d(a, b))
        assert len(parity_sketch(a)) == 8 and len(parity_sketch(a[:256])) == 4
    assert [window_size(n, 80) for n in (1, 4, 5, 10, 11)] == [1, 1, 2, 3, 3]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(1, k) for k in range(2, 40)]
    labels = components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long"))
    got = {r.id: r.component for r in labels.collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[k] == 1 for k in range(1, 40))
    more = joined_components(labels, spark.createDataFrame([(140, 30), (500, 501)], "a long, b long"))
    got = {r.id: r.component for r in more.collect()}
    assert got[120] == 1 and got[501] == 500 and len(got) == 41 + 39 + 2


def test_windows_with_shingles_moved_to_the_end():
    rng = random.Random(8)
    for n in (1, 2, 5, 40):
        own = np.array(sorted(rng.sample(range(100), n)), np.uint64)
        for moved in (0, 1, 30, 90, 100):
            last = np.array(sorted(rng.sample(range(100), moved)), np.uint64)
            for size in {1, window_size(n, 80), n}:
                late = set(last.tolist())
                want = sorted(own.tolist(), key=lambda v: (v in late, v))[:size]
                assert window_of(own, last, size).tolist() == want


def test_words_and_distinct_values_of_short_texts():
    for text in (b"", b" ", b"a", b" a", b"a ", b"a b", b"\ta\r\nbb  a", b"\x1fa\x0b\xc3\xa9"):
        words = word_array(text)
        alone = [word_array(w)[0] for w in text.replace(b"\x0b", b" ").split()]
        assert words.tolist() == [int(w) for w in alone]
        assert distinct_sorted(words).tolist() == sorted({int(w) for w in alone})
