"""Personal data, token counts, packing, mixing, quality and secrets."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm.mixing import apply_mix, mix_sources
from ledgerlens.llm.packing import capacities, pack, pack_documents
from ledgerlens.llm.pii import find_spans, luhn, mod97, pii_digest, pii_spans
from ledgerlens.llm.quality import drop_poor, fit_ordinal, quality_decisions, ratings_from_labels, score_quality, train_quality
from ledgerlens.llm import secret_scan
from ledgerlens.llm.secret_scan import FEATURES, scan_secrets
from ledgerlens.llm.token_counts import RankMerger, token_counts
from samples import corpus, frame, text_of

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_pii_equals_the_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a.b@c-d.example.org", "@", "x@y", "x@y.z@q.r", "10.0.0.255", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.1.1.01", "4111 1111-1111 1111",
             "4111111111111112", "12345678901234", "+1 (415) 555-0100", "+1", "+44 20 7946 0958.", "+", " ", "é", "😀", ".", "-", "7", "漢@a.b", "GB82 WEST 1234 5698 7654 32"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(14))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "9" * 50_000 + "." + "a" * 50_000)]
    got = {r.doc_id: r for r in pii_digest(pii_spans(frame(spark, rows))).collect()}
    for i, t in rows:
        want = plain_spans(t) if t and i < 1000 else []
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [s for s in got[i].spans.split(",") if s and s.split(":")[0] in PLAIN] == want
        assert got[i].n_card == sum(s.startswith("card") for s in want)
    assert pii_spans(frame(spark, [])).count() == 0


def test_pii_checks_and_context():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and mod97("GB82WEST12345698765432")
    assert [s["kind"] for s in find_spans("pay to GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert find_spans("nr 123-45-6789") == []
    assert [s["kind"] for s in find_spans("social security 123-45-6789")] == ["ssn"]


def test_token_counts_equal_the_library(spark):
    rng = random.Random(1)
    parts = ["a", "the", "aaaa", " ", "  ", "\n", "\t", "'s", "'ll", " ", "　", " ", "1", "23", "é", "漢", "😀", "<|endoftext|>",
             "<|", "\x1c", "\x85", "́", "-", "...", "\r\n", "\x00"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(1500)]
    rows += [(9000 + i, t) for i, t in corpus(5) if i is not None]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_counts(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 20).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 20), repr(t)[:80]
    assert token_counts(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_merges_of_long_runs():
    merger = RankMerger(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    runs = [c * n for c in "a=e!" for n in (1, 2, 3, 7, 50, 333)]
    assert merger.count(runs).tolist() == [len(library.encode(r).ids) for r in runs]


def test_packing_fills_sequences_exactly(spark):
    rows = [r for r in corpus(6) if r[0] is not None] + [(500, "same"), (500, "same"), (None, None), (None, "x")]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    got = pack_documents(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json"), shard_tokens=20_000).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: no padding
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in tokens)
    for i, ids in tokens:
        if sum(j == i for j, _ in tokens) > 1:
            continue
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    again = pack_documents(frame(spark, rows[::-1]), public_tokenizers.path("word_bpe_49k.json"), shard_tokens=20_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert pack_documents(frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_pack_balances_costs():
    assert capacities(4096 * 2 + 11, 4096) == [4096, 4096, 8, 2, 1]
    pieces = pack([3000, 3000, 1000, 1000, 96, 96], 4096)
    by = {}
    for d, _, n, s, _ in pieces:
        by.setdefault(s, []).append(n)
    assert sorted(map(sorted, by.values())) == [[96, 1000, 3000]] * 2


def test_mixing_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng, rng.randrange(120))) for i in range(400)] + [(900, None), (901, ""), (None, "a b c")]
    docs = frame(spark, rows)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            free.discard(s)
            left -= want[s]
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    assert sorted(map(str, mix_sources(docs.repartition(5)).collect())) == sorted(map(str, got))
    mixed = apply_mix(docs, mix_sources(docs))
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())
    assert mix_sources(docs.limit(0)).count() == 0


def _graded(n: int, seed: int):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice([0, 1, 2, 2])
        words = text_of(rng, rng.randrange(20, 60)).split()
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            words[rng.randrange(len(words))] = rng.choice(["scumbag", "scummy"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = _graded(500, 4)
    docs = frame(spark, rows + [(1000, None), (1001, "")])
    known = spark.createDataFrame(labels[:350] + [(2000, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality for r in quality_decisions(docs, known).collect()}
    right = sum(got[i].keep == (q == 1 and t == 0) for i, q, t in labels[350:])
    assert right >= 0.95 * 150 and len(got) == 502
    grades = [[got[i].expected_grade for i, q, t in labels[350:] if (q == 0, t == 1) == g] for g in ((True, False), (False, True), (False, False))]
    assert np.mean(grades[0]) < np.mean(grades[1]) < np.mean(grades[2])
    kept = drop_poor(docs, known)
    assert kept.columns == docs.columns and kept.select("keep").distinct().collect()[0][0] == "no"
    assert train_quality(docs, ratings_from_labels(known.limit(0))) is None
    assert quality_decisions(docs, known.limit(0)).filter("quality.keep").count() == 502
    assert quality_decisions(docs.limit(0), known).count() == 0


def test_quality_on_held_out_labels(spark):
    """A fifth of the labelled texts of sf0.1 is held out, copies of a text on one side."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").join(docs.select("doc_id", F.xxhash64("text").alias("h")), "doc_id")
    held = F.pmod("h", F.lit(5)) == 0
    model = train_quality(docs, ratings_from_labels(labels.filter(~held)))
    asked = ratings_from_labels(labels.filter(held)).dropDuplicates(["doc_id"])
    rows = score_quality(docs.join(asked, "doc_id"), model).select("grade", "quality.*").toPandas()
    good, place = (rows.grade == 2).to_numpy(), rows.top_probability.rank().to_numpy()
    auc = (place[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert len(rows) > 700 and auc > 0.97
    assert rows.keep[good].mean() > 0.95
    assert 1 - rows.keep[rows.grade == 0].mean() > 0.95 and 1 - rows.keep[rows.grade == 1].mean() > 0.75


def test_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 300)
    rows = [np.unique(rng.integers(10 * g, 10 * g + 12, 6)) for g in grades]
    model = fit_ordinal(rows, grades.tolist(), 3)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.array([model.weights[r].sum() for r in rows]))
    assert (np.diff(tails, axis=1) <= 0).all() and np.corrcoef(tails.sum(1), grades)[0, 1] > 0.8


def test_secrets_are_found_and_long_words_are_not(spark):
    rng = random.Random(9)
    rows, planted = [], {}
    for i in range(240):
        words = text_of(rng, 30).split() + ["".join(rng.choice("aeioulnrst") for _ in range(20)), "https://a.b/" + "path" * 6]
        if i % 3 == 0:
            value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            words.insert(7, f'token = "{value}"')
            planted[i] = value
        elif i % 7 == 0:
            planted[i] = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
            words.insert(3, planted[i])
        rows.append((i, " ".join(words)))
    docs = frame(spark, rows + [(500, None), (501, ""), (0, rows[0][1])])
    found = scan_secrets(docs).collect()
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] == r.value for r in found)
    assert {(r.doc_id, r.value) for r in found} == set(planted.items())
    assert sum(r.doc_id == 0 for r in found) == 2 and len(FEATURES) == 13
    assert scan_secrets(docs.limit(0)).count() == 0


def test_secrets_of_other_formats_are_no_negatives(spark):
    rng = random.Random(4)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, planted = [], {}
    for i in range(300):
        words = text_of(rng, 30).split() + ["".join(rng.choice("aeioulnrst") for _ in range(20)), "https://a.b/" + "path" * 6, "2024-01-01-0000-0000"]
        if i % 3 == 0:
            words.insert(7, 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"')
        elif i % 3 == 1:
            planted[i] = ("AIza" if i % 2 else "") + "".join(rng.choice(chars) for _ in range(36))
            words.insert(7, f'secret = "{planted[i]}"')
        rows.append((i, " ".join(words)))
    found = {(r.doc_id, r.value) for r in scan_secrets(frame(spark, rows)).collect()}
    assert set(planted.items()) <= found and len(found) == 200


def test_certain_secrets_are_reported_without_a_forest(spark):
    value = "AKIA" + "Q2" * 8
    found = scan_secrets(frame(spark, [(1, f"an id {value} here"), (2, "none")])).collect()
    assert [(r.doc_id, r.value, r.score) for r in found] == [(1, value, 1.0)]


def test_copies_do_not_fill_the_training_sample(spark, monkeypatch):
    rng = random.Random(6)
    own = ["AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)) for _ in range(12)]
    copied = "the copied text has " + " and ".join(own[:2]) + " and https://a.b/" + "path" * 6
    rows = [(i, copied) for i in range(300)] + [(1000 + i, f"{text_of(rng, 5)} {v} {'path' * 6}/x") for i, v in enumerate(own[2:])]
    staged, stage = {}, secret_scan.stage
    monkeypatch.setattr(secret_scan, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    found = scan_secrets(frame(spark, rows)).collect()
    assert staged["secret-sample"].filter("secret = 1").count() == 12
    assert len(found) == 610 and {r.value for r in found} == set(own)
