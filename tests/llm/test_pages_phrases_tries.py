"""Main text of pages, phrase collocations and the prefix trie against brute force and held-out pages."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import collocations as phrase_module
from ledgerlens.llm.boosting import BoostedTrees
from ledgerlens.llm.collocations import collocations, compacted, gram_counts, nodes_of, shorter_counts
from ledgerlens.llm.dom import Page
from ledgerlens.llm.html_extract import decode, default_extractor, extract_text, labels_of
from ledgerlens.llm.layouts import MAIN, REST, Layout, plain
from ledgerlens.llm.prefix_trie import conversation_trie

PAGE_SCHEMA = "page_id long, url string, html string, text string, n_chars int"


# ---- pages

def test_reader_follows_the_standard():
    def runs(html):
        return [t for _, t in Page(html).runs]

    assert runs("<p>a<p>b &amp; c&nbsp;d<br>e</p>tail") == ["a", "b & c d e", "tail"]
    assert runs("x<!-- <p>no</p> --><script>if (a<b) '</p>'</script>y<style>p{}</style>") == ["x y"]
    assert runs("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert runs("1 < 2 <b>bold") == ["1 < 2 bold"]
    assert runs("end <a href='cut") == ["end"]
    assert runs("<p title=\"a>b\">x</p></div></p><!doctype html>y") == ["x", "y"]
    assert runs("") == [] and runs("<!-- open") == [] and runs("</>") == [] and runs("&am") == ["&am"]


def test_reader_is_linear():
    for bad in ("<!--" * 200_000, "<a b=\"" * 200_000, "<p" * 200_000, "<div>" * 50_000, "</" * 200_000, "&" * 300_000, "<a x='" + "y" * 300_000):
        Page(bad)


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = np.where(x[:, 0] > 0.6, 2, (x[:, 1] + x[:, 2] > 1).astype(int))
    model = BoostedTrees(3).fit(x[:3000], y[:3000])
    assert (model.predict(x[3000:]).argmax(1) == y[3000:]).mean() > 0.93


def test_decoding_never_contradicts():
    model = default_extractor()
    for seed in range(40):
        page = Page(plain(Layout(50_000 + seed).html))
        logs = np.log(model.chances([page]))
        logs = logs[np.random.default_rng(seed).permutation(len(logs))]  # any chances at all
        keep = decode(page, logs)
        assert len(keep) == len(page.tag)
        # Under an element read as a whole, all agree: brute force over single readings.
        whole = [decode(page, np.tile([0.0, -9.0, -99.0], (len(logs), 1))), decode(page, np.tile([-9.0, 0.0, -99.0], (len(logs), 1)))]
        assert all(whole[0][n] for n, _ in page.runs) and not any(whole[1][n] for n, _ in page.runs)


def test_held_out_layouts():
    """Pages of other seeds than the fitted ones: words found and words wrongly kept."""
    model = default_extractor()
    hit = extra = lost = 0
    for seed in range(150):
        html = Layout(90_000 + seed).html
        want = Counter(w for _, t in Page(html).runs if MAIN in t and REST not in t for w in plain(t).split())
        got = Counter(model.texts([plain(html)])[0].split())
        hit, extra, lost = hit + (want & got).total(), extra + (got - want).total(), lost + (want - got).total()
    assert hit / (hit + extra) > 0.97 and hit / (hit + lost) > 0.97
    assert set(np.unique(labels_of(Page(Layout(1).html)))) <= {-1, 0, 1, 2}


def test_pages_table_and_odd_rows(spark):
    rows = [(1, None, None, "x", 1), (2, "u", "", "x", 1), (None, "v", "<p>", None, None), (3, "w", "<nav><a href=x>Menu</a></nav>", "", 0),
            (4, "z", "<article><p>" + "wort und satz. " * 60_000 + "</p></article><footer>Ende</footer>", "", 0)]
    rows.append(rows[-1])
    got = extract_text(spark.createDataFrame(rows, PAGE_SCHEMA)).collect()
    assert got[0].asDict() == {"page_id": 1, "url": None, "text": "", "n_chars": 0}
    assert [r.text for r in got[1:4]] == ["", "", ""]
    assert got[4].text == got[5].text == ("wort und satz. " * 60_000).strip() and got[4].n_chars == len(got[4].text)
    assert extract_text(spark.createDataFrame([], PAGE_SCHEMA)).count() == 0


def test_pages_of_the_test_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    good = 0
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", row.html, re.S)[1]
        blocks = [" ".join(b.replace("<br>", " ").replace("<b>", "").replace("&amp;", "&").replace("&quot;", '"').split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        good += got[row.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[row.page_id].n_chars == len(got[row.page_id].text)
    assert good >= 0.98 * len(got)


# ---- phrases

def phrases(rows, least, most):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\v\f\r]", folded):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for size in range(1, 6):
                count[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in count.items():
        candidates = {p: n for p, n in counts.items() if len(p) > 1 and n >= least}
        held = Counter()
        for q, n in candidates.items():
            for size in range(2, len(q)):
                for k in range(len(q) - size + 1):
                    held[q[k : k + size]] = max(held[q[k : k + size]], n)
        best = []
        for p, a in candidates.items():
            if 100 * held[p] < 100 * a:
                score, cut = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def spoken(seed, n=60):
    rng = random.Random(seed)
    words = ["Of", "the", "a", "cat", "dög", "ran", "漢", "x-y"] + [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words[:8] if rng.random() < 0.7 else words) + rng.choice(["  ", " ", " ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(120)))
        rows.append((rng.choice(["en", "de", None]), text + " the very same long passage of words that repeats" * rng.randrange(3)))
    return rows + [("en", None), ("fr", ""), (None, " .,\t"), ("en", "the cat " * 40_000), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "least", "most"), [(1, 5, 2000), (2, 12, 15)])
def test_collocations_equal_brute_force(spark, seed, least, most):
    rows = spoken(seed)
    docs = spark.createDataFrame([(k, t, lang, "g", 3, 1) for k, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, gram string, n int, size int").repartition(5)
    got = sorted(tuple(r) for r in collocations(docs, least, most).collect())
    assert got == phrases(rows, least, most)
    assert collocations(docs.limit(0), least, most).count() == 0


def test_compaction_loses_nothing(spark):
    rng = random.Random(4)
    edges = Counter()
    texts = [[rng.choice("abcd") for _ in range(rng.randrange(4, 30))] for _ in range(30)] + [[f"u{k}" for k in range(80)]] * 7
    ends = Counter()
    for t in texts:
        edges.update(" ".join(t[k : k + 5]) for k in range(len(t) - 4))
        ends[" ".join(t[-4:])] += 1
    e = spark.createDataFrame([("en", g, 5, n) for g, n in edges.items()], "lang string, gram string, size int, n long")
    f = spark.createDataFrame([("en", g, 4, n) for g, n in ends.items()], "lang string, gram string, size int, n long")
    paths = compacted(e, nodes_of(e, f), rounds=8)
    rows = paths.collect()
    again = Counter()
    for r in rows:
        w = r.words.split(" ")
        for k in range(len(w) - 4):
            again[" ".join(w[k : k + 5])] += r.n
    assert again == edges and len(rows) < len(edges) and max(len(r.words.split()) for r in rows) > 6
    for size, table in zip((4, 3, 2, 1), shorter_counts(paths, f), strict=True):
        want = Counter(" ".join(t[k : k + size]) for t in texts for k in range(len(t) - size + 1))
        assert {r.gram: r.n for r in table.collect()} == want


def test_gram_counts_are_complete(spark):
    texts = spark.createDataFrame([("en", b"a b c d e f g"), ("en", b"a b c d e. b c")], "lang string, text binary")
    grams, totals = gram_counts(texts, 2)
    assert {r.gram: r.n for r in grams.collect()} == {
        "a": 2, "b": 3, "c": 3, "d": 2, "e": 2, "a b": 2, "b c": 3, "c d": 2, "d e": 2, "a b c": 2, "b c d": 2, "c d e": 2,
        "a b c d": 2, "b c d e": 2, "a b c d e": 2}
    assert [tuple(r) for r in totals.collect()] == [("en", 14)]


def test_grams_around_rare_triples_stay_out_of_the_graph(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for k in range(250):
        noise = [rng.choice("abcdefgh") for _ in range(20)]
        at = rng.randrange(20)
        rows.append(" ".join(noise[:at] + "the same six words come again".split() * (k % 3 == 0) + noise[at:]) + rng.choice([".", "", "\na b"]))
    want = Counter()
    for piece in (p.split() for r in rows for p in re.split(r"[.\n]", r)):
        want.update((" ".join(piece[k : k + size]), size) for size in range(1, 6) for k in range(len(piece) - size + 1))
    edges, compact = [], compacted
    monkeypatch.setattr(phrase_module, "compacted", lambda e, n: edges.append(e.count()) or compact(e, n))
    texts = spark.createDataFrame([("en", r.encode()) for r in rows], "lang string, text binary").repartition(3)
    grams, _ = gram_counts(texts, 40)
    assert Counter({(r.gram, r["size"]): r.n for r in grams.collect()}) == {g: n for g, n in want.items() if n >= 40}
    assert sum(n >= 40 for (_, size), n in want.items() if size == 2) > 60
    # Two edges of the passage; nearly every five words of the noise were one, too, when only rare pairs were cut at.
    assert edges[0] < 20


def test_a_task_adds_up_grams_of_its_chunks(monkeypatch):
    every = SimpleNamespace(value=b"\xff" * (phrase_module.MAP_BITS // 8))
    monkeypatch.setattr(phrase_module, "CHUNK_BYTES", 20)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 20, "text": [b"a b c d e f. g", b"a b c d e f"] * 20})
    for most, parts in ((1 << 18, 1), (5, 20)):
        monkeypatch.setattr(phrase_module, "MERGE_GRAMS", most)
        rows = [r for b in phrase_module._gram_counter([every] * 3)(iter([batch])) for r in b.to_pylist()]
        sums = Counter()
        for r in rows:
            sums[r["lang"], r["gram"], r["size"], r["kind"]] += r["n"]
        assert sums == {("en", b"g", 1, "end"): 20} | {
            (lang, *g): 20 for lang in ("en", "de") for g in ((b"a b c d e", 5, "edge"), (b"b c d e f", 5, "edge"), (b"c d e f", 4, "end"))}
        assert len(rows) == len(sums) if parts == 1 else len(sums) < len(rows) <= parts * len(sums)


def test_words_pairs_and_triples_are_counted_once(spark, monkeypatch):
    """Pieces of one to three words have no edge and no node: the step that counts grams of tasks makes no row of them."""
    rng = random.Random(8)
    pieces = [[rng.choice("abcdefghij") for _ in range(rng.randrange(1, 4))] for _ in range(3000)] + ["a long one of six words".split()] * 30
    rng.shuffle(pieces)
    want = Counter()
    for p in pieces:
        want.update((" ".join(p[k : k + size]), size) for size in range(1, 6) for k in range(len(p) - size + 1))
    made, written = [], phrase_module.stage
    monkeypatch.setattr(phrase_module, "stage", lambda df, name: written(df, name) if name != "grams-counted" else made.append(written(df, name)) or made[0])
    texts = spark.createDataFrame([("en", ". ".join(map(" ".join, pieces[k : k + 100])).encode()) for k in range(0, len(pieces), 100)], "lang string, text binary")
    grams, _ = gram_counts(texts, 5)
    assert Counter({(r.gram, r["size"]): r.n for r in grams.collect()}) == {g: n for g, n in want.items() if n >= 5}
    assert sorted((r.kind, r.gram, r.n) for r in made[0].collect()) == [
        ("edge", "a long one of six", 30), ("edge", "long one of six words", 30), ("end", "one of six words", 30)]


def test_words_that_share_a_hash_are_counted_apart(spark):
    # Thue-Morse words of 2048 letters and their complements have one polynomial hash modulo 2 ** 64, whatever its base.
    one = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    known = phrase_module.Words([f"{one} {two}".encode()], [0]).ids(["en"], {})
    assert known[0] == known[1]
    texts = [f"{one} x y", f"{two} x y", f"{one} x y", f"{two} x z", f"{two} x z", f"{one} q"]
    want = Counter()
    for p in (t.split() for t in texts):
        want.update((" ".join(p[k : k + size]), size) for size in range(1, 6) for k in range(len(p) - size + 1))
    for lang in ("en", "de"):
        docs = spark.createDataFrame([(lang, t.encode()) for t in texts] + [("fr", two.encode())], "lang string, text binary").repartition(3)
        grams, _ = gram_counts(docs, 2)
        assert Counter({(r.gram, r["size"]): r.n for r in grams.collect() if r.lang == lang}) == {g: n for g, n in want.items() if n >= 2}


# ---- conversations

def trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        own = [t[2:] for t in sorted(turns[c])]
        base = [t[2:] for t in sorted(turns.get(int(np.fix(c / 100)) * 100, []))]
        built[c] = base[:h] + own[h:]
    members = defaultdict(list)
    for c, told in built.items():
        for d in range(len(told) + 1):
            members[tuple(told[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], sum(not kids[q] for q in below),
                 sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), 100, 105, 207, 300, 301, -5, -107, 2**40 + 3]:
        for turn in range(rng.choice((1, 2, 3, 5, 8, 21 if c % 7 == 0 else 4))):
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ok", "ünï 😀", "", None])))
    rows += [(None, 1, "user", "lost"), (7, 99, "user", "same"), (7, 99, "user", "same"), (500, None, None, None)]
    rows = list(dict.fromkeys(rows)) if seed == 1 else rows
    # Turns of equal number must not differ for the brute force to order them alike.
    seen, fair = set(), []
    for r in rows:
        if r[1] is not None or (r[0], None) not in seen:
            fair.append(r)
            seen.add((r[0], r[1]))
    frame = spark.createDataFrame([(*r, 1, "n") for r in fair], "conv_id long, turn long, role string, text string, place int, name string")
    got = conversation_trie(frame.repartition(6)).collect()
    assert {tuple(r) for r in got} == trie(fair) and len(got) == len(trie(fair))


def test_trie_of_few_and_deep_rows(spark):
    schema = "conv_id int, turn int, role string, text string"
    assert conversation_trie(spark.createDataFrame([], schema)).count() == 0
    one = conversation_trie(spark.createDataFrame([(1, None, None, None)], schema)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children) for r in one] == [(1, 0, 1, 0)]  # its only turn is not shared
    deep = [(100, t, "user", f"t{t % 3}") for t in range(150)] + [(200, t, "user", f"t{t % 3}") for t in range(150)]
    assert {tuple(r) for r in conversation_trie(spark.createDataFrame(deep, schema)).collect()} == trie(deep)
    hot = spark.createDataFrame([(c * 100, 0, "user", "x") for c in range(3000)], schema)
    top = {r.depth: r for r in conversation_trie(hot.repartition(9)).collect()}
    ids = ",".join(str(c * 100) for c in range(3000))
    assert top[1].n_convs == 3000 and top[1].ends_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    assert hot.filter(F.col("conv_id") < 0).count() == 0
