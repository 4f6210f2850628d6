"""Documents with the awkward cases every operator must bear, and brute-force versions."""

from __future__ import annotations

import random
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size int, keep string, shard int"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "se", "to") for b in ("na", "ve", "xi", "zu", "da")]


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Random texts, copies, near copies, shared passages, repeated rows, nulls, empty and long texts."""
    rng = random.Random(seed)
    passage = text_of(rng, 70)
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind in (1, 2) and any(t for _, t in rows):
            words = rng.choice([t for _, t in rows if t]).split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        elif kind == 3:
            text = f"{text_of(rng, rng.randrange(60))}\n{passage}\t {text_of(rng, rng.randrange(60))}"
        else:
            text = text_of(rng, rng.randrange(1, 160))
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "één 漢字 😀  x y"),
             (n + 6, "wide " * 30_000), (n + 7, rows[3][1])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """As documents, with further columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", f"s{(i or 0) % 4}" if i != 5 else None, len(t or ""), 7, "k", 1, "no", 3) for i, t in rows], SCHEMA)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def near_components(rows) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in rows:
        w = words_of((t or "").encode().lower().decode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        for j in {j for s in sets[i] for j in holders[s]}:
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                of[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def kept_words(rows, window: int) -> dict[int, tuple[int, list[bytes]]]:
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            first[run] = min(first.get(run, i), i)
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (sum(gone), [x for x, g in zip(w, gone, strict=True) if not g])
    return out
