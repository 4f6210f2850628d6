"""Token counts of byte-level BPE by rank-synchronous array merging.

The new pre-tokens of a batch of documents are held as one ragged numpy array
of symbol ids.  In each round every sequence looks up the ranks of its adjacent
pairs and applies its own lowest-ranked pair at all its places at once; a
sequence without a ranked pair is finished, and its surviving symbols are its
tokens.  Counts of text pieces already seen are remembered per worker, within
a bound.  The vocabulary file is a parameter; every worker reads it itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm.common import CACHE_BYTES, ENTRY_BYTES, prepare, utf8, worker_cache

# A token always begins at a single blank that a non-space follows.  A text can
# therefore be cut there, unless a blank is followed by white space (or by the
# text's end, or by a byte that may begin a wider space): such texts go whole
# to the pre-tokenizer.
_AWKWARD = re.compile(rb"[ ](?:[\x00-\x20\x7f]|\xc2|\xe1\x9a|\xe2\x80|\xe2\x81|\xe3\x80|$)")


class RankMerger:
    """The merges of a byte-level BPE vocabulary as arrays, and the counting of tokens by them."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(model))
        ids = model["model"]["vocab"]
        self.symbols = {s: i for s, i in ids.items() if len(s) == 1}
        self.width = max(ids.values()) + 1
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["model"]["merges"]]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)).encode()) if special else None

    def count(self, sequences: list[str]) -> np.ndarray:
        """Tokens of each pre-token, given in the vocabulary's byte alphabet."""
        counts = np.zeros(len(sequences), np.int64)
        lengths = np.array([len(s) for s in sequences], np.int64)
        flat = np.array([self.symbols[c] for s in sequences for c in s], np.int64)
        owner = np.repeat(np.arange(len(sequences)), lengths)
        none = len(self.merged)
        while len(flat):
            # Pairs of neighbours in one sequence, and their ranks.
            left = np.flatnonzero(owner[:-1] == owner[1:])
            key = flat[left] * self.width + flat[left + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            best = np.full(len(sequences), none, np.int64)
            np.minimum.at(best, owner[left], rank)
            done = best[owner] == none
            if done.any():
                counts += np.bincount(owner[done], minlength=len(sequences))
            chosen = left[(rank < none) & (rank == best[owner[left]])]
            if not len(chosen):
                break
            # Of overlapping places (a a a) every second one counts, from the left.
            fresh = np.r_[True, (np.diff(chosen) != 1) | (owner[chosen[1:]] != owner[chosen[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            flat[chosen] = self.merged[best[owner[chosen]]]
            keep = ~done
            keep[chosen + 1] = False
            flat, owner = flat[keep], owner[keep]
        return counts

    def pretokens(self, piece: bytes) -> list[str]:
        return [s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece.decode("utf-8"))]


class DocumentCounter:
    """Counts of whole texts; pieces cut at single blanks are counted once and remembered."""

    def __init__(self, vocabulary: str):
        self.merger = RankMerger(vocabulary)
        self.first: dict[bytes, int] = {}  # pieces that begin a text
        self.later: dict[bytes, int] = {}  # pieces that follow a blank
        self.whole: dict[bytes, int] = {}  # texts that cannot be cut
        self.bytes = 0  # what the first two need

    def _learn(self, pieces: list[tuple[dict, bytes, bytes]]) -> None:
        tokens = [self.merger.pretokens(text) for _, _, text in pieces]
        number: dict[str, int] = {}
        for own in tokens:
            for t in own:
                number.setdefault(t, len(number))
        counts = self.merger.count(list(number))
        for (cache, key, _), own in zip(pieces, tokens, strict=True):
            cache[key] = int(sum(counts[number[t]] for t in own))
            self.bytes += (ENTRY_BYTES + len(key)) if cache is not self.whole else 0

    def batch(self, texts: list[bytes]) -> list[int]:
        if self.bytes > CACHE_BYTES:
            self.first.clear()
            self.later.clear()
            self.bytes = 0
        self.whole.clear()
        special = self.merger.special
        segments = [special.split(t) if special and b"<|" in t else [t] for t in texts]
        cut = [[(s.split(b" ") if not _AWKWARD.search(s) else None, s) for s in own] for own in segments]
        first, later, whole = set(), set(), set()
        for own in cut:
            for pieces, s in own:
                if pieces is None:
                    whole.add(s)
                else:
                    first.add(pieces[0])
                    later.update(pieces[1:])
        self._learn([(self.first, p, p) for p in first if p not in self.first]
                    + [(self.later, p, b" " + p) for p in later if p not in self.later]
                    + [(self.whole, p, p) for p in whole])
        known = self.later.__getitem__
        return [
            len(own) - 1 + sum(self.whole[s] if pieces is None else self.first[pieces[0]] + sum(map(known, pieces[1:]))
                               for pieces, s in own)
            for own in cut
        ]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text.

    Counts are those of the tokenizers library for the vocabulary file, without
    added special tokens; a special token's string inside a text is that one
    token.  Null and empty texts have no bytes and no tokens; repeated rows are
    counted alike; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(DocumentCounter, vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = counter.batch(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8().alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
