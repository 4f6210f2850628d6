"""Substring deduplication: words covered by a long window that an earlier document holds too.

A window is ``window`` consecutive words.  Sampled grams (half a window long,
the least by hash of every run of so many) that occur in one document only
rule out the windows around them; then all grams of the windows left do so.
What remains is cut into segments whose windows share their least gram; equal
windows thus meet in one shard.  A shard
holds each distinct segment once, with the smallest document it occurs in, in
a compressed FM-index.  Streaming the segments through it backward gives the
matching statistics: how many words from each one on occur elsewhere too.
Where they reach a window, the interval of all its places is reported, they are
located from sampled positions, and the smallest document among them is taken.

Copies in any number become one segment, and text that is a document's own is
cut away before, so no shard grows with the size of a group of copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, distinct_sorted, gram_hashes, prepare, shuffle_width, slide, stage, utf8, word_array
from ledgerlens.llm.fm_index import FMIndex

WINDOW = 50
#: Words of distinct segments in one shard's index.
SHARD_WORDS = 400_000


def sampled_windows(grams: np.ndarray, shared: np.ndarray, window: int) -> np.ndarray:
    """Which windows have only shared samples; ``shared`` are gram hashes, sorted."""
    half = window // 2
    fine = np.isin(slide(grams, half, np.minimum), shared)
    # The runs of grams that lie within a window: the same ones wherever the window occurs.
    return slide(fine, window - 2 * half + 2, np.logical_and)


def covered_grams(free: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The grams that lie within a free window."""
    change = np.zeros(len(grams) + 1, np.int64)
    starts = np.flatnonzero(free)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + len(grams) - len(free) + 1, -1)
    return grams[np.cumsum(change[:-1]) > 0]


def segments(grams: np.ndarray, shared: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(key, start, words) of the segments of a document, given the shared gram hashes (sorted)."""
    width = window - window // 2 + 1
    free = slide(np.isin(grams, shared), width, np.logical_and)
    keys = slide(grams, width, np.minimum)
    begins = free & np.r_[True, ~free[:-1] | (keys[1:] != keys[:-1])]
    ends = free & np.r_[~free[1:] | (keys[1:] != keys[:-1]), True]
    return [(int(keys[b].astype(np.int64)), int(b), int(e - b + window))
            for b, e in zip(np.flatnonzero(begins), np.flatnonzero(ends), strict=True)]


def _samples(docs: DataFrame, window: int) -> DataFrame:
    """Per row: its words, the digest of all of them, and the hashes of its sampled grams."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, found = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                if len(words) < window:
                    found.append(None)
                else:
                    grams = gram_hashes(word_array(text), window // 2)
                    found.append(distinct_sorted(slide(grams, window // 2, np.minimum)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_words", "digest", "samples"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    return rows.mapInArrow(take, f"doc_id {kind}, text_hash long, n_words long, digest binary, samples array<long>")


def _survivors(texts: DataFrame, window: int) -> DataFrame:
    """Per document with shared samples: the hashes of all grams of the windows that those leave."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("shared"), strict=True):
                grams = gram_hashes(word_array(text), window // 2)
                free = sampled_windows(grams, own.values.to_numpy().view(np.uint64), window)
                found.append(distinct_sorted(covered_grams(free, grams)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "grams"])

    return texts.mapInArrow(take, f"doc_id {kind}, text_hash long, grams array<long>")


def _in_several(table: DataFrame, column: str) -> DataFrame:
    """Per document, which of the hashes in ``column`` another document has too."""
    grams = table.select("doc_id", "text_hash", F.explode(column).alias("gram"))
    several = grams.groupBy("gram").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # Written, so that the join deals both sides out itself and can split a gram that very many documents hold.
    several = stage(several.filter("least < most").select("gram"), "substring-several")
    return grams.join(several, "gram").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("gram")).alias("shared"))


def _occurrences(texts: DataFrame, window: int) -> DataFrame:
    """A row per segment of each document: key, segment hash, its text, document, first word."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), batch.column("shared"), strict=True)
            for doc, text_hash, text, own in rows:
                words = text.split()
                grams = gram_hashes(word_array(text), window // 2)
                for key, start, n in segments(grams, np.sort(own.values.to_numpy().view(np.uint64)), window):
                    piece = b" ".join(words[start : start + n])
                    out.append((key, xxhash.xxh3_64_intdigest(piece) - (1 << 63), piece, doc, text_hash, start, n))
                if len(out) >= 4096:
                    yield segment_batch(out)
                    out = []
            if out:
                yield segment_batch(out)

    def segment_batch(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary(), id_type, pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
            names=["key", "segment", "piece", "doc_id", "text_hash", "start", "n"])

    id_type = pa.int32() if kind == "int" else pa.int64()
    return texts.mapInArrow(
        cut, f"key long, segment long, piece binary, doc_id {kind}, text_hash long, start long, n long")


def _search_shard(pieces: list[bytes], owners: list[int], window: int) -> list[list[int]]:
    """For every window of each piece, the smallest owner of a piece that holds it."""
    number: dict[bytes, int] = {}
    texts = [np.array([number.setdefault(w, len(number) + 1) for w in p.split(b" ")], np.int64) for p in pieces]
    index = FMIndex(texts, window)
    length, low, high = index.matches(texts, 2)
    sizes = np.array([len(t) for t in texts])
    owner = np.asarray(owners, np.int64)
    smallest = np.repeat(owner, sizes)
    long = np.flatnonzero(length >= window)
    if len(long):
        # Intervals of one length do not overlap: every place in the order is looked up once at most.
        lows, first, which = np.unique(low[long], return_index=True, return_inverse=True)
        counts = high[long][first] - lows
        begins = np.cumsum(counts) - counts
        rows = np.arange(counts.sum()) + np.repeat(lows - begins, counts)
        holders = owner[index.texts_at(index.locate(rows))]
        smallest[long] = np.minimum.reduceat(holders, begins)[which]
    within = np.arange(len(smallest)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    smallest = smallest[within <= np.repeat(sizes - window, sizes)]
    counts = sizes - window + 1
    return np.split(smallest, np.cumsum(counts)[:-1])


def _first_holders(distinct: DataFrame, window: int) -> DataFrame:
    """Per distinct segment, the smallest document of each of its windows."""
    spark = distinct.sparkSession
    words = distinct.agg(F.sum("n")).first()[0] or 0
    shards = max(shuffle_width(spark), math.ceil(words / SHARD_WORDS))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "segment", "piece", "doc_id")), strict=True):
                if row[0] != shard and held:
                    yield answer(held)
                    held = []
                shard = row[0]
                held.append(row[1:])
        if held:
            yield answer(held)

    def answer(held: list[tuple]) -> pa.RecordBatch:
        keys, hashes, pieces, owners = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()),
             pa.array(_search_shard(pieces, owners, window), pa.list_(pa.int64()))], names=["key", "segment", "firsts"])

    dealt = distinct.select(F.pmod(F.hash("key"), F.lit(shards)).alias("shard"), "key", "segment", "piece", "doc_id")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(
        search, "key long, segment long, firsts array<long>")


def _kept(rows: DataFrame, kind: str, window: int) -> DataFrame:
    """Per document with matches: the words that stay and the spans that go."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, spans = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "matches"))
            for doc, text, matches in zip(*columns, strict=True):
                words = text.split()
                change = np.zeros(len(words) + 1, np.int64)
                for m in matches:
                    at = m["start"] + np.flatnonzero(np.asarray(m["firsts"]) < doc)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(removed, pa.int64()), pa.array(digests),
                 pa.array(spans, span)], names=["doc_id", "text_hash", "n_gone", "gone_sha256", "gone_spans"])

    return rows.mapInArrow(
        apply, f"doc_id {kind}, text_hash long, n_gone long, gone_sha256 string, gone_spans array<struct<start:long,end:long>>")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word covered by a window that a document of smaller doc_id holds.

    Returns a row per input row: doc_id, n_words, n_removed, kept_sha256 (of the
    words that stay, joined by blanks), removed (spans of word numbers, end
    exclusive).  Windows are those of the input.  Null, empty and short texts
    lose nothing.  Rows of one doc_id do not remove each other's words; a null
    doc_id is neither smaller nor larger than another.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = stage(_samples(docs, window), "substring-samples")
    # A document all of whose words, in order, are a smaller document's loses every one of them.
    whole = table.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    earliest = stage(whole.groupBy("digest").agg(F.min("doc_id").alias("earliest")), "substring-earliest")
    marked = stage(whole.join(earliest, "digest").select(
        "doc_id", "text_hash", "samples", (F.col("earliest") < F.col("doc_id")).alias("is_copy")), "substring-marked")
    mine = ["doc_id", "text_hash"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    texts = stage(texts.join(_in_several(marked.filter("NOT is_copy"), "samples"), mine), "substring-texts")
    survivors = stage(_survivors(texts, window).filter(F.size("grams") > 0), "substring-survivors")
    texts = texts.drop("shared")
    found = stage(_occurrences(texts.join(_in_several(survivors, "grams"), mine), window), "substring-segments")
    distinct = stage(
        found.groupBy("key", "segment", "piece").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "substring-distinct")
    firsts = stage(_first_holders(distinct, window), "substring-firsts")
    matches = found.select("key", "segment", "doc_id", "text_hash", "start").join(firsts, ["key", "segment"])
    matches = matches.filter(F.exists("firsts", lambda first: first < F.col("doc_id")))
    matches = matches.groupBy(*mine).agg(F.collect_list(F.struct("start", "firsts")).alias("matches"))
    gone = stage(_kept(texts.join(matches, mine), kind, window).dropDuplicates(mine), "substring-kept")
    copies = marked.filter("is_copy").select("doc_id", "text_hash", F.lit(True).alias("is_copy")).distinct()
    rows = table.join(gone, mine, "left").join(copies, mine, "left")
    nothing = F.sha2(F.lit(""), 256)
    copied = F.coalesce("is_copy", F.lit(False))
    spans = "array<struct<start:bigint,end:bigint>>"
    return rows.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_gone", F.lit(0))).alias("n_removed"),
        F.when(copied, nothing).otherwise(F.coalesce("gone_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(copied, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))))
        .otherwise(F.coalesce("gone_spans", F.array().cast(spans))).alias("removed"))
