"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A document's cost is linear plus quadratic in its tokens, as attention within
it costs.  Documents are dealt to shards of about ``shard_tokens`` tokens by a
hash of their content; whole sequences are cut from long documents where they
are tokenised, and only the rest of each travels.  A shard has exactly the
capacity of its tokens: full sequences, and for what is left over sequences of
the powers of two that add up to it, which need no padding.  Its documents
are assigned in descending cost to the sequence of lowest cost that has room.
Documents that fit nowhere whole are cut to fill the sequences of lowest cost.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm.common import ENTRY_BYTES, WordCache, prepare, utf8, worker_cache

SEQUENCE = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SHARD_TOKENS = 1_000_000
#: Rows of a shard that are held at once; a shard with more is packed in blocks.
BLOCK_ROWS = 20_000
PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class DocumentTokens(WordCache):
    """Token ids of whole texts for a vocabulary that drops white space.

    White space always ends a token, so the parts between it are tokenised once
    and remembered, as 32-bit ids.  Of a part that is a word of
    Latin letters and the marks after it, the word, in small letters, goes
    straight to the merges of the library's model: normalising and splitting
    would not change it.  That holds for vocabularies with ``NORMALIZER`` and
    ``PATTERN``; of any other, all parts go to the library as they are.
    """

    #: Marks that the vocabulary's split pattern separates from letters before them.
    MARKS = b".,;:!?*#$%&|"
    # What the vocabulary's file must say for the short way to be the library's.
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, vocabulary: str, end_id: int):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.end = array("I", [end_id]).tobytes()
        described = json.loads(self.tokenizer.to_str())
        split = (described.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.short_way = (
            (described.get("normalizer") or {}).get("normalizers") == self.NORMALIZER
            and split[0].get("pattern") == {"Regex": self.PATTERN} and [p.get("type") for p in split] == ["Split", "ByteLevel"]
            and described["model"]["type"] == "BPE" and not any(t["content"].isalpha() for t in described["added_tokens"])
        )
        #: Ids of words in small letters, and of marks.
        self.words: dict[str, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}
        self.model = self.tokenizer.model
        # Byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, part: bytes) -> bytes:
        word = part.rstrip(self.MARKS)
        text = word.decode("utf-8")
        if not self.short_way or not text.isalpha() or max(text) >= "\u0100":
            ids = self._library(part)
        else:
            low = text.lower()
            ids = self.words.get(low)
            if ids is None:
                tokens = self.model.tokenize(low.encode().decode("latin-1").translate(self.alphabet))
                ids = self.words[low] = array("I", map(_token_id, tokens)).tobytes()
                self.bytes += ENTRY_BYTES + len(low) + len(ids)
            after = part[len(word) :]
            if after not in self.marks:
                self.marks[after] = self._library(after)
                self.bytes += ENTRY_BYTES + 5 * len(after)
            ids += self.marks[after]
        self[part] = ids
        self.bytes += ENTRY_BYTES + len(part) + len(ids)
        return ids

    def _library(self, part: bytes) -> bytes:
        return array("I", self.tokenizer.encode(part.decode("utf-8"), add_special_tokens=False).ids).tobytes()

    def forget(self) -> None:
        super().forget()
        self.words.clear()
        self.marks = {b"": b""}

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) + self.end


_token_id = attrgetter("id")


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def capacities(tokens: int, sequence: int = SEQUENCE) -> list[int]:
    """Sequence lengths that add up to ``tokens``: full ones, then the powers of two of the rest."""
    full, rest = divmod(tokens, sequence)
    return [sequence] * full + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack(lengths: list[int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill the sequences exactly.

    ``lengths`` are in the order that breaks ties of cost.
    """
    room = capacities(sum(lengths), sequence)
    used = [0] * len(room)
    pieces, cut = [], []
    # Sequences by cost; those of one cost in their order.  A sequence leaves when it is full.
    heap = [(0.0, s) for s in range(len(room))]
    most = sequence
    for d in sorted(range(len(lengths)), key=lambda d: -cost(lengths[d])):
        n, tried, found = lengths[d], [], None
        # ``most`` bounds the room of every sequence after the last failure for a document of that length.
        while heap and n < most + 1:
            c, s = heapq.heappop(heap)
            if room[s] - used[s] >= n:
                found = c, s
                break
            tried.append((c, s))
        if found:
            c, s = found
            pieces.append((d, 0, n, s, used[s]))
            used[s] += n
            if used[s] < room[s]:
                tried.append((c + cost(n), s))
        else:
            if n <= most:
                most = n - 1
            cut.append(d)
        for entry in tried:
            heapq.heappush(heap, entry)
    for d in cut:
        start = 0
        while start < lengths[d]:
            c, s = heapq.heappop(heap)
            n = min(lengths[d] - start, room[s] - used[s])
            pieces.append((d, start, n, s, used[s]))
            used[s] += n
            start += n
            if used[s] < room[s]:
                heapq.heappush(heap, (c + cost(n), s))
    return pieces


def _shard_pieces(shard: int, first: int, rows: list[tuple], sequence: int) -> tuple[dict, int]:
    """Pieces of the rows (doc_id, tokens, crcs of whole sequences, ids of the rest) and the next free sequence number."""
    out = defaultdict(list)

    def piece(doc, start, length, crc, tokens, number, offset):
        for name, value in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"),
                               (doc, start, length, crc, tokens, (shard << 32) + number, offset), strict=True):
            out[name].append(value)

    number = first
    for doc, tokens, crcs, _ in rows:
        for i, crc in enumerate(crcs):
            piece(doc, i * sequence, sequence, crc, tokens, number, 0)
            number += 1
    rest = [r for r in rows if r[3]]
    used = -1
    for d, start, length, s, offset in pack([len(r[3]) // 4 for r in rest], sequence):
        doc, tokens, crcs, ids = rest[d]
        piece(doc, len(crcs) * sequence + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens,
              number + s, offset)
        used = max(used, s)
    return out, number + used + 1


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 2, sequence: int = SEQUENCE, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pack every row's whole text, tokenised and ended by ``end_id``, into sequences.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  A null or empty text is the one token ``end_id``.
    Rows are packed each for itself, also where they are equal.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # A text has about a token in three bytes; only the size of the shards depends on this estimate.
    size = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) / 3 + 1)).first()[0] or 0
    shards = max(1, int(size / shard_tokens))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = worker_cache(DocumentTokens, vocabulary, end_id)
        width = 4 * sequence
        for batch in batches:
            tokens_of.trim()
            ids = [tokens_of(t) for t in batch.column("text").to_pylist()]
            whole = [len(i) // width for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                 pa.array([[zlib.crc32(i[k * width : (k + 1) * width]) for k in range(n)] for i, n in zip(ids, whole, strict=True)],
                          pa.list_(pa.int64())),
                 pa.array([i[n * width :] for i, n in zip(ids, whole, strict=True)], pa.binary())],
                names=["shard", "doc_id", "doc_tokens", "crcs", "rest"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, number = None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "doc_tokens", "crcs", "rest")), strict=True):
                if held and (row[0] != shard or len(held) >= BLOCK_ROWS):
                    out, number = _shard_pieces(shard, number, held, sequence)
                    yield from _piece_batch(out, schema)
                    held = []
                if row[0] != shard:
                    shard, number = row[0], 0
                held.append(row[1:])
        if held:
            yield from _piece_batch(_shard_pieces(shard, number, held, sequence)[0], schema)

    spread = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"), "doc_id", utf8().alias("text"))
    tokens = spread.mapInArrow(tokenise, f"shard long, doc_id {kind}, doc_tokens long, crcs array<long>, rest binary")
    # The order within a shard makes reruns agree; rows equal in all of it are interchangeable.
    dealt = tokens.repartition(shards, "shard").sortWithinPartitions("shard", "doc_tokens", F.asc_nulls_last("doc_id"), "rest")
    schema = pa.schema([("doc_id", _arrow(kind)), *[(c.split()[0], pa.int64()) for c in PIECE_SCHEMA.split(", ")]])
    return dealt.mapInArrow(fill, f"doc_id {kind}, {PIECE_SCHEMA}")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _piece_batch(out: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
