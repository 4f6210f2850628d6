"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import shared_path, ship_package

# Words are maximal runs of anything but these six characters.  On UTF-8 bytes
# they are what ``bytes.split()`` without arguments separates by.
SPACES = b" \t\n\v\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 512
#: Bytes a worker's word cache may hold before it starts anew.
CACHE_BYTES = 200 << 20


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session: the package on its workers, small Arrow batches, shuffle files dropped when a job ends."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the written table.

    Cuts the lineage at data every executor can read, so that a lost executor
    costs only its running tasks.
    """
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _STAGED[id(table)] = (weakref.ref(table), path)
    return table


_STAGED: dict[int, tuple[weakref.ref, str]] = {}


def discard(table: DataFrame) -> None:
    """Delete a table that ``stage`` wrote, when all that was made from it is written too."""
    held, path = _STAGED.pop(id(table), (None, ""))
    if held is not None and held() is table:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str = "text") -> Column:
    """The text's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def own_prefix(docs: DataFrame) -> str:
    """What an operator's helper columns begin with: no column of ``docs`` does, in any case of letters."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, packed): texts compressed where they are read, for joins that must move them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([compress(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), packed], names=["doc_id", "text_hash", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    return rows.mapInArrow(pack, f"doc_id {kind}, text_hash long, packed binary")


def unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


#: What an entry of a cache is taken to need besides its key's and value's own bytes.
ENTRY_BYTES = 200


class WordCache(dict):
    """What a worker remembers of words; ``__missing__`` adds to ``bytes`` what an entry needs."""

    def __init__(self, limit: int = CACHE_BYTES):
        super().__init__()
        self.limit, self.bytes = limit, 0

    def forget(self) -> None:
        self.clear()
        self.bytes = 0

    def trim(self) -> None:
        """Start anew beyond ``limit`` bytes; called between batches."""
        if self.bytes > self.limit:
            self.forget()


class Cache(WordCache):
    """Remembers ``make(key)`` of bytes; ``make`` gives a few numbers."""

    def __init__(self, make: Callable, limit: int = CACHE_BYTES):
        super().__init__(limit)
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        self.bytes += ENTRY_BYTES + len(key)
        return value


_WORKER: dict[tuple, object] = {}


def worker_cache(make: Callable, *key):
    """``make(*key)``, kept by this Python worker from task to task until another operator asks for its own.

    So a worker that serves one stage after another holds one operator's words.
    """
    name = (make.__name__, *key)
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = make(*key)
    return _WORKER[name]


#: Bytes that are hashed at once; a text is cut between words there.
HASH_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), list(SPACES))
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit values."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return values ^ (values >> np.uint64(29))


def word_array(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text, in order.

    A word's hash is a polynomial over its bytes.  It is taken from running
    sums over the text, divided by the power where the word begins.
    """
    parts, start = [], 0
    while start < len(text):
        end = min(len(text), start + HASH_BYTES)
        while end < len(text) and text[end] not in SPACES:
            end += 1
        parts.append(_word_array(np.frombuffer(text, np.uint8, end - start, start)))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _word_array(raw: np.ndarray) -> np.ndarray:
    if not _POWERS or len(_POWERS[0]) <= len(raw):
        count = 2 * max(len(raw), 1 << 14)
        _POWERS[:] = [_powers(int(_STEP), count), _powers(pow(int(_STEP), -1, 1 << 64), count)]
    powers, inverse = _POWERS
    # Filled in place: texts are short, and joining arrays takes longer than what is done with them.
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(space[:-1] != space[1:])
    begins, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTES[raw] * powers[: len(raw)], dtype=np.uint64, out=sums[1:])
        return mixed((sums[ends] - sums[begins]) * inverse[begins])


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    if not len(values):
        return values
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    return values if have == width else pick(values[: len(values) - (width - have)], values[width - have :])


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive word hashes."""
    total, power = np.zeros(max(0, len(words) - length + 1), np.uint64), np.uint64(1)
    block, have, factor, done = words, 1, _STEP, 0
    rest = length
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                total = total + power * block[done : done + len(total)]
                power = power * factor
                done += have
            rest >>= 1
            if rest:
                block = block[:-have] + factor * block[have:] if len(block) > have else block[:0]
                factor = factor * factor
                have *= 2
    return mixed(total)
