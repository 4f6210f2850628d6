"""Secret scan: a random forest decides which high-entropy strings are secrets.

Long unbroken strings are proposed in every text.  A forest of bounded size,
trained on labelled findings, removes the false positives by the string's
length, character transitions, coverage by dictionary words, whether it is
part of a path, and the words beside it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import prepare, stage

#: A candidate: an unbroken run of at least this many characters that keys are written in.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
_NEAR = re.compile(r"(?i)(token|secret|passw|api|key|auth|credential|bearer|private)")
_ASSIGNED = re.compile(r"[=:]\s{0,2}[\"']?$")
_HEX = frozenset("0123456789abcdefABCDEF")
_VOWELS = frozenset("aeiouAEIOU")
CONTEXT = 32
FEATURES = (
    "length", "transitions", "digits", "uppers", "hexes", "vowels", "entropy", "coverage", "path", "marks", "near", "assigned", "quoted",
)
DICTIONARY_WORDS = 5000
#: Labelled findings that a forest is trained on, at most so many of either label.
SAMPLE_ROWS = 6000
#: Words of the dictionary; short ones, as a key covered by words is covered by these.
_WORD = r"(?<![a-zà-ÿ])[a-zà-ÿ]{3,7}(?![a-zà-ÿ])"

#: Formats whose findings are certain, for labelling: fixed values of public key formats.
_CERTAIN = re.compile(
    r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{24,})$")
_SECRET_HEX = re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")
#: Words of one case or with a capital, alone, joined or as a path; numbers and rulers.  Possessive, as a string may be long.
_WORDS_ONLY = re.compile(r"[-_/+=]*+(?:(?:[a-z]++|[A-Z][a-z]++|[A-Z]++)(?:[-_/+=]++|$))++$")
_PLAIN_NUMBER = re.compile(r"[0-9+/=_-]+$")
#: Share of a string that dictionary words must cover for it to be surely none.
COVERED = 0.8


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _coverage(text: str, words: frozenset[str]) -> float:
    """Share of the characters that the longest dictionary words, taken from the left, cover."""
    text, at, covered = text.lower(), 0, 0
    while at < len(text):
        n = next((n for n in range(min(7, len(text) - at), 2, -1) if text[at : at + n] in words), 0)
        covered += n
        at += n or 1
    return covered / len(text)


def features(text: str, start: int, end: int, words: frozenset[str]) -> list[float]:
    value, n = text[start:end], end - start
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    return [
        float(n), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        kinds.count(0) / n, kinds.count(2) / n, sum(c in _HEX for c in value) / n, sum(c in _VOWELS for c in value) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()), _coverage(value, words),
        float("/" in value or before[-1:] in ("/", "\\", "@") or after in ("/", "@")), kinds.count(3) / n,
        float(bool(_NEAR.search(before))), float(bool(_ASSIGNED.search(before))), float(before[-1:] in ('"', "'") or after in ('"', "'")),
    ]


def candidates(docs: DataFrame, words: frozenset[str]) -> DataFrame:
    """(doc_id, start, end, value, before, features...) of every proposed string; positions in code points."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            place, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for m in _CANDIDATE.finditer(text or ""):
                    place.append(i)
                    out.append((m.start(), m.end(), m.group(), text[max(0, m.start() - CONTEXT) : m.start()],
                                *features(text, m.start(), m.end(), known)))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(place)), *[pa.array(c) for c in columns]],
                    names=["doc_id", "start", "end", "value", "before", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(
        propose, f"doc_id {kind}, start long, end long, value string, before string, " + ", ".join(f"{f} double" for f in FEATURES))


def dictionary(docs: DataFrame) -> frozenset[str]:
    """The DICTIONARY_WORDS most frequent short words of all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY_WORDS)
    return frozenset(r["word"] for r in top.collect())


def _named() -> Column:
    return (F.col("near") > 0) & (F.col("assigned") > 0)


def certain() -> Column:
    """Whether a finding's format is beyond doubt: a public key issuer's, or 32 or more hexadecimal digits assigned to a
    name such as token or key."""
    return F.col("value").rlike("^" + _CERTAIN.pattern) | (F.col("value").rlike("^" + _SECRET_HEX.pattern) & _named())


def label_by_format(found: DataFrame) -> DataFrame:
    """Findings labelled where no reviewed labels are at hand: ``secret`` is 1, 0, or null where the format does not tell.

    Surely none are words, also joined or as a path, strings that dictionary
    words cover, and plain numbers, unless assigned to a name such as token.
    """
    none = (F.col("coverage") >= COVERED) | F.col("value").rlike("^" + _WORDS_ONLY.pattern) | F.col("value").rlike("^" + _PLAIN_NUMBER.pattern)
    return found.withColumn("secret", F.when(certain(), 1.0).when(none & ~_named(), 0.0))


def train_forest(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> RandomForestClassificationModel | None:
    """Train on at most ``sample_rows`` findings of either label, none without one; None without findings of both.

    A string with the same text before it counts once, however often it is copied.
    """
    place = F.xxhash64(F.lit(seed), "value", "before")
    distinct = labelled.groupBy("secret", "value", "before").agg(F.min(F.struct(*FEATURES)).alias("f"))
    parts = [distinct.filter(F.col("secret") == label).select("f.*", "secret", place.alias("place"))
             .orderBy("place").limit(sample_rows) for label in (0.0, 1.0)]
    sample = stage(parts[0].unionByName(parts[1]).drop("place"), "secret-sample")
    if sample.select("secret").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.coalesce(1))
    return RandomForestClassifier(labelCol="secret", featuresCol="features", numTrees=24, maxDepth=7, seed=seed).fit(rows)


def scan_secrets(
    docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """A row per secret found in the whole texts: doc_id, start, end, score, value.

    ``labelled`` are findings as ``candidates`` gives them with a double column
    ``secret``; without it the documents' own findings are labelled by format.
    The forest's score decides about every finding, whatever its format.  Only
    where there are no findings of both labels to train on, and so no forest,
    are those of a certain format reported, with score 1.
    Null, empty and short texts have no findings; a text in several rows is
    reported for each.
    """
    found = stage(candidates(docs, dictionary(docs)), "secret-candidates")
    forest = train_forest(label_by_format(found) if labelled is None else labelled, sample_rows)
    if forest is None:
        return found.filter(certain()).select("doc_id", "start", "end", F.lit(1.0).alias("score"), "value")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    scored = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.filter(F.col("score") >= F.lit(threshold)).select("doc_id", "start", "end", "score", "value")


