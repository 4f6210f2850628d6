"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Every pattern is applied so that a text of any length is read in linear time:
a run of characters that cannot match is entered once, not once per character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import prepare

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
SPAN_TYPE = "array<struct<kind:string,start:long,end:long,score:double,text:string>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: if the run's first digit fails, so does each later one.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGITS = str.maketrans("", "", " -().+")

#: Score of a confirmed span before its context is read.
_BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
#: Words that, within CONTEXT characters before a span, make it likelier or less likely personal.
_NEAR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "login"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"), "ssn": ("ssn", "social", "security"),
}
_AGAINST = ("example", "test", "version", "sample")
CONTEXT = 48
#: Added kinds are reported from this score on; base kinds always are.
THRESHOLD = 0.5
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", at + 1)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    for m in _IP.finditer(text):
        # A part has at most three digits after its leading zeros, so no huge number is ever converted.
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        digits = m.group().translate(_NOT_DIGITS)
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(m.group().translate(_NOT_DIGITS)) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        compact = m.group().replace(" ", "")
        if 15 <= len(compact) <= 34 and mod97(compact):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def _score(text: str, kind: str, start: int) -> float:
    near = set(_WORD.findall(text[max(0, start - CONTEXT) : start].lower()))
    score = _BASE_SCORE[kind] + 0.3 * bool(near.intersection(_NEAR[kind])) - 0.3 * bool(near.intersection(_AGAINST))
    return min(1.0, max(0.0, score))


def find_spans(text: str | None) -> list[dict]:
    """All spans of one text, by start, then kind; positions in code points, end exclusive."""
    spans = []
    for kind, start, end in _proposals(text or ""):
        score = _score(text, kind, start)
        if kind in BASE_KINDS or score >= THRESHOLD:
            spans.append({"kind": kind, "start": start, "end": end, "score": score, "text": text[start:end]})
    spans.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
    return spans


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row: the personal data its whole text holds.

    Base kinds (email, ip, card, phone) are reported whenever their check
    passes; added kinds (iban by mod 97, ssn by its context) only from
    THRESHOLD on.  Null and empty texts have no spans; repeated rows are
    treated alike; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("score", pa.float64()), ("text", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [find_spans(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, span)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, spans {SPAN_TYPE}")


def pii_digest(found: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, all spans as text."""
    is_base = lambda s: s["kind"].isin(*BASE_KINDS)
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.filter("spans", is_base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
