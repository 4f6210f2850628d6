"""Main text of web pages: boosted trees over elements, decoded from the root down.

Every block element is described by its subtree's density, its attribute
tokens, depth and siblings.  Boosted trees give the chances that its subtree
is all main text, all something else, or mixed.  Decoding picks the likeliest
reading of the whole tree in which choices agree: everything under an element
taken as main text is main text, everything under a dropped one is dropped,
and only a mixed element leaves the choice to its children.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.boosting import BoostedTrees
from ledgerlens.llm.common import prepare
from ledgerlens.llm.dom import Odds, Page, features, subtree_chars
from ledgerlens.llm.layouts import MAIN, REST, Layout, plain

#: Layouts that the model is fitted on, and the seed that they start from.
LAYOUTS, SEED = 600, 11
#: Bytes of html whose elements are described at once.
CHUNK_CHARS = 2 << 20
_MAIN, _REST, _MIXED = 0, 1, 2


def labels_of(page: Page) -> np.ndarray:
    """Per element of a marked page: its subtree is main text, something else, mixed, or has no text (-1)."""
    main, rest = np.zeros(len(page.tag) + 1), np.zeros(len(page.tag) + 1)
    for node, text in page.runs:
        if MAIN in text:
            main[node] += 1
        if REST in text:
            rest[node] += 1
    ends = np.array(page.end)
    start = np.arange(len(page.tag))
    has_main, has_rest = (np.r_[0, np.cumsum(c)] for c in (main[:-1], rest[:-1]))
    m, r = has_main[ends] > has_main[start], has_rest[ends] > has_rest[start]
    return np.where(m & r, _MIXED, np.where(m, _MAIN, np.where(r, _REST, -1)))


class Extractor:
    """A fitted model; ``texts`` reads pages."""

    def __init__(self, marked: list[str]):
        labels = [labels_of(Page(html)) for html in marked]
        pages = [Page(plain(html)) for html in marked]
        # A mark on its own is text, so a marked page may have an element or a run more.
        same = [k for k, page in enumerate(pages) if len(page.tag) == len(labels[k])]
        pages, labels = [pages[k] for k in same], [labels[k] for k in same]
        self.odds = Odds(pages, labels)
        wanted = np.concatenate(labels)
        rows = features(pages, self.odds)[wanted >= 0]
        self.trees = BoostedTrees(3).fit(rows, wanted[wanted >= 0])

    def chances(self, pages: list[Page]) -> np.ndarray:
        return self.trees.predict(features(pages, self.odds))

    def texts(self, htmls: list[str]) -> list[str]:
        pages = [Page(h) for h in htmls]
        logs = np.log(np.maximum(self.chances(pages), 1e-9))
        out, start = [], 0
        for page in pages:
            size = len(page.tag)
            keep = decode(page, logs[start : start + size])
            out.append("\n\n".join(text for node, text in page.runs if keep[node]))
            start += size
        return out


def decode(page: Page, logs: np.ndarray) -> list[bool]:
    """Which elements' own text is main text, under the likeliest consistent reading."""
    size = len(page.tag)
    holds = subtree_chars(page) > 0
    main, rest, mixed = (np.where(holds, logs[:, k], 0.0) for k in (_MAIN, _REST, _MIXED))
    ends = np.array(page.end)
    sums = [np.r_[0.0, np.cumsum(c)] for c in (main, rest)]
    all_main, all_rest = ((s[ends] - s[:-1]).tolist() for s in sums)
    parts = [0.0] * size
    count = [int(n > 0) for n in page.runs_of]
    choice = [_REST] * size
    alone_main, alone_rest, split = main.tolist(), rest.tolist(), mixed.tolist()
    has = holds.tolist()
    for node in range(size - 1, -1, -1):
        if not has[node]:
            continue
        best, choice[node] = (all_main[node], _MAIN) if all_main[node] >= all_rest[node] else (all_rest[node], _REST)
        if count[node] > 1:  # a single part can't be mixed
            own = max(alone_main[node], alone_rest[node]) if page.runs_of[node] else 0.0
            mixed_way = split[node] + own + parts[node]
            if mixed_way > best:
                best, choice[node] = mixed_way, _MIXED
        elif count[node] == 1 and not page.runs_of[node]:
            # One child holds all the text: its own reading may be better than either.
            through = split[node] + parts[node]
            if through > best:
                best, choice[node] = through, _MIXED
        parent = page.parent[node]
        if parent >= 0:
            parts[parent] += best
            count[parent] += 1
    keep = [False] * size
    state = [_MIXED] * size
    for node in range(size):
        if not has[node]:
            continue
        parent = page.parent[node]
        above = state[parent] if parent >= 0 else _MIXED
        state[node] = choice[node] if above == _MIXED else above
        keep[node] = state[node] == _MAIN or (state[node] == _MIXED and alone_main[node] >= alone_rest[node])
    return keep


@cache
def default_extractor() -> Extractor:
    """Fitted once per process on LAYOUTS made pages; the same every time."""
    return Extractor([Layout(SEED + k).html for k in range(LAYOUTS)])


def extract_text(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    Blocks are joined in page order by an empty line; white space (as Unicode
    has it) inside a block is one space; character references are decoded. A
    null or empty html, and a page without main text, give the empty text.
    Repeated rows give repeated rows, null ids and urls stay, other columns
    are ignored, an empty table gives no rows.  Pages are read whole.
    """
    prepare(pages.sparkSession)
    model = extractor or default_extractor()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = [h or "" for h in batch.column("html").to_pylist()]
            texts: list[str] = []
            held: list[str] = []
            for html in htmls:
                held.append(html)
                if sum(map(len, held)) > CHUNK_CHARS:
                    texts += model.texts(held)
                    held = []
            if held:
                texts += model.texts(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema}
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
