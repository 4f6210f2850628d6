"""A small HTML reader: block elements with their text, and features of each.

Follows the HTML standard where it matters for text: comments, raw text
elements, character references, elements whose end tag may be missing, void
elements.  Reads every page in linear time, whatever its mark-up.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math select".split())
#: Raw elements that may hold elements of their own name.
_INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img br").split())
_CLOSES_P = frozenset((
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul").split())
#: An opening tag closes these where they are open inside the nearest of the second set.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)), "body": (("head",), ()),
    "option": (("option",), ("select",)),
}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))?+)*+)[\s/]*+>")
_ATTRIBUTE = re.compile(r"([^\s/>=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAMING = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_STOPS = re.compile(r"[.!?;:,]")

TAGS = ("div p li ul ol h1 h2 h3 h4 h5 h6 article main section nav aside header footer form table tr td th blockquote pre "
        "figure figcaption dl dt dd body html address details fieldset").split()
_TAG_CODE = {t: k for k, t in enumerate(TAGS)}


class Page:
    """Elements in document order: lists by element, and the runs of text that they hold themselves."""

    __slots__ = ("tag", "parent", "depth", "end", "tokens", "chars", "links", "words", "stops", "runs_of", "inputs", "marks", "runs")

    def __init__(self, html: str):
        self.tag: list[str] = ["#page"]
        self.parent, self.depth, self.end, self.tokens = [-1], [0], [0], [()]
        self.chars, self.links, self.words, self.stops, self.runs_of, self.inputs, self.marks = [0], [0], [0], [0], [0], [0], [0]
        #: (element, text) in page order.
        self.runs: list[tuple[int, str]] = []
        self._read(html)

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        tokens: list[str] = []
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                if name.lower() in _NAMING:
                    tokens += _TOKEN.findall(a or b or c)
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tokens.append(tuple({t.lower() for t in tokens}) if tokens else ())
        for column in (self.end, self.chars, self.links, self.words, self.stops, self.runs_of, self.inputs, self.marks):
            column.append(0)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack = [0]
        names = ["#page"]
        held: list[str] = []
        in_link = link_chars = 0
        place, size = 0, len(html)

        def flush() -> None:
            nonlocal link_chars
            if held:
                words = unescape("".join(held)).split()
                held.clear()
                if words:
                    text = " ".join(words)
                    node = stack[-1]
                    self.runs.append((node, text))
                    self.chars[node] += len(text)
                    self.links[node] += min(link_chars, len(text))
                    self.words[node] += len(words)
                    self.stops[node] += len(_STOPS.findall(text))
                    self.runs_of[node] += 1
            link_chars = 0

        def close(to: int) -> None:
            flush()
            while len(stack) > to:
                self.end[stack.pop()] = len(self.tag)
                names.pop()

        def close_nearest(which: tuple[str, ...] | frozenset, within: tuple[str, ...]) -> None:
            for k in range(len(names) - 1, 0, -1):
                if names[k] in which:
                    close(k)
                    return
                if names[k] in within:
                    return

        def say(text: str) -> None:
            nonlocal link_chars
            if text:
                held.append(text)
                if in_link:
                    link_chars += len(text)

        while place < size:
            mark = html.find("<", place)
            if mark < 0:
                say(html[place:])
                break
            say(html[place:mark])
            follows = html[mark + 1 : mark + 2]
            if follows in ("!", "?"):
                if html.startswith("<!--", mark):
                    stop = html.find("-->", mark + 4)
                    place = size if stop < 0 else stop + 3
                else:
                    stop = html.find(">", mark)
                    place = size if stop < 0 else stop + 1
                continue
            if not (follows.isascii() and (follows.isalpha() or follows == "/")):
                say("<")
                place = mark + 1
                continue
            found = _TAG.match(html, mark)
            if not found:
                if follows == "/" and not html[mark + 2 : mark + 3].isalpha():
                    stop = html.find(">", mark)
                    place = size if stop < 0 else stop + 1
                    continue
                break  # a tag that the end of the page cuts
            place = found.end()
            tag = found[2].lower()
            if found[1]:
                if tag in _INLINE:
                    in_link -= tag == "a" and in_link > 0
                elif tag == "p" and "p" not in names:
                    flush()
                elif tag in names:
                    close(len(names) - 1 - names[::-1].index(tag))
                continue
            self.marks[stack[-1]] += 1
            if tag in _RAW:
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, place)
                if tag not in ("noscript", "select", "template"):
                    held.append(" ")
                self.inputs[stack[-1]] += tag in ("textarea", "select")
                place = size if stop is None else stop.start()
                continue
            if tag in _INLINE:
                if tag == "br":
                    held.append(" ")
                in_link += tag == "a" and not in_link
                continue
            if tag in ("input", "button"):
                self.inputs[stack[-1]] += 1
            if tag == "button":  # its text is no part of the article
                stop = html.find("</button", place)
                place = size if stop < 0 else stop
                continue
            in_link = 0
            if tag in _CLOSES_P and "p" in names:
                close(len(names) - 1 - names[::-1].index("p"))
            if tag in _CLOSES:
                close_nearest(*_CLOSES[tag])
            flush()
            if tag not in _VOID:
                stack.append(self._open(tag, stack[-1], found[3]))
                names.append(tag)
        close(0)


#: Columns of ``features``; odds are logarithms of how much likelier the tag or name is in main text, and in the rest.
FEATURES = (
    "tag_main", "tag_rest", "name_main", "name_rest", "above_main", "above_rest", "depth", "chars", "own_chars", "words", "density",
    "links", "stops", "word_chars", "share", "before", "after", "children", "index", "siblings", "previous", "next", "sibling_chars",
    "same_tag", "parent_chars", "run_chars", "paragraph_share", "inputs", "runs", "heading",
)


class Odds:
    """How tags and attribute tokens of labelled elements fall on main text and on the rest."""

    def __init__(self, pages: list[Page], labels: list[np.ndarray], least: int = 5):
        counts: dict[str, np.ndarray] = {}
        for page, label in zip(pages, labels, strict=True):
            for tag, tokens, kind in zip(page.tag, page.tokens, label.tolist(), strict=True):
                if kind >= 0:
                    for name in (f"<{tag}", *tokens):
                        counts.setdefault(name, np.zeros(3))[kind] += 1
        total = sum(v for k, v in counts.items() if k[0] == "<") + 1
        prior = total / total.sum()
        self.of = {}
        for name, n in counts.items():
            if n.sum() >= least:
                odds = np.log((n + 2 * prior) / (n.sum() + 2) / prior)
                self.of[name] = (float(odds[0]), float(odds[1]))

    def tags(self, page: Page) -> list[tuple[float, float]]:
        return [self.of.get(f"<{t}", (0.0, 0.0)) for t in page.tag]

    def names(self, page: Page) -> list[tuple[float, float]]:
        out = []
        for tokens in page.tokens:
            seen = [self.of[t] for t in tokens if t in self.of]
            out.append((sum(a for a, _ in seen), sum(b for _, b in seen)) if seen else (0.0, 0.0))
        return out


def features(pages: list[Page], odds: Odds) -> np.ndarray:
    """A row of FEATURES for every element of every page."""
    sizes = np.array([len(p.tag) for p in pages])
    offset = np.repeat(np.cumsum(sizes) - sizes, sizes)

    def column(name: str) -> np.ndarray:
        return np.fromiter((v for p in pages for v in getattr(p, name)), np.float64, int(sizes.sum()))

    n = len(offset)
    parent = column("parent").astype(np.int64) + offset
    root = column("depth") == 0
    parent[root] = np.flatnonzero(root)
    end = column("end").astype(np.int64) + offset
    start = np.arange(n)

    def subtree(values: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(values)]
        return sums[end] - sums[start]

    own = column("chars")
    chars, links, words, stops = subtree(own), subtree(column("links")), subtree(column("words")), subtree(column("stops"))
    marks, inputs, runs = subtree(column("marks")), subtree(column("inputs")), subtree(column("runs_of"))
    tags = [t for p in pages for t in p.tag]
    code = np.array([_TAG_CODE.get(t, -1) for t in tags])
    heading = np.array([len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in tags])
    in_p = subtree(np.where(code == _TAG_CODE["p"], own, 0))
    page_chars = np.maximum(chars[offset], 1)
    before = np.cumsum(own) - own
    before = before - before[offset]
    tag_odds = np.array([o for p in pages for o in odds.tags(p)]).reshape(-1, 2)
    name_odds = np.array([o for p in pages for o in odds.names(p)]).reshape(-1, 2)
    # Strongest evidence on the way down from the root, level by level.
    depth = column("depth").astype(np.int64)
    above = np.zeros((n, 2))
    evidence = tag_odds + name_odds
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    for level in range(1, len(cuts) - 1):
        at = order[cuts[level] : cuts[level + 1]]
        above[at] = np.maximum(above[parent[at]], evidence[parent[at]])
    # Siblings: elements of one parent, in page order.
    kin = np.lexsort((start, parent))
    kin = kin[~root[kin]]
    first = np.r_[True, parent[kin][1:] != parent[kin][:-1]] if len(kin) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    count = np.bincount(group) if len(kin) else np.zeros(0, np.int64)
    place = np.arange(len(kin)) - np.flatnonzero(first)[group] if len(kin) else np.zeros(0, np.int64)
    index, siblings, prev_chars, next_chars, mean, same = (np.zeros(n) for _ in range(6))
    if len(kin):
        index[kin], siblings[kin] = place, count[group]
        mean[kin] = (np.bincount(group, chars[kin]) / count)[group]
        prev_chars[kin[1:]] = np.where(first[1:], 0, chars[kin[:-1]])
        next_chars[kin[:-1]] = np.where(first[1:], 0, chars[kin[1:]])
        alike = np.unique(group * 64 + code[kin] + 1, return_inverse=True)[1]
        same[kin] = np.bincount(alike)[alike] / count[group]
    children = np.bincount(parent[~root], minlength=n)
    safe = np.maximum(chars, 1)
    out = np.column_stack([
        tag_odds, name_odds, above, depth, np.log1p(chars), np.log1p(own), np.log1p(words), chars / (marks + 1), links / safe,
        stops / safe, chars / np.maximum(words, 1), chars / page_chars, before / page_chars,
        (page_chars - before - chars) / page_chars, np.log1p(children), index, siblings, np.log1p(prev_chars), np.log1p(next_chars),
        np.log1p(mean), same, np.log1p(chars[parent]), chars / np.maximum(runs, 1), in_p / safe, inputs, np.log1p(runs), heading])
    return out.astype(np.float32)


def subtree_chars(page: Page) -> np.ndarray:
    sums = np.r_[0, np.cumsum(page.chars)]
    return sums[page.end] - sums[: len(page.tag)]
