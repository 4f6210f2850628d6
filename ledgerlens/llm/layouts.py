"""Labelled pages to fit the extractor on: common layouts of web pages, filled with invented prose.

No table holds pages whose main text is known, so layouts are made by rule,
of tags and names that web pages commonly use.  Every text begins with a mark
that says whether it is main text; ``plain`` takes the marks off again.
"""

from __future__ import annotations

import random

MAIN, REST = "", ""

_BODY_BOXES = (
    "article", "main", "article class='post'", "div class='content'", "div id='content'", "div class='post-content'",
    "div class='entry-content'", "div class='article-body'", "section class='story'", "div class='text'", "div id='main'",
    "main class='page'", "div class='article'", "div itemprop='articleBody'", "div role='main'", "section", "div",
)
_WRAPPERS = ("div", "div class='container'", "div class='wrapper'", "div id='page'", "section", "div class='row'", "div class='col main'")
_MENUS = ("nav", "ul class='menu'", "div class='nav'", "div id='navigation'", "nav class='navbar'", "div class='breadcrumb'", "div role='navigation'", "div class='menu'", "div class='pagination'", "ul class='links'")
_HEADERS = ("header", "div class='header'", "div id='masthead'", "div class='site-header'", "div class='top-bar'", "div id='banner'", "div class='logo'")
_FOOTERS = ("footer", "div class='footer'", "div id='footer'", "div class='site-footer'", "div class='copyright'", "div id='bottom'", "div role='contentinfo'")
_SIDES = ("aside", "div class='sidebar'", "div id='sidebar'", "div class='widget'", "div class='related'", "div class='recommended'", "aside class='trending'", "section class='related-posts'", "div class='popular'", "div class='more'", "aside class='promo'")
_ADS = ("div class='ad'", "div class='ads'", "div class='advert'", "div class='advertisement'", "div class='sponsored'", "div class='banner'", "div class='promo'", "div id='ad-top'", "aside class='ad'", "section class='sponsor'", "p class='ad'")
_NOTICES = ("div class='cookie-notice'", "div class='notice'", "div class='cookie-banner'", "div id='consent'", "div class='alert'", "div class='gdpr'", "div class='popup'", "div class='modal'", "div role='alert'", "div class='paywall'", "div role='dialog'", "p class='notice'", "div class='message'", "div class='disclaimer'")
_FORMS = ("form", "div class='newsletter'", "form class='search'", "div class='subscribe'", "form id='login'", "div class='signup'", "form class='contact'")
_SHARES = ("div class='share'", "div class='social'", "ul class='tags'", "div class='meta'", "p class='byline'", "div class='toolbar'")
_COMMENTS = ("section class='comments'", "div id='comments'", "div class='comment-list'", "ol class='comments'", "div class='responses'", "div id='disqus'", "div class='discussion'", "section id='reader-comments'", "div class='replies'")
_COMMENT = ("div class='comment'", "li class='comment'", "article class='comment'", "div class='reply'", "div")
_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi wo za ber chen dal ion ing ment qué über né tre".split()


def plain(html: str) -> str:
    return html.replace(MAIN, "").replace(REST, "")


class Layout:
    """One page, made from a seed."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        #: Some sites name nothing, others use names without meaning.
        self.naming = self.rng.choices(("all", "none", "odd"), (8, 1.5, 1))[0]
        self.loose = self.rng.random() < 0.3
        self.html = self._page()

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        if len(words) > 6 and self.rng.random() < 0.4:
            words[len(words) // 2] += ","
        return " ".join(words).capitalize() + self.rng.choices((".", "!", "?", ""), (8, 1, 1, 1))[0]

    def prose(self, mark: str, low: int = 1, high: int = 7) -> str:
        if self.rng.random() < 0.04:
            return mark + " | ".join(self.word() for _ in range(self.rng.randint(2, 60)))
        if self.rng.random() < 0.06:
            return mark + self.sentence(1, 2)
        text = [self.sentence() for _ in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.15:
            k = self.rng.randrange(len(text))
            text[k] = f"<{self.rng.choice(('b', 'i', 'em', 'strong', 'span'))}>" + text[k] + "</b>"
        if self.rng.random() < 0.1:
            text.append(f"<a href='/{self.word()}'>{self.sentence(1, 4)}</a>")
        if self.rng.random() < 0.08:
            text.insert(0, "<b>")
        return mark + self.rng.choice((" ", " ", "<br>")).join(text)

    def box(self, choices: tuple[str, ...], inner: str) -> str:
        opening = self.rng.choice(choices)
        tag, _, names = opening.partition(" ")
        if self.naming == "none":
            opening = tag if tag not in ("nav", "aside", "article", "main", "header", "footer") or self.rng.random() < 0.5 else "div"
        elif self.naming == "odd" and names:
            opening = f"{tag} class='{self.rng.choice('abcxyz')}{self.rng.randrange(999)}'"
        elif self.rng.random() < 0.15:
            opening += f" data-x='{self.rng.randrange(99)}'"
        return f"<{opening}>{inner}</{opening.partition(' ')[0]}>"

    def block(self, tag: str, inner: str) -> str:
        open_end = self.loose and tag in ("p", "li", "td", "dt", "dd") and self.rng.random() < 0.5
        return f"<{tag}>{inner}" + ("" if open_end else f"</{tag}>")

    def links(self) -> str:
        items = [f"<a href='/{self.word()}'>{REST}{self.sentence(1, 4).rstrip('.')}</a>" for _ in range(self.rng.randint(2, 9))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(self.block("li", i) for i in items) + "</ul>"
        return self.rng.choice((" ", " | ", "<br>")).join(items)

    def side(self) -> str:
        kind = self.rng.randrange(4)
        head = self.block(self.rng.choice(("h2", "h3", "h4", "p")), REST + self.sentence(1, 4)) if self.rng.random() < 0.6 else ""
        if kind == 0:
            return self.box(_SIDES, head + self.links())
        if kind == 1:
            return self.box(_SIDES, head + "".join(self.block("p", self.prose(REST, 1, 3)) for _ in range(self.rng.randint(1, 3))))
        if kind == 2:
            return self.box(_SIDES, self.box(_ADS, REST + self.sentence()) + self.links())
        return self.box(_SIDES, head + REST + self.sentence())

    def form(self) -> str:
        fields = "".join(f"<label>{REST}{self.sentence(1, 3)}</label><input name='{self.word()}'>" for _ in range(self.rng.randint(1, 3)))
        return self.box(_FORMS, (self.block("p", REST + self.sentence()) if self.rng.random() < 0.6 else "") + fields + "<button>Go</button>")

    def comments(self) -> str:
        each = []
        for _ in range(self.rng.randint(1, 6)):
            who = self.block(self.rng.choice(("h4", "span", "div", "p")), REST + self.sentence(1, 3)) if self.rng.random() < 0.7 else ""
            said = self.block("p", self.prose(REST, 1, 4)) if self.rng.random() < 0.8 else self.prose(REST, 1, 3)
            each.append(self.box(_COMMENT, who + said))
        head = self.block("h3", REST + self.sentence(1, 3)) if self.rng.random() < 0.6 else ""
        return self.box(_COMMENTS, head + "".join(each) + (self.form() if self.rng.random() < 0.3 else ""))

    def insert(self) -> str:
        kind = self.rng.randrange(5)
        if kind == 0:
            return self.box(_ADS, REST + self.sentence(2, 25))
        if kind == 1:
            return self.box(_NOTICES, self.prose(REST, 1, 2) if self.rng.random() < 0.5 else self.block("p", self.prose(REST, 1, 3)))
        if kind == 2:
            return self.box(_SHARES, self.links() if self.rng.random() < 0.5 else REST + self.sentence(1, 5))
        return self.form() if kind == 3 else self.side()

    def article(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            title = f"<h1>{MAIN}{self.sentence(1, 14)}</h1>"
            out.append(f"<header>{title}</header>" if rng.random() < 0.1 else title)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6, 9, 14))):
            kind = rng.random()
            if kind < 0.72:
                out.append(self.block("p", self.prose(MAIN)))
            elif kind < 0.78:
                out.append(self.block(rng.choice(("h2", "h3")), MAIN + self.sentence(1, 8)))
            elif kind < 0.84:
                out.append("<ul>" + "".join(self.block("li", self.prose(MAIN, 1, 2)) for _ in range(rng.randint(1, 6))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote>{self.block('p', self.prose(MAIN, 1, 3))}</blockquote>")
            elif kind < 0.90:
                rows = ("".join(self.block("td", MAIN + self.sentence(1, 4)) for _ in range(3)) for _ in range(rng.randint(1, 4)))
                out.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
            elif kind < 0.92:
                out.append(f"<pre>{MAIN}{self.sentence()}\n  {self.sentence()}</pre>")
            elif kind < 0.95:
                out.append(f"<figure><img src='x'><figcaption>{MAIN}{self.sentence(2, 9)}</figcaption></figure>")
            else:
                out.append(f"<div>{self.prose(MAIN, 1, 4)}</div>")
            if rng.random() < 0.1:
                out.append(self.insert())
        if not out:
            out.append(self.block("p", self.prose(MAIN, 1, 2)))
        if rng.random() < 0.15:
            out.append(self.insert())
        if rng.random() < 0.12:
            out.append(self.comments())
        return self.box(_BODY_BOXES, "".join(out))

    def _page(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.4:
            out.append(self.box(_NOTICES, self.block("p", self.prose(REST, 1, 3)) if rng.random() < 0.5 else self.prose(REST, 1, 2)))
        if rng.random() < 0.6:
            out.append(self.box(_HEADERS, REST + self.sentence(1, 5) + (self.box(_MENUS, self.links()) if rng.random() < 0.5 else "")))
        if rng.random() < 0.8:
            out.append(self.box(_MENUS, self.links()))
        for _ in range(rng.choice((0, 0, 1, 2))):
            out.append(self.insert())
        middle = [self.article()]
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            middle.insert(rng.randint(0, len(middle)), self.side())
        if rng.random() < 0.35:
            middle.append(self.comments())
        joined = "".join(middle)
        for _ in range(rng.choice((0, 0, 1, 2))):
            joined = self.box(_WRAPPERS, joined)
        out.append(joined)
        if rng.random() < 0.3:
            out.append(self.insert())
        if rng.random() < 0.85:
            out.append(self.box(_FOOTERS, f"{REST}&copy; {self.sentence()}" + (self.links() if rng.random() < 0.4 else "")))
        head = f"<!DOCTYPE html><html><head><title>{self.sentence(1, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        page = f"{head}<body>{''.join(out)}</body></html>"
        if rng.random() < 0.1:
            page = page[: int(len(page) * rng.uniform(0.75, 1))]
        return page
