"""Pages of known layout to train the block labeller on: texts of the given pages, set anew in layouts drawn at random.

Real pages tell which blocks are main text only where they mark it (an article or main element), and one site has one
layout. Pages made here have menus, headers, footers, sidebars, notices, adverts, forms, comments, shares and
related links around and within an article, with tags and class names drawn at random. Each block starts with a mark that
tells its label, which read_labels() takes off again.
"""

from __future__ import annotations

import html

import numpy as np

from sparkseek.llm.html_blocks import CUE, CUES, TAGS, Block, blocks

MAIN, REST = "\ue000", "\ue001"  # private use
#: Phrases that pages of any language may hold outside of their text.
PHRASES = (
    "We use cookies to improve your experience.|By using this site you accept our privacy policy.|Accept all|Subscribe to our newsletter|Your e-mail address|Sign up|"
    "Log in|Search|Send|Share this|Tweet|Follow us|Read more|Related articles|You may also like|Most popular|Comments|Leave a reply|Reply|Load more comments|"
    "All rights reserved.|Privacy policy|Terms of use|Contact|About us|Imprint|Home|Next|Previous|Skip to content|Advertisement|Sponsored|Buy now|Menu"
).split("|")
_CONTAINER = frozenset(TAGS.index(t) for t in ("article", "main"))
_OUTSIDE = frozenset(TAGS.index(t) for t in ("nav", "aside", "footer", "form", "button", "select", "textarea", "menu", "dialog", "search"))
_OUTSIDE |= {CUE + k for k, name in enumerate(CUES) if name not in ("content", "layout")}


def marked(found: list[Block]) -> np.ndarray | None:
    """Labels (1 main, 0 rest) of a page's blocks by its own marks; None where it has no article or main element."""
    if not any(_CONTAINER & b.places for b in found):
        return None
    return np.array([bool(_CONTAINER & b.places) and not _OUTSIDE & b.places for b in found], np.float32)


def read_labels(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a page made here, their marks taken off, and labels."""
    found, labels = [], []
    for b in blocks(page):
        labels.append(float(b.text[0] == MAIN))
        text = " ".join(b.text.replace(MAIN, "").replace(REST, "").split())
        found.append(b._replace(text=text, linked=min(b.linked, len(text))))
    return found, np.array(labels, np.float32)


class Maker:
    """Draws pages. prose: texts of main blocks; rest: texts of other blocks."""

    def __init__(self, seed: int, prose: list[str], rest: list[str]):
        self.random = np.random.default_rng(seed)
        clean = lambda texts: [t.replace(MAIN, "").replace(REST, "") for t in texts]
        self.prose, self.rest = clean(prose) or ["text"], [*clean(rest), *PHRASES]

    def often(self, share: float) -> bool:
        return self.random.random() < share

    def pick(self, choices):
        return choices[int(self.random.integers(len(choices)))]

    def some(self, low: int, high: int) -> range:
        return range(int(self.random.integers(low, high + 1)))

    def words(self, low: int, high: int) -> str:
        n = int(self.random.integers(low, high + 1))
        have = self.pick(self.prose).split() or ["text"]
        at = int(self.random.integers(max(1, len(have) - n + 1)))
        return " ".join(have[at : at + n])

    def names(self, cue: str) -> str:
        """class and id attributes for a part of a page; now and then names that tell nothing, or none."""
        if self.often(0.15):
            return "" if self.often(0.5) else f' class="c{int(self.random.integers(900))}"'
        name = self.pick(CUES[cue])
        if self.often(0.4):
            name = f"{name}{self.pick('-_')}{self.pick('box area list section block inner item wrapper container content links'.split())}"
        if self.often(0.3):
            name = f"{self.pick('site page main post article global js left right top the entry'.split())}-{name}"
        if self.often(0.1):
            name = name.title().replace("-", "")
        return f' {self.pick(["class", "class", "id"])}="{name}"'

    def text(self, mark: str, text: str) -> str:
        """A text with its mark, some of it in elements within the line."""
        words = [html.escape(w, quote=False) for w in text.split()] or ["text"]
        if len(words) > 2 and self.often(0.25):
            at = int(self.random.integers(len(words) - 1))
            tag = self.pick(["a href='/x'", "b", "em", "span", "code", "i", "strong", "a href=y class=link"])
            words[at] = f"<{tag}>{words[at]}"
            words[at + 1] = f"{words[at + 1]}</{tag.split()[0]}>"
        if len(words) > 6 and self.often(0.05):
            words.insert(3, "<br>")
        return mark + self.pick([" ", "\n", "  "]).join(words) if self.often(0.2) else mark + " ".join(words)

    def other(self, low: int, high: int) -> str:
        return self.text(REST, self.pick(self.rest) if self.often(0.4) else self.words(low, high))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{int(self.random.integers(99))}">{REST}{html.escape(self.pick(self.rest) if self.often(0.2) else self.words(low, high), quote=False)}</a>'

    def within(self, tags: str, cue: str, inner: str) -> str:
        tag = self.pick(tags.split())
        names = "" if tag not in ("div", "section", "ul", "ol", "p") and self.often(0.5) else self.names(cue)
        return f"<{tag}{names}>{inner}</{tag}>"

    def links(self, low: int = 1, high: int = 3) -> str:
        if self.often(0.7):
            tag = self.pick(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.link(low, high)}</li>" for _ in self.some(2, 9)) + f"</{tag}>"
        return self.pick([" | ", " ", "<br>"]).join(self.link(low, high) for _ in self.some(2, 7)) or self.link()

    def menu(self) -> str:
        return self.within("nav nav div ul", "menu", self.links())

    def header(self) -> str:
        top = self.within("div h1 h2 p a span", "header", self.other(1, 4))
        return self.within("header header div", "header", top + (f"<p>{self.other(3, 9)}</p>" if self.often(0.4) else "") + (self.menu() if self.often(0.7) else ""))

    def footer(self) -> str:
        inner = "".join(self.pick([lambda: f"<p>{self.other(2, 14)}</p>", self.links, lambda: self.other(3, 12), lambda: f"<div>&copy; {self.other(2, 8)}</div>"])() for _ in self.some(1, 3))
        return self.within("footer footer div", "footer", inner or "&copy; " + self.other(1, 5))

    def advert(self) -> str:
        return self.within("div div aside section", "advert", self.pick([lambda: self.other(3, 30), lambda: f"<p>{self.other(3, 25)}</p>{self.link()}", lambda: f"<h4>{self.other(2, 6)}</h4><p>{self.other(5, 30)}</p>"])())

    def notice(self) -> str:
        return self.within("div div section dialog", "notice", self.pick([lambda: f"<p>{self.other(4, 30)}</p><button>{self.other(1, 2)}</button>", lambda: self.other(4, 30), lambda: f"{self.other(4, 20)}<a>{REST}OK</a>"])())

    def form(self) -> str:
        parts = [lambda: f"<label>{self.other(1, 3)}</label><input>", lambda: f"<p>{self.other(2, 14)}</p>", lambda: f"<button>{self.other(1, 2)}</button>", lambda: f"<select><option>{self.other(1, 2)}<option>{self.other(1, 2)}</select>", lambda: f"<h3>{self.other(2, 6)}</h3>"]
        inner = "".join(self.pick(parts)() for _ in self.some(1, 5)) or parts[0]()
        return self.within("form form div section", "form", inner)

    def share(self) -> str:
        return self.within("div ul section", "social", self.links(1, 1))

    def related(self) -> str:
        items = self.links(3, 11) if self.often(0.7) else "".join(f"<div><h4>{self.link(3, 9)}</h4><p>{self.other(5, 25)}</p></div>" for _ in self.some(1, 4))
        return self.within("section div aside div", "related", f"<{(h := self.pick(['h2', 'h3', 'h4', 'p']))}>{self.other(1, 4)}</{h}>{items}")

    def sidebar(self) -> str:
        return self.within("aside aside div section", "sidebar", "".join(self.pick([self.related, self.advert, self.form, self.menu, lambda: f"<h3>{self.other(1, 4)}</h3><p>{self.other(4, 40)}</p>"])() for _ in self.some(1, 4)) or self.links())

    def comments(self) -> str:
        tag = self.pick(["li", "div", "article", "section", "p"])
        each = lambda: self.pick([f"<p>{self.other(4, 60)}</p>", self.other(4, 60), f"<cite>{REST}{self.words(1, 2)}</cite><p>{self.other(3, 40)}</p><p>{self.other(3, 40)}</p>{self.link()}"])
        items = "".join(f"<{tag}{self.names('comments') if self.often(0.7) else ''}>{each()}</{tag}>" for _ in self.some(1, 6)) or f"<p>{self.other(3, 30)}</p>"
        outer = "ol ul" if tag == "li" else "section div"
        head = f"<h3>{self.other(1, 4)}</h3>" if self.often(0.6) else ""
        tag = self.pick(["section", "div"])
        inner = head + self.within(outer, "comments", items) + (self.form() if self.often(0.3) else "")
        return f'<{tag} {self.pick(["id", "class"])}="{self.pick(CUES["comments"])}">{inner}</{tag}>'

    def paragraph(self) -> str:
        t = lambda low=4, high=90: self.text(MAIN, self.pick(self.prose) if self.often(0.6) else self.words(low, high))
        kind = self.random.random()
        if kind < 0.7:
            return f"<p>{t()}</p>" if self.often(0.8) else f"<p{self.names('content')}>{t(1, 6)}"
        if kind < 0.78:
            return f"<{(h := self.pick(['h2', 'h3', 'h4']))}>{t(1, 8)}</{h}>"
        if kind < 0.84:
            tag = self.pick(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{t(1, 15)}</li>" for _ in self.some(2, 5)) + f"</{tag}>"
        if kind < 0.88:
            return f"<blockquote>{t() if self.often(0.5) else f'<p>{t()}</p>'}</blockquote>"
        if kind < 0.91:
            return f"<figure><img><figcaption>{t(2, 14)}</figcaption></figure>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{t(1, 4)}</td><td>{t(1, 4)}</td></tr>" for _ in self.some(1, 4)) + "</table>"
        if kind < 0.96:
            return f"<pre>{t(3, 30)}</pre>"
        return f"<div>{t()}</div>"

    def article(self) -> str:
        title = f"<h1{self.names('content') if self.often(0.2) else ''}>{self.text(MAIN, self.words(2, 12))}</h1>"
        inner = f"<header>{title}</header>" if self.often(0.15) else title if self.often(0.85) else ""
        if self.often(0.3):
            inner += f"<p><b>{self.text(MAIN, self.words(1, 40))}<br>"  # end tags left out
        body = ""
        for _ in self.some(1, 11):
            body += self.paragraph()
            if self.often(0.04):
                body += self.pick([self.advert, self.share, self.related, self.form, self.notice, self.sidebar])()
        inner += body if self.often(0.7) else f"<div{self.names('content')}>{body}</div>"
        if self.often(0.3):
            inner += "".join(self.pick([self.comments, self.share, self.related, self.advert])() for _ in self.some(1, 2))
        kind = self.random.random()
        if kind < 0.5:
            return self.within("article", "content", inner)
        if kind < 0.62:
            return f"<main{self.names('content') if self.often(0.3) else ''}>{inner}</main>"
        if kind < 0.72:
            return f"<main>{self.within('article', 'content', inner)}</main>"
        if kind < 0.95:
            return f'<{(t := self.pick(["div", "section"]))} {self.pick(["class", "id"])}="{self.pick(CUES["content"])}{self.pick(["", "-body", " hentry", "-inner"])}">{inner}</{t}>'
        return inner if self.often(0.5) else f"<div>{inner}</div>"

    def page(self) -> str:
        before = [self.pick([self.header, self.menu, self.notice, self.advert, self.form, self.share])() for _ in self.some(0, 4)]
        after = [self.pick([self.footer, self.comments, self.related, self.sidebar, self.advert, self.notice, self.menu, self.form, self.share])() for _ in self.some(0, 4)]
        if self.often(0.6):
            after.append(self.footer())
        middle = self.article()
        if self.often(0.3):
            side = self.sidebar()
            middle = self.pick([side + middle, middle + side])
        if self.often(0.4):
            middle = self.within("div", "layout", middle)
        body = "".join(before) + middle + "".join(after)
        return f"<html><head><title>t</title></head><body{self.names('sidebar') if self.often(0.2) else ''}>{body}</body></html>"
