"""Blocks of an HTML page in page order: the text between block-level tags, with the tags and classes it stands in."""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

#: Fixed values of HTML: elements that have no end tag, whose content is no text of the page, and that stay within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template title iframe svg math object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark meter output picture q ruby rb rp rt rtc s samp small "
    "span strike strong sub sup time tt u var wbr br nobr progress".split()
)
#: What an opening tag ends, if it is open, and what hides it from the tag.
_ENDS = {
    "li": [({"li"}, {"ul", "ol", "menu"})], "dt": [({"dt", "dd"}, {"dl"})], "dd": [({"dt", "dd"}, {"dl"})],
    "tr": [({"td", "th"}, {"tr", "table"}), ({"tr"}, {"table"})], "td": [({"td", "th"}, {"tr", "table"})], "th": [({"td", "th"}, {"tr", "table"})],
    "option": [({"option"}, {"select"})], "a": [({"a"}, {"td", "th", "caption"})],
}
_BARRIERS = frozenset("td th caption button body table".split())
#: Tags that have a place of their own in a path; others share one.
TAGS = (
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul"
).split()
#: Words of classes, ids and roles that tell what a part of a page is for.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pagination pager tabs skip topics".split(),
    "header": "header head masthead topbar logo branding tagline".split(),
    "footer": "footer foot copyright colophon legal imprint bottom contentinfo".split(),
    "sidebar": "sidebar side aside rail widget widgets secondary complementary column".split(),
    "comments": "comment comments commentlist reply replies disqus respond discussion thread feedback responses".split(),
    "notice": "cookie cookies consent gdpr notice alert banner popup modal overlay dialog toast announcement warning paywall".split(),
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion commercial outbrain taboola".split(),
    "social": "share sharing social follow tweet facebook twitter".split(),
    "related": "related recommended recommendations more popular trending latest also teaser teasers".split(),
    "form": "form search newsletter subscribe subscription signup signin login register contact poll".split(),
    "content": "article content post entry story body text main copy prose single".split(),
    "layout": "page wrapper container wrap layout row inner outer grid site".split(),
}
_CUE = {word: k for k, words in enumerate(CUES.values()) for word in words}
HASHED = 32
#: Places of a path's features: tags on it, cues on it, cues of its last two elements, its last tag, other words by hash.
N_TAGS, N_CUES = len(TAGS) + 1, len(CUES)
ON_PATH, CUE, NEAR, LAST, OTHER = 0, N_TAGS, N_TAGS + N_CUES, N_TAGS + 2 * N_CUES, 2 * N_TAGS + 2 * N_CUES
PLACES = OTHER + HASHED
_TAG_PLACE = {name: k for k, name in enumerate(TAGS)}
_TAG = re.compile(r"<(?:(!--)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*))")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CLOSERS: dict[str, re.Pattern] = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in OPAQUE}


class Node:
    """An open element: what its path, down from the page, has of features."""

    __slots__ = ("block", "cues", "name", "path", "places")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        self.name, self.block = name, name not in INLINE
        if not self.block:  # text within a line has the features of its block
            self.path, self.cues, self.places = (parent.path, parent.cues, parent.places) if parent else (frozenset(), frozenset(), frozenset())
            return
        tag = _TAG_PLACE.get(name, len(TAGS))
        self.cues, other = _words(attributes) if "=" in attributes and name != "body" else (frozenset(), frozenset())
        own = other | {CUE + c for c in self.cues} | {ON_PATH + tag}
        self.path = own if parent is None else parent.path if own <= parent.path else parent.path | own
        near = self.cues if parent is None else self.cues | parent.cues
        self.places = self.path | {NEAR + c for c in near} | {LAST + tag}


class Block(NamedTuple):
    """text: characters decoded, white space as single spaces; linked: characters of it inside links; places: features of
    the path it starts in."""

    text: str
    linked: int
    places: frozenset


def _words(attributes: str) -> tuple[frozenset, frozenset]:
    values = tuple((m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(attributes))
    return _told(values) if values else (frozenset(), frozenset())


@lru_cache(maxsize=1 << 14)
def _told(values: tuple) -> tuple[frozenset, frozenset]:
    words = {w.lower() for v in values for w in _PIECES.findall(v)}
    cues = frozenset(_CUE[w] for w in words if w in _CUE)
    return cues, frozenset(OTHER + zlib.crc32(w.encode()) % HASHED for w in words if w not in _CUE)


def _end(page: str, at: int) -> int:
    """Where the tag whose attributes start at a place ends, not counting > within quotes; -1 if it doesn't."""
    first = end = page.find(">", at)
    for _ in range(16):
        if end < 0:
            return first
        inside = page[at:end]
        if inside.count('"') % 2 == 0 and ("'" not in inside or re.sub(r'"[^"]*"', "", inside).count("'") % 2 == 0):
            return end
        end = page.find(">", end + 1)
    return first


def blocks(page: str | None) -> list[Block]:
    """All blocks with text. Scripts, styles, comments and titles are no blocks; a tag that never ends, and what follows it,
    is none either. Missing end tags are supplied as browsers do for paragraphs, list items and cells."""
    found: list[Block] = []
    stack: list[Node] = []
    depth: dict[str, int] = {}
    pieces: list[str] = []
    places: frozenset | None = None
    linked = 0

    def flush() -> None:
        nonlocal places, linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                found.append(Block(text, min(linked, len(text)), places or frozenset()))
            pieces.clear()
        places, linked = None, 0

    def pop_to(k: int) -> None:
        for node in stack[k:]:
            depth[node.name] -= 1
        del stack[k:]

    def close(names: set, barriers) -> None:
        """Ends the innermost element of these names that no barrier hides."""
        if any(depth.get(n) for n in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in names:
                    pop_to(k)
                    return
                if stack[k].name in barriers:
                    return

    page, at = page or "", 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            if "&" in text:
                text = html.unescape(text)
            if text.strip():
                if places is None:
                    places = stack[-1].places if stack else frozenset()
                if depth.get("a"):
                    linked += len(text)
            pieces.append(text)
        if not m:
            break
        if m[1]:
            end = page.find("-->", m.end() - 2)
            at = end + 3 if end >= 0 else len(page)
            continue
        end = _end(page, m.end())
        at = end + 1 if end >= 0 else len(page)
        if m[2] or end < 0:
            continue
        name = m[4].lower()
        inline = name in INLINE or name in OPAQUE
        if not inline:
            flush()
        elif name == "br":
            pieces.append(" ")
        if m[3]:
            if depth.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        pop_to(k)
                        break
                    if inline and stack[k].block:
                        break
        elif name in _CLOSERS:
            if page[end - 1] != "/" or name in ("script", "style", "title"):
                done = _CLOSERS[name].search(page, at)
                stop = page.find(">", done.end()) if done else -1
                at = stop + 1 if stop >= 0 else len(page)
        elif name not in VOID and name not in ("html", "head"):
            if not inline:
                close({"p"}, _BARRIERS)
            for names, barriers in _ENDS.get(name, ()):
                close(names, barriers)
            stack.append(Node(name, page[m.end() : end], stack[-1] if stack else None))
            depth[name] = depth.get(name, 0) + 1
    flush()
    return found
