"""HTML as blocks of text in page order, with what their markup says of them."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Fixed values of HTML: elements that end a block, that hold no text of the page, whose content is raw, and that have no end.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul noscript".split()
)
UNSEEN = frozenset("head script style template svg math iframe object canvas audio video map select datalist button textarea noembed noframes title xmp".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends open elements of these names, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}

#: What elements, roles and names of classes say, in nats for content: read as prefixes of the words of class and id.
STRONG, WEAK, GOOD = -9.0, -4.0, 4.0
ELEMENTS = {"nav": STRONG, "footer": STRONG, "aside": STRONG, "noscript": STRONG, "dialog": STRONG, "menu": STRONG, "header": WEAK, "form": WEAK, "search": STRONG, "fieldset": WEAK, "article": GOOD, "main": GOOD}
ROLES = {"navigation": STRONG, "contentinfo": STRONG, "complementary": STRONG, "search": STRONG, "dialog": STRONG, "alertdialog": STRONG, "menu": STRONG, "menubar": STRONG, "banner": WEAK, "alert": WEAK, "form": WEAK, "main": GOOD, "article": GOOD}
BAD_WORDS = re.compile(
    "comment|disqus|repl(?:y|ies)$|respon(?:d|ses?)$|discussion|advert|sponsor|promo|cookie|consent|gdpr|notices?$|notification|popup|modal|overlay|newsletter|subscri|"
    "signup|login|share|sharing|social|related|recommend|sidebar|widget|menu|nav|breadcrumb|footer|masthead|copyright|pagination|pager$|skip|"
    "ad$|ads$|adbox|adslot|adsense|adunit|banner|topbar|toolbar|trending|popular|outbrain|taboola|paywall"
)
WEAK_WORDS = re.compile("header|head$|foot$|form|side$|aside|alerts?$|warning|message|search|tags?$|meta$|byline|author|rail$|top$|bottom$|tools?$|links?$|legal|disclaimer|announce")
GOOD_WORDS = re.compile("article|content|post$|entry|story|main$|body|text$|blog$|prose|hentry")
NEGATED = frozenset("has no with without not hide".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/\"']|$)", re.I | re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links, spaces among them
    tag: str
    node: int
    said: float  # what the markup around it says


class Page(NamedTuple):
    blocks: list[Block]
    parent: list[int]  # of each element
    mark: list[int]  # of each element the nearest one around it whose markup says something


def named(words: str) -> float:
    """What the words of a class or an id say."""
    found = [w.lower() for w in _WORDS.findall(words)]
    kept = [w for k, w in enumerate(found) if not (k and found[k - 1] in NEGATED)]
    for pattern, said in ((BAD_WORDS, STRONG), (WEAK_WORDS, WEAK), (GOOD_WORDS, GOOD)):
        if any(pattern.match(w) for w in kept):
            return said
    return 0.0


def marked(tag: str, attributes: str) -> float:
    """What an element says of the text inside it: the worst of its name, role, class, id and visibility, else the best."""
    said = [ELEMENTS.get(tag, 0.0)]
    if attributes.strip(" \t\n\r\f/"):
        for name, *values in _NAMED.findall(attributes):
            name, value = name.lower(), html.unescape("".join(values))
            if name in ("class", "id") and tag not in ("html", "body"):
                said.append(named(value))
            elif name == "role":
                said.append(ROLES.get(value.strip().lower(), 0.0))
            elif name == "itemprop" and value == "articleBody":
                said.append(GOOD)
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                said.append(STRONG)
    return min(said) if min(said) < 0 else max(said)


def parse(source: str) -> Page:
    """Blocks and elements of a page, by HTML's rules for raw text, implied ends and stray tags as far as they move text."""
    parent, said, mark = [-1], [0.0], [0]
    names, nodes, open_ = ["#"], [0], Counter()
    blocks: list[Block] = []
    pieces: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if pieces:
            if text := " ".join("".join(pieces).split()):
                k = next((k for k in range(len(names) - 1, 0, -1) if names[k] in BLOCK), 0)
                blocks.append(Block(text, len(" ".join("".join(linked).split())), names[k], nodes[k], said[nodes[-1]]))
            pieces.clear()
            linked.clear()

    def data(text: str) -> None:
        if text and not any(open_[x] for x in UNSEEN):
            text = html.unescape(text)
            pieces.append(text)
            if open_["a"]:
                linked.append(text)

    def pop(k: int) -> None:
        """End all elements from place k on."""
        if any(x in BLOCK for x in names[k:]):
            flush()
        for x in names[k:]:
            open_[x] -= 1
        del names[k:], nodes[k:]

    def end(ended: set[str], within: set[str]) -> None:
        """End open elements of some names, up to the nearest of others."""
        last = None
        if any(open_[x] for x in ended):
            for k in range(len(names) - 1, 0, -1):
                if names[k] in within:
                    break
                if names[k] in ended:
                    last = k
        if last:
            pop(last)

    at, raw = 0, {}
    while m := _TOKEN.search(source, at):
        data(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if m[1]:
            if tag == "br":
                pieces.append("\n")
            elif open_[tag]:
                pop(len(names) - 1 - names[::-1].index(tag))
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            if open_["p"]:
                end({"p"}, {"table", "td", "th", "caption", "button", "object"})
            if open_["head"] and tag not in ("html", "noscript"):
                end({"head"}, set())
            flush()
        elif tag == "a" and open_["a"]:
            end({"a"}, {"td", "th", "caption", "table"})
        if tag in CLOSES:
            end(*CLOSES[tag])
        if tag in VOID:
            if tag in ("br", "hr", "img", "input", "embed"):
                pieces.append("\n" if tag in ("br", "hr") else " ")
            continue
        if tag in RAW:
            stop = raw.get(tag) or raw.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])", re.I))
            found = stop.search(source, at)
            at = found.start() if found else len(source)
        own = marked(tag, m[3])
        above = said[nodes[-1]]
        parent.append(nodes[-1])
        # Good marks count once, and make up for weak ones around them alone: an article among comments is a comment.
        if own > 0:
            said.append(max(above, own) if above >= 0 else above if above <= STRONG + GOOD else above + own)
        else:
            said.append(max(2 * STRONG, above + own))
        mark.append(len(said) - 1 if own else mark[nodes[-1]])
        names.append(tag)
        nodes.append(len(said) - 1)
        open_[tag] += 1
    data(source[at:])
    flush()
    return Page(blocks, parent, mark)
