"""A page as an array of DOM nodes with figures, for operator 12.

`Page(html)` reads the whole page in one pass: comments, declarations and the inside
of scripts and styles go, character references are decoded, unclosed and misnested
elements are closed as browsers do (a paragraph by the next block, a list item by the
next, anything by the end of its parent).  Nodes are the elements other than plain
inline formatting; they are numbered in page order, so the nodes below node i are
those from i + 1 to `end[i]`.
"""

from __future__ import annotations

import re
from html import unescape

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(
    r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NOT_WORD = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their inside is neither markup nor text of the page: skipped up to the end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I)
       for t in "script style iframe noembed noframes textarea title".split()}
_HEAD = frozenset("head title meta link script style base noscript template".split())
#: Nothing below them is text of the page.
SILENT = frozenset("head noscript template object svg math canvas audio video select "
                   "datalist".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center caption dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul hr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

#: tag -> kind of node
KINDS = ("html body article main section div p heading list item nav header footer aside form control "
         "table cell quote figure inline other").split()
_KIND = {**{k: k for k in ("html body article main section div p nav header footer aside".split())},
         **{f"h{n}": "heading" for n in range(1, 7)}, "hgroup": "heading",
         **dict.fromkeys("ul ol dl menu dir".split(), "list"),
         **dict.fromkeys("li dt dd".split(), "item"),
         **dict.fromkeys("form fieldset search dialog".split(), "form"),
         **dict.fromkeys("input button label option legend select textarea".split(), "control"),
         **dict.fromkeys("table thead tbody tfoot tr caption".split(), "table"),
         **dict.fromkeys("td th".split(), "cell"), "blockquote": "quote", "pre": "quote",
         **dict.fromkeys("figure figcaption".split(), "figure"),
         **dict.fromkeys(INLINE, "inline")}
KIND_ID = {k: i for i, k in enumerate(KINDS)}
_LANDMARKS = ("article", "main", "nav", "header", "footer", "aside", "form")

#: Words of class, id, role and similar attributes, by what they say of a node.
WORDS = {
    "content": "article articlebody body content entry main maincontent news post postcontent story "
               "text prose reading read",
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager tabs toc topnav "
            "sitenav skip links linklist",
    "header": "header masthead topbar logo branding brand banner tagline hero head sitename",
    "footer": "footer foot copyright colophon legal bottom imprint contentinfo",
    "sidebar": "sidebar side aside widget widgets rail complementary column secondary",
    "notice": "notice alert cookie cookies consent gdpr privacy popup modal overlay dialog message "
              "warning toast announcement disclaimer notification subscribe paywall",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo "
              "promoted promotion promotions banner adbox adslot adsense dfp outbrain taboola affiliate",
    "form": "form login signin signup search register newsletter contact input field checkout "
            "subscription poll survey",
    "comments": "comment comments commentlist discussion disqus reply replies respond responses review "
                "reviews feedback reader readers thread forum guestbook",
    "share": "share sharing social tweet facebook twitter like follow",
    "related": "related recommended recommendations more popular trending similar readmore latest "
               "archive tags tag category categories also next previous",
    "byline": "author byline date meta published timestamp posted dateline credit",
    "hidden": "hidden none invisible offscreen sr",
}
_WORD_BIT = {w: 0 for ws in WORDS.values() for w in ws.split()}
for _i, _ws in enumerate(WORDS.values()):
    for _w in _ws.split():
        _WORD_BIT[_w] |= 1 << _i
_HIDDEN_BIT = 1 << list(WORDS).index("hidden")
_READ = frozenset(("class", "id", "role", "itemprop", "aria-label", "data-component", "data-testid"))

_SCOPE = frozenset("table td th caption button template html body".split())
#: start tag -> (tags it closes, tags that stop the search)
_CLOSES = {
    "li": (("li",), frozenset("ul ol menu dir".split())),
    "dt": (("dt", "dd"), frozenset(("dl",))), "dd": (("dt", "dd"), frozenset(("dl",))),
    "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))),
    "tr": (("tr",), frozenset(("table",))),
    "tbody": (("tbody", "thead", "tfoot"), frozenset(("table",))),
    "thead": (("tbody", "thead", "tfoot"), frozenset(("table",))),
    "tfoot": (("tbody", "thead", "tfoot"), frozenset(("table",))),
    "option": (("option",), frozenset(("select", "datalist"))),
}
_PUNCT = re.compile(r"[.,;:!?。、]")


def _attributes(raw: str) -> tuple[int, str | None]:
    """Word groups that the attributes name, and the role a training page gives."""
    bits, role = 0, None
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in _READ:
            for word in _NOT_WORD.split(_CAMEL.sub(" ", unescape(value)).lower()):
                bits |= _WORD_BIT.get(word, 0)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or \
                (name == "style" and "display:none" in value.replace(" ", "")):
            bits |= _HIDDEN_BIT
        elif name == "data-truth":
            role = value
    return bits, role


class Page:
    """Nodes (parallel lists), and the text pieces with their owners.

    `pieces` holds (node, text); an owner of -1 marks the edge of a block."""

    def __init__(self, html: str | None):
        self.kind: list[int] = []
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []
        self.words: list[int] = []       # word groups of the node's own attributes
        self.above: list[int] = []       # and of the nodes above it
        self.landmarks: list[int] = []   # landmark elements above it
        self.role: list[str | None] = []
        self.chars: list[int] = []       # own text: characters, in links, words, signs
        self.linked: list[int] = []
        self.n_words: list[int] = []
        self.signs: list[int] = []
        self.links: list[int] = []
        self.pieces: list[tuple[int, str]] = []
        self._read(html or "")

    def _open(self, tag: str, kind: str, parent: int, bits: int, role: str | None) -> int:
        i = len(self.kind)
        self.kind.append(KIND_ID[kind])
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(bits)
        self.role.append(role)
        self.end.append(0)
        for figures in (self.chars, self.linked, self.n_words, self.signs, self.links):
            figures.append(0)
        if parent < 0:
            self.depth.append(0)
            self.above.append(0)
            self.landmarks.append(0)
        else:
            self.depth.append(self.depth[parent] + 1)
            self.above.append(self.above[parent] | self.words[parent])
            mark = KINDS[self.kind[parent]]
            self.landmarks.append(self.landmarks[parent] | (
                1 << _LANDMARKS.index(mark) if mark in _LANDMARKS else 0))
        return i

    def _read(self, html: str) -> None:
        root = self._open("html", "html", -1, 0, None)
        # open elements: (tag, node that owns their text, is a node); how many of each tag
        stack: list[tuple[str, int, bool]] = [("html", root, True)]
        count: dict[str, int] = {}
        silent = links = 0
        at = 0

        def close(keep: int) -> None:
            nonlocal silent, links
            while len(stack) > keep:
                tag, node, own = stack.pop()
                count[tag] -= 1
                silent -= tag in SILENT
                links -= tag == "a"
                if own:
                    self.end[node] = len(self.kind)
                if tag in BLOCK:
                    self.pieces.append((-1, ""))

        def shut(tags, stops) -> None:
            if any(count.get(t) for t in tags):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in tags:
                        return close(k)
                    if stack[k][0] in stops:
                        return None

        def text(raw: str) -> None:
            if not silent and raw:
                node = stack[-1][1]
                t = unescape(raw) if "&" in raw else raw
                self.pieces.append((node, t))
                n = len(t.strip())
                if n:
                    self.chars[node] += n
                    self.n_words[node] += t.count(" ") + 1
                    self.signs[node] += len(_PUNCT.findall(t))
                    if links:
                        self.linked[node] += n

        find = _TOKEN.search
        while (m := find(html, at)) is not None:
            text(html[at:m.start()])
            at = m.end()
            name = m["tag"] or m["tag2"]
            if name is None:
                if m["data"]:
                    text(m["data"].replace("&", "&amp;"))
                if not m["end"]:
                    continue
                tag = m["end"].lower()
                if tag == "br":
                    text(" ")
                elif count.get(tag):
                    inline = tag in INLINE
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        # formatting does not close blocks, nor a block the cell around it
                        if (inline and stack[k][0] in BLOCK) or \
                                (tag != "table" and stack[k][0] in ("td", "th")
                                 and tag not in ("tr", "tbody", "thead", "tfoot", "body", "html")):
                            break
                continue
            tag, raw = name.lower(), m["attrs"] or m["attrs2"] or ""
            if tag == "html":
                bits, role = _attributes(raw)
                self.words[root] |= bits
                continue
            if tag == "br" or tag == "wbr":
                if tag == "br":
                    text(" ")
                continue
            if tag not in _HEAD and count.get("head"):
                shut(("head",), ())
            if tag in BLOCK:
                if count.get("p"):
                    shut(("p",), _SCOPE)
                if tag in _CLOSES:
                    shut(*_CLOSES[tag])
                self.pieces.append((-1, ""))
            elif tag in _CLOSES:
                shut(*_CLOSES[tag])
            bits, role = _attributes(raw) if raw and raw != "/" else (0, None)
            node = stack[-1][1]
            plain = tag in INLINE and not bits and not role
            if tag == "a":
                self.links[node] += 1
            if not plain:
                node = self._open(tag, _KIND.get(tag, "other"), node, bits, role)
                self.end[node] = len(self.kind)
            if tag in VOID:
                continue
            if tag in RAW:
                at = RAW[tag].search(html, at).end()
                continue
            stack.append((tag, node, not plain))
            count[tag] = count.get(tag, 0) + 1
            silent += tag in SILENT
            links += tag == "a"
        text(html[at:])
        count["html"] = count.get("html", 0) + 1
        close(0)

    def main_text(self, keep) -> str:
        """Text whose owner `keep` marks: one line per block."""
        lines: list[str] = []
        held: list[str] = []
        for node, t in self.pieces:
            if node < 0:
                if held:
                    lines.append(" ".join("".join(held).split()))
                    held = []
            elif keep[node]:
                held.append(t)
        if held:
            lines.append(" ".join("".join(held).split()))
        return "\n".join(x for x in lines if x)
