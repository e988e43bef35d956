"""A small tolerant reader of HTML pages: nodes, their text pieces, and features of the nodes.

Task-side helper of html_text. It follows the usual rules for void, raw-text and implied end tags; it builds no styles
and runs no scripts.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np

# Element names by their role in the language, and words that authors put into class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math select object".split())
BLOCK = frozenset("""address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section
    summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ASIDE_TAGS = frozenset("nav footer aside header form button menu dialog fieldset label input".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_WORDS = frozenset("""nav navbar navigation menu footer header masthead sidebar aside ad ads advert adverts advertisement banner promo
    promotion sponsor sponsored cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription share sharing
    social related recommended comment comments reply replies respond breadcrumb breadcrumbs pagination pager login signin signup
    search toolbar widget disclaimer copyright skip""".split())
MAIN_WORDS = frozenset("article content main post entry story text".split())

TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACES = re.compile(r"[ \t\n\r\f\v]+")
PUNCTUATION = re.compile(r"[.,;:!?]")

FEATURES = ["tag_kind", "heading", "paragraph", "list_item", "link", "block", "depth", "place", "siblings", "like_siblings", "children", "nodes", "paragraphs",
            "chars", "own_chars", "words", "link_share", "punctuation", "tag_density", "page_share", "chars_per_child", "main_words", "aside_words", "in_main", "in_aside"]
#: Features that name a part outright; training also sees rows without them, so that the rest must serve on plain pages.
NAMED = [FEATURES.index(x) for x in ("tag_kind", "main_words", "aside_words", "in_main", "in_aside")]


@lru_cache(4096)
def _marks(tag: str, attributes: str) -> tuple[int, int]:
    """Words for main and for side parts in a tag and its attributes."""
    words = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            words += re.findall(r"[a-z]+", (a or b or c).lower())
        elif name.lower() == "hidden":
            words.append("overlay")
    return (tag in MAIN_TAGS) + sum(w in MAIN_WORDS for w in words), (tag in ASIDE_TAGS) + sum(w in ASIDE_WORDS for w in words)


class Page:
    """Nodes in page order (0 is the root) and pieces of text: (node, block number, text)."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.marks = ["#root"], [-1], [(0, 0)]
        self.pieces: list[tuple[int, int, str]] = []
        self._read(source or "")

    def _read(self, s: str) -> None:
        tag, parent, stack, block, at, n = self.tag, self.parent, [0], 0, 0, len(s)

        def add(text: str) -> None:
            if text:
                self.pieces.append((stack[-1], block, html.unescape(text) if "&" in text else text))

        while at < n:
            m = TAG.search(s, at)
            if not m:
                add(s[at:])
                break
            add(s[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, close = name.lower(), m[1] if m[2] else m[4]
            if close:
                for k in range(len(stack) - 1, 0, -1):
                    if tag[stack[k]] == name:
                        del stack[k:]
                        break
                block += name in BLOCK
                continue
            if name == "br":
                self.pieces.append((stack[-1], block, " "))
                continue
            if name in CLOSES_P:
                self._close(stack, {"p"}, ())
            if name in CLOSED_BY:
                self._close(stack, *CLOSED_BY[name])
            block += name in BLOCK
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(s, at)
                at = end.end() if end else n
                continue
            tag.append(name)
            parent.append(stack[-1])
            self.marks.append(_marks(name, m[3] if m[2] else m[6]))
            if name not in VOID:
                stack.append(len(tag) - 1)

    def _close(self, stack: list[int], names, bounds) -> None:
        """Close the nearest open element of these names, unless a bound or another block-level holder is nearer."""
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in names:
                del stack[k:]
                return
            if t in bounds or (t in BLOCK and t != "p" and not bounds):
                return

    def judged(self) -> list[bool]:
        """Nodes that are kept or left out by themselves: blocks, and named side parts; other elements go with their parents."""
        return [t in BLOCK or m[1] > 0 for t, m in zip(self.tag, self.marks)]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Features of each node, and its weak label: 1 main text, 0 side part, -1 unknown."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        own, words, link, punct = [0] * n, [0] * n, [0] * n, [0] * n
        in_main, in_aside, depth = [0] * n, [0] * n, [0] * n
        kids, seen, nodes, paras = [0] * n, [0] * n, [1] * n, [0] * n
        kinds: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = parent[i]
            seen[i] = kids[p]
            kids[p] += 1
            depth[i] = depth[p] + 1
            in_aside[i] = int(in_aside[p] or self.marks[i][1] > 0)
            in_main[i] = int(not in_aside[i] and (in_main[p] or self.marks[i][0] > 0))
            kinds[p, tag[i]] = kinds.get((p, tag[i]), 0) + 1
        for node, _, text in self.pieces:
            text = text.strip()
            own[node] += len(text)
            words[node] += text.count(" ") + 1 if text else 0
            punct[node] += len(PUNCTUATION.findall(text))
        chars = own[:]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if tag[i] == "a":
                link[i] = chars[i]
            chars[p] += chars[i]
            words[p] += words[i]
            link[p] += link[i]
            punct[p] += punct[i]
            nodes[p] += nodes[i]
            paras[p] += paras[i] + (tag[i] == "p")
        whole = chars[0] + 1
        rows = []
        for i in range(n):
            t, c, m = tag[i], chars[i], self.marks[i]
            sib = kids[parent[i]] if i else 1
            rows.append((1 if t in MAIN_TAGS else -1 if t in ASIDE_TAGS else 0, t in _HEADINGS, t == "p", t in ("li", "dt", "dd"), t == "a", t in BLOCK, depth[i],
                         seen[i] / sib, sib, kinds[parent[i], t] / sib if i else 1, kids[i], nodes[i], paras[i], c, own[i], words[i], link[i] / (c + 1),
                         punct[i] / (words[i] + 1), nodes[i] / (c + 1), c / whole, c / (kids[i] + 1), m[0], m[1], in_main[i], in_aside[i]))
        label = [0 if in_aside[i] else 1 if in_main[i] else -1 for i in range(n)]
        for i in range(n - 1, 0, -1):
            if label[i] == 1 and label[parent[i]] == -1:
                label[parent[i]] = 1
        return np.array(rows, np.float64), np.array(label, np.int8)

    def text(self, keep) -> str:
        """Text of the kept nodes: white space inside a block as one space, blocks in page order by line feeds."""
        out, block, parts = [], None, []
        for node, b, piece in self.pieces:
            if keep[node]:
                if b != block:
                    out.append("".join(parts))
                    parts, block = [], b
                parts.append(piece)
        out.append("".join(parts))
        return "\n".join(x for x in (SPACES.sub(" ", t).strip(" ") for t in out) if x)


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
