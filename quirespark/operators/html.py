"""HTML to Markdown: a small tree is built first, then written out block by block."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

from quirespark.functions import markdown as md

DROPPED = frozenset("script style noscript template svg canvas iframe form title meta link base".split())
_HEAD_ONLY = frozenset("base link meta script style title".split())
CHROME = frozenset("nav footer header aside".split())
VOID = frozenset("br hr img input meta link source track wbr col area base embed param".split())
HEADINGS = {"h" + d: int(d) for d in string.digits[1:7]}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
SHORT = 24
#: Opening one of these ends open ones of the others, up to the boundary.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    **{t: ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
_GAP = re.compile(r"\s+")
_BREAK = "\x00\x01"
_AMPERSAND = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
Attrs = list[tuple[str, str | None]]
_RAW = frozenset(("script", "style"))


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self):
        for c in self.children:
            yield c
            if isinstance(c, Node):
                yield from c.walk()

    def text(self) -> str:
        return "".join(c for c in self.walk() if isinstance(c, str))

    def find(self, *tags: str) -> list[Node]:
        return [c for c in self.walk() if isinstance(c, Node) and c.tag in tags]


class _Builder(HTMLParser):
    """Entities are decoded by the parser, which is its default."""

    def __init__(self) -> None:
        HTMLParser.__init__(self)
        self.root = Node("#")
        self.open = [self.root]

    def _pop_until(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                return
            if self.open[i].tag in tags:
                del self.open[i:]

    def handle_starttag(self, tag: str, attrs: Attrs) -> None:
        if tag in _CLOSES:
            self._pop_until({"p"} | _CLOSES[tag][0], _CLOSES[tag][1])
        elif tag not in INLINE and tag not in VOID | _RAW or tag == "hr":
            # A block ends an open paragraph, but not one outside of the cell or item it is in.
            self._pop_until({"p"}, {"td", "th", "li", "table", "blockquote", "div", "article", "section"})
        if tag in HEADINGS:
            self._pop_until(set(HEADINGS), {"td", "th", "li", "table", "div", "article", "section"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: Attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def keeps(chrome: Node) -> bool:
    """Whether a navigation, header, footer or aside holds content of the document's own."""
    prose = links = 0

    def count(node: Node, linked: bool) -> None:
        nonlocal prose, links
        for c in node.children:
            if isinstance(c, str):
                if not linked:
                    prose += len(_spaces(c).strip())
            else:
                links += c.tag == "a"
                count(c, linked or c.tag == "a")

    if chrome.find(*HEADINGS):
        return True
    count(chrome, False)
    return prose >= SHORT or (prose > 0 and chrome.tag == "header" and links > 0)


def _spaces(text: str) -> str:
    return _GAP.sub(" ", text)


class _Writer:
    def __init__(self, keep_links: bool, keep_images: bool, drop_chrome: bool, base_url: str):
        self.keep_links, self.keep_images, self.drop_chrome, self.base_url = keep_links, keep_images, drop_chrome, base_url
        self.stats = dict.fromkeys("chrome_dropped headings images links tables".split(), 0)

    def skipped(self, node: Node, in_chrome: bool) -> bool:
        if not self.drop_chrome:
            return node.tag in _HEAD_ONLY
        if node.tag in DROPPED:
            return True
        if node.tag in CHROME and not in_chrome and not keeps(node):
            self.stats["chrome_dropped"] += 1
            return True
        return False

    # -- inline

    def inline(self, nodes: list[Node | str], in_chrome: bool, in_cell: bool = False) -> str:
        text = self._inline(nodes, in_chrome)
        text = re.sub(rf" *{_BREAK} *", _BREAK, _spaces(text)).strip()
        while text.endswith(_BREAK) or text.startswith(_BREAK):
            text = text.removesuffix(_BREAK).removeprefix(_BREAK).strip()
        return text.replace(_BREAK, " " if in_cell else "  \n")

    def _inline(self, nodes: list[Node | str], in_chrome: bool) -> str:
        out = []
        for n in nodes:
            if isinstance(n, str):
                out.append(n)
            elif self.skipped(n, in_chrome):
                continue
            elif n.tag == "br":
                out.append(_BREAK)
            elif n.tag == "img":
                out.append(self._image(n))
            elif n.tag == "code" and "\n" not in n.text().strip():
                body = _spaces(n.text()).strip()
                ticks = "`" * (1 + ("`" in body))
                out.append(f"{ticks}{body}{ticks}" if body else "")
            elif n.tag in MARKS:
                body = self._inline(n.children, in_chrome)
                bare = body.strip(" \t\n\x00\x01")
                if bare:
                    at = body.index(bare)
                    out.append(body[:at] + MARKS[n.tag] + bare + MARKS[n.tag] + body[at + len(bare) :])
            elif n.tag == "a":
                label = _spaces(self._inline(n.children, in_chrome)).strip()
                href = n.attrs.get("href", "").strip()
                if not self.keep_links or not href or not label or re.match("(?:data|javascript):", href, re.I):
                    out.append(label)
                else:
                    self.stats["links"] += 1
                    out.append(f"[{label}]({self._url(href)})")
            else:
                out.append(self._inline(n.children, in_chrome))
        return "".join(out)

    def _url(self, href: str) -> str:
        from urllib.parse import urljoin

        return urljoin(self.base_url, href) if self.base_url else href

    def _image(self, n: Node) -> str:
        src = n.attrs.get("src", "").strip()
        if not self.keep_images or not src:
            return ""
        self.stats["images"] += 1
        return md.image(_spaces(n.attrs.get("alt", "")).strip(), self._url(src), n.attrs.get("title", ""))

    # -- blocks

    def blocks(self, nodes: list[Node | str], in_chrome: bool = False) -> list[str]:
        out: list[str] = []
        run: list[Node | str] = []

        def flush() -> None:
            if run:
                text = self.inline(run, in_chrome)
                if text:
                    out.append(text)
                run.clear()

        for n in nodes:
            # An inline element that was left open may hold blocks: its content is unfolded.
            if isinstance(n, Node) and n.tag in INLINE and any(self._blocky(c) for c in n.walk()):
                flush()
                out.extend(self.blocks(n.children, in_chrome))
            elif isinstance(n, str) or not self._blocky(n):
                run.append(n)
            else:
                flush()
                if not self.skipped(n, in_chrome):
                    out.extend(self.block(n, in_chrome or n.tag in CHROME))
        flush()
        return out

    @staticmethod
    def _blocky(n: Node | str) -> bool:
        if isinstance(n, str):
            return False
        return n.tag not in INLINE and n.tag not in DROPPED or (n.tag == "code" and "\n" in n.text().strip())

    def block(self, n: Node, in_chrome: bool) -> list[str]:
        if n.tag in HEADINGS:
            text = self.inline(n.children, in_chrome)
            self.stats["headings"] += bool(text)
            return [md.heading(HEADINGS[n.tag], text)] if text else []
        if n.tag in ("pre", "code"):
            return self._code(n)
        if n.tag == "hr":
            return ["---"]
        if n.tag in ("ul", "ol", "menu"):
            text = self.list(n, in_chrome)
            return [text] if text else []
        if n.tag == "li":
            return [x for x in [self._items([n], False, in_chrome)] if x]
        if n.tag == "blockquote":
            inner = self.blocks(n.children, in_chrome)
            return [md.blockquote("\n\n".join(inner))] if inner else []
        if n.tag == "table":
            return self._table(n, in_chrome)
        return self.blocks(n.children, in_chrome)

    def _code(self, n: Node) -> list[str]:
        code = n.text().strip("\n")
        if not code.strip():
            return []
        for e in (n, *n.find("code")):
            if e.attrs.get("data-lang"):
                return [md.fence(code, e.attrs["data-lang"])]
        named = (re.search(r"(?:language|lang|brush)[-:]\s*([\w+#]+)", e.attrs.get("class", "")) for e in (n, *n.find("code")))
        lang = next((m[1].lower() for m in named if m), "")
        return [md.fence(code, lang if n.tag == "pre" else "")]

    def list(self, n: Node, in_chrome: bool) -> str:
        items = [c for c in n.children if isinstance(c, Node) and not self.skipped(c, in_chrome)]
        return self._items(items, n.tag == "ol", in_chrome)

    def _items(self, items: list[Node], ordered: bool, in_chrome: bool) -> str:
        lines, number = [], 1
        for item in items:
            if item.tag in ("ul", "ol", "menu"):  # a list right inside a list belongs to the item before
                nested = self.list(item, in_chrome)
                lines += ["  " + x for x in nested.split("\n")] if nested else []
                continue
            blocks = []
            run: list[Node | str] = []
            for c in item.children:
                if isinstance(c, Node) and c.tag in ("ul", "ol", "menu"):
                    blocks += self.blocks(run, in_chrome)
                    run = []
                    blocks.append(self.list(c, in_chrome))
                else:
                    run.append(c)
            blocks += self.blocks(run, in_chrome)
            body = "\n".join(b for b in blocks if b)
            if body:
                first, *rest = body.split("\n")
                lines += [(f"{number}. " if ordered else "- ") + first, *("  " + x if x else x for x in rest)]
                number += 1
        return "\n".join(lines)

    def _table(self, n: Node, in_chrome: bool) -> list[str]:
        rows, header, inner = [], False, []

        def collect(node: Node) -> None:
            nonlocal header
            for c in node.children:
                if not isinstance(c, Node):
                    continue
                if c.tag == "tr":
                    cells = [x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")]
                    header = header or any(x.tag == "th" for x in cells)
                    row = []
                    for x in cells:
                        inner.extend(x.find("table"))
                        flat = [y for y in x.children if not (isinstance(y, Node) and y.tag == "table")]
                        row.append(" ".join(re.sub(" *\n", " ", b) for b in self.blocks(flat, in_chrome)))
                    if any(row):
                        rows.append(row)
                elif c.tag in ("thead", "tbody", "tfoot"):
                    collect(c)

        collect(n)
        out = [md.paragraphs(self.inline(c.children, in_chrome)) for c in n.children if isinstance(c, Node) and c.tag == "caption"]
        if rows:
            self.stats["tables"] += 1
            out.append(md.table(rows) if header else md.table([["(no header)"], *rows]))
        for t in inner:
            out += self._table(t, in_chrome)
        return [x for x in out if x]


def _hold(html: str) -> tuple[str, str]:
    """The text with a sign in place of each ampersand that begins no reference with its semicolon, and that
    sign: one that the text lacks and that no reference stands for."""
    sign = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in html), "\ufdd0")
    return _AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else sign + m[0][1:], html), sign


def html_to_markdown(
    html: str, *, drop_chrome: bool = True, keep_images: bool = True, keep_links: bool = True, base_url: str = "", engine: str = "auto"
) -> tuple[str, dict[str, int], str]:
    """(Markdown, counts, engine). Engines: auto and builtin, which are the same, and strict, which leaves
    references without their semicolon (``&amp``) as they are; the others decode them as browsers do."""
    if engine not in {"builtin", "auto", "strict"}:
        raise ValueError(f"no such HTML engine: {engine}")
    if engine == "strict":
        held, sign = _hold(html)
        body, stats, _ = html_to_markdown(held, drop_chrome=drop_chrome, keep_images=keep_images, keep_links=keep_links, base_url=base_url)
        return body.replace(sign, "&"), stats, engine
    writer = _Writer(keep_links, keep_images, drop_chrome, base_url)
    body = re.sub("\n\n\n+", "\n\n", "\n\n".join(writer.blocks(parse(html).children))).strip()
    return body, writer.stats, "builtin"


def html_title(html: str, *, engine: str = "auto") -> str:
    """The first h1's text, or else the title's. Engines are those of html_to_markdown."""
    if engine == "strict":
        held, sign = _hold(html)
        return html_title(held).replace(sign, "&")
    for tag in ("h1", "title"):
        m = re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}\s*>", html, re.S | re.I)
        text = md.squash(unescape(re.sub("<[^<>]+>", "", m[1]))) if m else ""
        if text:
            return text
    return ""
