"""Pages laid out as text: a tolerant parser builds a tree, a renderer wraps it at 100 columns.

The tree follows what browsers do with the usual faults: end tags that are left out, blocks inside
paragraphs, formatting elements that a block closed and the next text reopens, rows and cells
without their tables' inner parts.  A page that nests deeper than 128 elements, or that builds more
than one element for every four bytes, is not laid out; its tags are stripped instead.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from folio.operators.extract.common import WHITE
from folio.operators.extract.markup import RAW, references

MAX_DEPTH, BYTES_PER_ELEMENT, WIDTH = 128, 4, 100  # fixed values

# Elements by what they do to the tree and to the layout.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("html table td th caption template button object marquee applet".split())
_TABLE_PARTS = {"tr": ("tr", "td", "th", "caption", "colgroup"), "td": ("td", "th", "caption"), "th": ("td", "th", "caption"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup")}
_CELLS = frozenset("table tbody thead tfoot tr td th caption".split())
_UNSEEN = frozenset("head link meta hr script style template iframe noembed noframes title".split())
_LINE_BLOCKS = _CLOSES_P - _HEADINGS - frozenset("p ul ol dl pre blockquote table".split()) | frozenset(("html", "body", "fieldset", "legend", "option", "tr", "caption"))
_MARKS = {"em": "*", "i": "*", "ins": "*", "strong": "**", "b": "**", "code": "`"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Node | str] = field(default_factory=list)


_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
# a tag: quotes count only after '='; possessive, so one that never ends costs one pass
_OPEN = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|["'])*+)>""")
_COMMENT = re.compile(r"--!?>")


class TooDeep(Exception):
    """The page is better stripped than laid out."""


class Builder:
    """Open elements, formatting elements to reopen, and the limits."""

    def __init__(self, size: int) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.active: list[Node] = []
        self.count, self.most = 0, max(64, size // BYTES_PER_ELEMENT)

    def push(self, node: Node) -> None:
        self.count += 1
        if self.count > self.most or len(self.stack) >= MAX_DEPTH:
            raise TooDeep
        self.stack[-1].kids.append(node)
        self.stack.append(node)

    def in_scope(self, names: tuple[str, ...], stop: frozenset[str] = _SCOPE) -> bool:
        for n in reversed(self.stack):
            if n.tag in names:
                return True
            if n.tag in stop:
                return False
        return False

    def pop_through(self, names: tuple[str, ...]) -> None:
        while len(self.stack) > 1 and self.stack.pop().tag not in names:
            pass

    def reopen(self) -> None:
        """Formatting elements that a block has closed go on in what follows."""
        for k, old in enumerate(self.active):
            if not any(n is old for n in self.stack):
                new = Node(old.tag, old.attrs)
                self.active[k] = new
                self.push(new)

    def text(self, raw: str) -> None:
        if not raw:
            return
        if raw.strip(WHITE) and self.stack[-1].tag not in ("table", "tbody", "thead", "tfoot", "tr"):
            self.reopen()
        self.stack[-1].kids.append(references(raw))

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body", "head") and (tag != "head" or any(n.tag == "body" for n in self.stack)):
            if tag == "body":
                self.pop_through(("head",)) if self.in_scope(("head",)) else None
            return
        if tag in _CLOSES_P and self.in_scope(("p",)):
            self.pop_through(("p",))
        if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
            self.stack.pop()
        if tag == "li" and self.in_scope(("li",), _SCOPE | {"ul", "ol"}):
            self.pop_through(("li",))
        if tag in ("dd", "dt") and self.in_scope(("dd", "dt"), _SCOPE | {"dl"}):
            self.pop_through(("dd", "dt"))
        if tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self.stack.pop()
        if tag in _TABLE_PARTS:
            while self.in_scope(_TABLE_PARTS[tag], frozenset(("table", "html"))):
                self.pop_through(_TABLE_PARTS[tag])
        if tag in ("a", "nobr") and (old := next((n for n in self.active if n.tag == tag), None)):
            self.active = [n for n in self.active if n is not old]
            if any(n is old for n in self.stack):
                self.end(tag)
        if tag not in _CLOSES_P and tag not in _TABLE_PARTS and tag not in ("li", "dd", "dt", "option", "col", "colgroup", "caption"):
            self.reopen()
        node = Node(tag, attrs)
        self.push(node)
        if tag in _VOID:
            self.stack.pop()
        elif tag in _FORMATTING:
            same = [n for n in self.active if n.tag == tag and n.attrs == attrs]
            if len(same) >= 3:  # as many alike are kept, no more
                self.active = [n for n in self.active if n is not same[0]]
            self.active.append(node)
        elif tag in ("td", "th", "caption"):
            self.active = []  # formatting does not reach into cells

    def end(self, tag: str) -> None:
        if tag in ("html", "body") or tag in _VOID:
            return
        if tag == "p" and not self.in_scope(("p",)):
            self.start("p", {})
        names = tuple(_HEADINGS) if tag in _HEADINGS else (tag,)
        if tag in _FORMATTING:
            self.active = self._without_last(tag)
            # a block opened inside stays open: the formatting element ends, what it holds goes on
            at = next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].tag == tag), 0)
            if not at or any(n.tag in _SCOPE for n in self.stack[at + 1 :]):
                return
            inner = [n for n in self.stack[at + 1 :] if n.tag in _CLOSES_P or n.tag in ("li", "dd", "dt")]
            if inner:
                return
            del self.stack[at:]
            return
        stop = frozenset(("html", "table", "template")) if tag in _CELLS else _SCOPE
        if self.in_scope(names, stop - set(names)):
            self.pop_through(names)

    def _without_last(self, tag: str) -> list[Node]:
        at = next((k for k in range(len(self.active) - 1, -1, -1) if self.active[k].tag == tag), None)
        return [n for k, n in enumerate(self.active) if k != at]


def parse(page: str) -> Node:
    """The tree of a page; raises ``TooDeep``."""
    b = Builder(len(page.encode("utf-8", "replace")))
    low = page.lower() if len(page.lower()) == len(page) else page.translate({c: c + 32 for c in range(65, 91)})
    at = mark = 0
    while (lt := page.find("<", at)) >= 0:
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            b.text(page[mark:lt])
            if page.startswith((">", "->"), lt + 4):
                at = mark = page.index(">", lt) + 1
                continue
            end = _COMMENT.search(page, lt + 4)
            at = mark = end.end() if end else len(page)
            continue
        if page.startswith("<![CDATA[", lt) and any(n.tag in ("svg", "math") for n in b.stack):
            b.text(page[mark:lt])
            end_at = page.find("]]>", lt)
            inner = page[lt + 9 : end_at if end_at >= 0 else len(page)]
            b.stack[-1].kids.append(inner)
            at = mark = end_at + 3 if end_at >= 0 else len(page)
            continue
        if nxt in ("!", "?") or (nxt == "/" and page[lt + 2 : lt + 3] and not page[lt + 2 : lt + 3].isalpha()):
            b.text(page[mark:lt])
            end_at = page.find(">", lt)
            at = mark = end_at + 1 if end_at >= 0 else len(page)
            continue
        if not (nxt.isascii() and nxt.isalpha()) and nxt != "/":
            at = lt + 1
            continue
        m = _OPEN.match(page, lt)
        b.text(page[mark:lt])
        if not m:
            at = mark = len(page)
            break
        tag = m[2].lower()
        at = mark = m.end()
        if m[1]:
            b.end(tag)
            continue
        body = m[3].rstrip()
        attrs = {x[1].lower(): references(x[2] or x[3] or x[4] or "") for x in reversed(list(_ATTRIBUTE.finditer(body)))} if body else {}
        foreign = any(n.tag in ("svg", "math") for n in b.stack)
        b.start(tag, attrs)
        if tag == "plaintext":
            b.text(page[at:])
            at = mark = len(page)
        elif tag in RAW and not foreign:
            end_at = _raw_end(low, tag, at)
            inner = page[at:end_at]
            if b.stack[-1].tag == tag:
                b.stack[-1].kids.append(references(inner) if tag in ("title", "textarea") else inner)
            at = mark = end_at
        elif foreign and body.endswith("/") and b.stack[-1].tag == tag:
            b.stack.pop()
    b.text(page[mark:])
    return b.root


def _raw_end(low: str, name: str, at: int) -> int:
    """Where the raw text of an element ends; a script inside a comment may open and close one more."""
    needle = "</" + name
    if name != "script":
        k = low.find(needle, at)
        while k >= 0 and low[k + len(needle) : k + len(needle) + 1] not in ("", ">", "/", " ", "\t", "\n", "\r", "\x0c"):
            k = low.find(needle, k + 1)
        return k if k >= 0 else len(low)
    escaped = double = False
    for m in re.compile(r"<!--|-->|<(/?)script(?=[\s/>])").finditer(low, at):
        if m[0] == "<!--":
            escaped = True
        elif m[0] == "-->":
            escaped = double = False
        elif m[1]:
            if not double:
                return m.start()
            double = False
        elif escaped:
            double = True
    return len(low)


def width_of(text: str) -> int:
    """Columns of a text on a terminal."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines under construction: words wrapped at a width, blocks a blank line apart."""

    def __init__(self, width: int) -> None:
        self.width, self.lines, self.line, self.used = max(1, width), [], "", 0
        self.word, self.space, self.ended = "", False, False

    def text(self, raw: str) -> None:
        for k, part in enumerate(re.split(f"[{WHITE}]+", raw)):
            if k:
                self._word()
                self.space = True
            if part:
                self.glue(part)

    def glue(self, part: str) -> None:
        if self.ended:
            self.block()
        self.word += part

    def _word(self) -> None:
        if not self.word:
            return
        n = width_of(self.word)
        if self.line and self.space and self.used + 1 + n <= self.width:
            self.line, self.used = f"{self.line} {self.word}", self.used + 1 + n
        elif self.line and not self.space and self.used + n <= self.width:
            self.line, self.used = self.line + self.word, self.used + n
        else:
            self.flush()
            while width_of(self.word) > self.width:  # a word longer than a line is cut
                k = n = 0
                while k < len(self.word) and n + width_of(self.word[k]) <= self.width:
                    n += width_of(self.word[k])
                    k += 1
                k = max(1, k)
                self.lines.append(self.word[:k])
                self.word = self.word[k:]
            self.line, self.used = self.word, width_of(self.word)
        self.word, self.space = "", False

    def flush(self) -> None:
        if self.line:
            self.lines.append(self.line)
        self.line, self.used = "", 0

    def newline(self) -> None:
        self._word()
        self.flush()
        self.space = False

    def hard_break(self) -> None:
        if self.ended:
            self.block()
        self._word()
        self.lines.append(self.line)
        self.line, self.used, self.space = "", 0, False

    def block(self) -> None:
        """Before a block: on a line of its own, a blank one before it."""
        self.newline()
        if self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.ended = False

    def end(self) -> None:
        self.newline()
        self.ended = True

    def take(self, lines: list[str], first: str = "", rest: str = "") -> None:
        self.newline()
        self.lines += [(rest if k else first) + x for k, x in enumerate(lines)]


class Page:
    """Draws a tree; links become numbers whose targets stand at the end."""

    def __init__(self) -> None:
        self.links: list[str] = []

    def inner(self, node: Node, width: int) -> list[str]:
        flow = Flow(width)
        self.kids(node, flow)
        flow.newline()
        while flow.lines and flow.lines[-1] == "":
            flow.lines.pop()
        return flow.lines

    def kids(self, node: Node, flow: Flow) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                flow.text(kid)
            else:
                self.draw(kid, flow)

    def draw(self, node: Node, flow: Flow) -> None:
        tag = node.tag
        if tag in _UNSEEN:
            return
        if tag == "br":
            flow.hard_break()
        elif tag == "img":
            if node.attrs.get("alt", "").strip():
                flow.text(f"[{node.attrs['alt']}]")
        elif tag == "a" and "href" in node.attrs:
            flow.glue("[")
            self.kids(node, flow)
            self.links.append(node.attrs["href"])
            flow.glue(f"][{len(self.links)}]")
        elif tag in _MARKS:
            flow.glue(_MARKS[tag])
            self.kids(node, flow)
            flow.glue(_MARKS[tag])
        elif tag == "p":
            flow.block()
            self.kids(node, flow)
            flow.end()
        elif tag in _HEADINGS:
            self.prefixed(node, flow, "#" * int(tag[1]) + " ")
        elif tag == "blockquote":
            self.prefixed(node, flow, "> ")
        elif tag in ("ul", "menu", "dir"):
            self.items(node, flow, None)
        elif tag == "ol":
            first = node.attrs.get("start", "")
            self.items(node, flow, int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1)
        elif tag == "dl":
            self.terms(node, flow)
        elif tag in ("pre", "listing", "textarea"):
            flow.block()
            flow.take([x.expandtabs(8) for x in _plain(node).strip("\n").split("\n")])
            flow.end()
        elif tag == "table":
            flow.block()
            flow.take(self.table(node, flow.width))
            flow.end()
        elif tag in _LINE_BLOCKS or tag == "li":
            flow.newline()
            self.kids(node, flow)
            flow.newline()
        else:
            self.kids(node, flow)

    def prefixed(self, node: Node, flow: Flow, mark: str) -> None:
        flow.block()
        flow.take(self.inner(node, flow.width - len(mark)), mark, mark)
        flow.end()

    def items(self, node: Node, flow: Flow, number: int | None) -> None:
        items = [k for k in node.kids if isinstance(k, Node) and k.tag == "li"]
        loose = [k for k in node.kids if not (isinstance(k, Node) and k.tag == "li") and (isinstance(k, Node) or k.strip(WHITE))]
        marks = ["* "] * len(items) if number is None else [f"{number + k}. " for k in range(len(items))]
        wide = max(map(len, marks), default=2)
        flow.block()
        for mark, item in zip(marks, items):
            flow.take(self.inner(item, flow.width - wide) or [""], mark.ljust(wide), " " * wide)
        if loose:
            flow.take(self.inner(Node("div", {}, loose), flow.width))
        flow.end()

    def terms(self, node: Node, flow: Flow) -> None:
        flow.block()
        todo = list(node.kids)
        while todo:
            k = todo.pop(0)
            if isinstance(k, str):
                continue
            if k.tag == "dt":
                flow.take([f"*{x}*" for x in self.inner(k, flow.width - 2)])
            elif k.tag == "dd":
                flow.take(self.inner(k, flow.width - 2), "  ", "  ")
            else:  # groups of terms
                todo = [*k.kids, *todo]
        flow.end()

    def table(self, node: Node, width: int) -> list[str]:
        rows: list[list[Node]] = []
        above: list[str] = []
        todo: list[Node | str] = list(node.kids)
        while todo:
            k = todo.pop(0)
            if isinstance(k, str):
                if k.strip(WHITE):
                    above.append(" ".join(k.split()))
            elif k.tag == "tr":
                rows.append([c for c in k.kids if isinstance(c, Node) and c.tag in ("td", "th")])
            elif k.tag in ("tbody", "thead", "tfoot"):
                todo = [*k.kids, *todo]
            elif k.tag in ("td", "th"):
                rows.append([k])
            elif k.tag == "caption":
                above += self.inner(k, width)
        rows = [r for r in rows if r]
        n = max((sum(_span(c) for c in r) for r in rows), default=0)
        if not n:
            return above
        want = [1] * n
        least = [1] * n
        for r in rows:
            at = 0
            for c in r:
                words = _plain(c).split()
                if _span(c) == 1:
                    want[at] = max(want[at], max((width_of(x) for x in Page().inner(c, 10_000)), default=1))
                    least[at] = max(least[at], max(map(width_of, words), default=1))
                at += _span(c)
        for r in rows:  # a cell over several columns widens the last of them
            at = 0
            for c in r:
                k = _span(c)
                if k > 1:
                    need = max((width_of(x) for x in Page().inner(c, 10_000)), default=1)
                    want[at + k - 1] += max(0, need - sum(want[at : at + k]) - k + 1)
                at += k
        room = width - (n - 1)
        if sum(min(x, 12) for x in least) > room or n > width // 3:
            return above + self.stacked(rows, width)
        sizes = want if sum(want) <= room else _shrunk(want, [min(x, 12) for x in least], room)
        drawn = []
        for r in rows:
            at, cells, cuts = 0, [], set()
            for c in r:
                wide = sum(sizes[at : at + _span(c)]) + _span(c) - 1
                cells.append((wide, self.inner(c, wide)))
                at += _span(c)
                cuts.add(sum(sizes[:at]) + at - 1)
            if at < n:
                cells.append((sum(sizes[at:]) + n - at - 1, []))
            drawn.append((cells, cuts))
        full = sum(sizes) + n - 1
        out = list(above)
        last: set[int] = set()
        for cells, cuts in [*drawn, ([], set())]:
            cuts = {c for c in cuts if c < full}
            out.append("".join("┼" if k in last and k in cuts else "┬" if k in cuts else "┴" if k in last else "─" for k in range(full)))
            for k in range(max((len(x) for _, x in cells), default=0)):
                out.append("│".join((x[k] if k < len(x) else "") + " " * (wide - width_of(x[k] if k < len(x) else "")) for wide, x in cells).rstrip())
            last = cuts
        return out

    def stacked(self, rows: list[list[Node]], width: int) -> list[str]:
        """Cells one below the other, where a table is too wide."""
        out = ["─" * width]
        for r in rows:
            for k, c in enumerate(r):
                if k:
                    out.append("/" * width)
                out += self.inner(c, width)
            out.append("─" * width)
        return out


def _span(cell: Node) -> int:
    raw = cell.attrs.get("colspan", "1")
    return max(1, min(1000, int(raw))) if re.fullmatch(r"\d{1,4}", raw) else 1


def _shrunk(want: list[int], least: list[int], room: int) -> list[int]:
    """Widths that add up to the room: narrow columns keep theirs, wide ones share what is left."""
    sizes = list(least)
    left = room - sum(sizes)
    order = sorted(range(len(want)), key=lambda k: want[k] - least[k])
    for i, k in enumerate(order):
        extra = min(want[k] - sizes[k], max(0, left) // (len(order) - i))
        sizes[k] += extra
        left -= extra
    return sizes


def _plain(node: Node) -> str:
    out = []
    for kid in node.kids:
        if isinstance(kid, str):
            out.append(kid)
        elif kid.tag == "br":
            out.append("\n")
        elif kid.tag not in _UNSEEN:
            out.append(_plain(kid))
    return "".join(out)


def render(page: str, width: int = WIDTH) -> str:
    """A page laid out; raises ``TooDeep`` if it should be stripped."""
    drawing = Page()
    lines = drawing.inner(parse(page), width)
    if drawing.links:
        lines += ["", *(f"[{k}]: {u}" for k, u in enumerate(drawing.links, 1))]
    text = "\n".join(x.rstrip() for x in lines)
    return text.lstrip("\n") + "\n" if text.strip() else ""
