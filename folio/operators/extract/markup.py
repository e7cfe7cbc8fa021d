"""HTML and XML to text in one pass each."""

from __future__ import annotations

import re
from html.entities import name2codepoint
from xml.parsers import expat

from folio.operators.extract.common import WHITE, decode, lines

# Elements that stand apart, that start a line, and whose content is raw text.
BLOCKS = frozenset("address article aside blockquote br caption center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul".split())
LINES = frozenset("dd dt li option tr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea plaintext".split())
SHOWN_RAW = ("title", "textarea", "plaintext")
_ENTITIES = {**{k: chr(v) for k, v in name2codepoint.items()}, "apos": "'", "nbsp": " "}
_REFERENCE = re.compile(r"&(?:#([0-9]{1,31})|#[xX]([0-9a-fA-F]{1,30})|([A-Za-z][A-Za-z0-9]{0,31}));")
# a tag: quotes count only after '='
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|(?!["'])))*)>""", re.S)
_COMMENT_END = re.compile(r"--!?>")
_SPACES = re.compile(f"[{WHITE}]+")


def _character(code: int) -> str:
    if 0x80 <= code <= 0x9F:  # as browsers read them
        byte = bytes([code])
        try:
            return byte.decode("cp1252")
        except UnicodeDecodeError:
            return chr(code)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def references(text: str) -> str:
    """Numeric and HTML 4 character references; a name needs its ';', others stay as they are."""

    def one(m: re.Match[str]) -> str:
        if m[3]:
            return _ENTITIES.get(m[3], m[0])
        return _character(min(int(m[1]) if m[1] else int(m[2], 16), 0x110000))

    return _REFERENCE.sub(one, text) if "&" in text else text


def collapse_blank_lines(text: str) -> str:
    out: list[str] = []
    for line in lines(text):
        line = line.strip(WHITE)
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).rstrip(WHITE)


def strip_tags(page: str) -> str:
    """Readable text of a page: tags, scripts, styles and comments dropped, blocks apart, list
    items and rows on lines, cells joined by ' | ', references decoded, blank lines collapsed."""
    out: list[str] = []  # never holds an empty string
    low = page.lower() if len(page.lower()) == len(page) else page.translate({c: c + 32 for c in range(65, 91)})

    def text(raw: str) -> None:
        if not raw:
            return
        if "&" not in raw:  # nothing decodes to a blank: fold the whole run at once
            flat = _SPACES.sub(" ", raw)
            if flat[0] == " " and (not out or out[-1][-1] in " \n"):
                flat = flat[1:]
            if flat:
                out.append(flat)
            return
        pos = 0
        for m in _SPACES.finditer(raw):
            if m.start() > pos:
                out.append(references(raw[pos : m.start()]))
            if out and out[-1][-1] not in " \n":
                out.append(" ")
            pos = m.end()
        if pos < len(raw):
            out.append(references(raw[pos:]))

    def broke(name: str) -> None:
        if name in BLOCKS or (name in LINES and out and out[-1][-1] != "\n"):
            out.append("\n")

    at = mark = 0
    while (lt := page.find("<", at)) >= 0:
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            text(page[mark:lt])
            if page.startswith((">", "->"), lt + 4):
                at = mark = page.index(">", lt) + 1
                continue
            end = _COMMENT_END.search(page, lt + 4)
            at = mark = end.end() if end else len(page)
            continue
        if nxt in ("!", "?") or (nxt == "/" and not page[lt + 2 : lt + 3].isalpha() and page[lt + 2 : lt + 3] != ""):
            text(page[mark:lt])
            end_at = page.find(">", lt)
            at = mark = end_at + 1 if end_at >= 0 else len(page)
            continue
        if not (nxt.isascii() and nxt.isalpha()) and nxt != "/":
            at = lt + 1
            continue
        m = _TAG.match(page, lt)
        text(page[mark:lt])
        if not m:  # an open tag at the end of the page
            at = mark = len(page)
            break
        name = m[2].lower()
        at = mark = m.end()
        broke(name)
        if m[1]:
            continue
        if name in ("td", "th"):
            while out and out[-1] == " ":
                out.pop()
            if out and out[-1][-1] != "\n":
                out.append(" | ")
        if name in RAW:
            end_at = len(page) if name == "plaintext" else _raw_end(low, name, at)
            if name in SHOWN_RAW:
                text(page[at:end_at])
                out.append("\n")
            at = mark = end_at
    text(page[mark:])
    return collapse_blank_lines("".join(out))


def _raw_end(low: str, name: str, at: int) -> int:
    needle = "</" + name
    while (k := low.find(needle, at)) >= 0:
        if low[k + len(needle) : k + len(needle) + 1] in ("", ">", "/", " ", "\t", "\n", "\r", "\x0c"):
            return k
        at = k + 1
    return len(low)


def html_text(data: bytes) -> str:
    """A page laid out as text; its tags stripped where it nests too deep for that."""
    from folio.operators.extract import page as layout

    source = decode(data)
    try:
        return layout.render(source)
    except (layout.TooDeep, RecursionError):
        return strip_tags(source)


_XML_BREAKS = frozenset("p para div br tr li h1 h2 h3 h4 h5 h6".split())


def xml_text(data: bytes) -> str:
    """Character data with a line break before block elements; source if it is malformed."""
    source = decode(data)
    out: list[str] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name: str, _attrs: dict[str, str]) -> None:
        if name.rsplit(":", 1)[-1].lower() in _XML_BREAKS:
            out.append("\n")

    parser.StartElementHandler = start
    parser.CharacterDataHandler = out.append
    try:
        parser.Parse(re.sub(r"^(\s*<\?xml[^>]*?)\s+encoding\s*=\s*(?:\"[^\"]*\"|'[^']*')", r"\1", source).encode("utf-8"), True)
    except expat.ExpatError:
        return source
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip(WHITE)


def page_title(page: str) -> str | None:
    """The first title, one line, at most 60 characters cut at a word with '...'."""
    m = re.search(r"<title\b[^>]*>([^<]{0,1024})", page[: 64 << 10], re.I)
    if not m:
        return None
    words = [w for w in _SPACES.split(references(m[1])) if w]
    title = "".join(c for c in " ".join(words) if c >= " " and c != "\x7f")
    if len(title) > 60:
        cut = title[:57]
        title = (cut.rsplit(" ", 1)[0] if " " in cut else cut).rstrip() + "..."
    return title or None
