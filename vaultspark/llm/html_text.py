"""HTML extraction: a small tree builder with implied tags, visibility rules, and a renderer that lays the visible text out.

Builder: void elements, raw-text elements, and implied end tags (a new li ends the open li, a block ends an open p, and so on). Visibility:
elements that browsers never show, the `hidden` attribute, inline styles, `details` and `dialog` that are not open, and style
sheets' rules of one tag, .classes and #ids (no combinators) on display and visibility, by importance, layer, specificity and order, as far as they hold on any
screen: at-rules and sheets under a further condition, for other media or without scripts are left out. Of svg the text elements and foreignObject are shown, not what
is drawn by reference only; of math all but annotations. Layout: white
space collapses except in pre; paragraphs, headings, lists, tables and such are set off by a blank line; list items carry "- " or their number
and are indented by depth; a table's cells are padded to the width of their column and joined by " | ", and columns in which no cell begins have no room.

Defined results: null and empty html give empty text; ill-formed markup is read as far as it goes, never refused; a tag that the page ends in is not there, as in
browsers. Repeated rows are each rendered. An empty table gives an empty result. Columns other than those named are not read.

Time and output are in proportion to the page, however ill-formed or deep: no token is read twice, the open elements are found by name, and nothing recurses with the
depth of the tree. What would make output grow with the square of the page ends: indents at INDENT columns; alignment at TABLES tables within one
another, and the cells of tables below that follow one another as blocks; and a cell of several rows reaches down beside at most REACHING others. No text is lost by this.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

TABLES, INDENT, REACHING = 24, 80, 100

# Element names of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe noembed noframes datalist object audio video canvas param source track area base".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption hr xmp foreignobject".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre xmp table figure fieldset hr".split())
#: A start tag of these ends an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt xmp".split())
#: Within svg and math: never shown; where HTML starts again; start tags that end all of it.
UNSEEN_FOREIGN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split())
HTML_WITHIN = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: The most columns of a cell, by that standard.
SPAN = 1000
#: tag: (the open elements that its start ends, where the search for them stops)
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ()),
}

# a quote delimits a value only where it directly follows "="
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?+)*+)>|[^<]+|<", re.S)
_BEGINS = re.compile(r"/?[a-zA-Z]")
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->|(\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|url\(\s*[^\"'\s)][^)]*\)?)|(\\.|[^{};\"'/\\u<-]+)|.", re.S | re.I)
_SELECTOR = re.compile(r"([A-Za-z_][\w-]*)?((?:[.#][A-Za-z_-][\w-]*)*)")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_FLAT = re.compile(r"[^\t\n\r\f]*+").fullmatch


class Node:
    """foreign: of svg or math. draws: text directly within is shown."""

    __slots__ = ("tag", "attrs", "kids", "foreign", "draws")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False, draws: bool = True):
        self.tag, self.attrs, self.kids, self.foreign, self.draws = tag, attrs, [], foreign, draws


class _Open:
    """The open elements, the innermost last, and where those of each name are among them."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: tuple[str, ...]) -> int:
        """Of the innermost of these names; 0 if there is none."""
        return max((a[-1] for t in tags if (a := self.at.get(t))), default=0)

    def cut(self, k: int) -> None:
        """Closes the k-th and all within."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()

    def end(self, tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Closes the innermost of tags, unless one of bounds lies within it."""
        k = self.last(tags)
        if k > self.last(bounds):
            self.cut(k)

    def close(self, name: str) -> None:
        if name == "br":
            self.nodes[-1].kids.append(Node("br", {}))
        elif k := self.last((name,)):
            # an inline end tag does not reach out of a cell
            if name in BLOCKS or k >= self.last(("td", "th", "table")):
                self.cut(k)


@dataclass(frozen=True)
class Rule:
    """What a selector says of display and visibility: property -> (rank, value), the greater rank before the lesser."""

    tag: str | None
    marks: frozenset[str]
    said: dict[str, tuple[tuple, str]]


def parse(source: str) -> tuple[Node, dict[str, list[Rule]]]:
    """The tree, and the style sheets' rules by one .class, #id or tag of each."""
    root = Node("#root", {})
    stack, sheet = _Open(root), []
    pos, n = 0, len(source)
    while pos < n:
        up = stack.nodes[-1]
        if up.foreign and source.startswith("<![CDATA[", pos):
            end = source.find("]]>", pos)
            if up.draws:
                up.kids.append(source[pos + 9 : end if end >= 0 else n])
            pos = end + 3 if end >= 0 else n
            continue
        m = _TOKEN.match(source, pos)
        pos = m.end()
        name = m[2]
        if name is None:
            if m[0] == "<" and _BEGINS.match(source, pos):
                break  # a tag that the page ends in
            if (m[0][0] != "<" or m[0] == "<") and up.draws:
                up.kids.append(html.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        name = name.lower()
        if m[1]:
            stack.close(name)
            continue
        attrs = {a.lower(): html.unescape(b or c or d) for a, b, c, d in _ATTR.findall(m[3])} if m[3] else {}
        if name in BREAKOUT:
            while stack.nodes[-1].foreign and stack.nodes[-1].tag not in HTML_WITHIN:
                stack.cut(len(stack.nodes) - 1)
        if name in ENDS_P:
            stack.end(("p",), ("td", "th", "li", "table", "button", "caption"))
        if name in IMPLIED:
            stack.end(*IMPLIED[name])
        up = stack.nodes[-1]
        foreign = name in ("svg", "math") or up.foreign and up.tag not in HTML_WITHIN
        node = Node(name, attrs, foreign, name != "svg" and (up.draws or foreign and name in ("text", "foreignobject", "math")))
        up.kids.append(node)
        if foreign and m[3].endswith("/") and [a.end() for a in _ATTR.finditer(m[3])][-1:] != [len(m[3])]:
            continue
        if name in RAW and (not foreign or name in ("script", "style", "title")):
            end = re.compile(rf"</{name}\b", re.I).search(source, pos)
            inner = source[pos : end.start() if end else n]
            shut = source.find(">", end.end()) if end else -1
            pos = shut + 1 if shut >= 0 else n
            if name == "style":
                kind = attrs.get("type", "").strip().lower()
                if kind in ("", "text/css") and _on_screen(attrs.get("media", "")) and not stack.last(("noscript", "template")):
                    sheet.append(inner.replace("<![CDATA[", "").replace("]]>", "") if foreign else inner)
            elif name == "textarea":
                node.kids.append(html.unescape(inner))
            elif name == "xmp":
                node.kids.append(inner)
        elif foreign or name not in VOID:
            stack.push(node)
    return root, _rules(sheet)


def _on_screen(media: str) -> bool:
    """Whether a list of media queries holds on every screen."""
    return not media.strip() or any(" ".join(q.lower().split()) in ("all", "screen", "only all", "only screen") for q in media.split(","))


_UNLAYERED, _INLINE = 1 << 30, 1 << 31


def _rules(sheets: list[str]) -> dict[str, list[Rule]]:
    found: dict[tuple, dict[str, tuple[tuple, str]]] = {}
    layers: dict[tuple[int, str], int] = {}
    order = 0

    def note(selectors: str, body: str, layer: int) -> None:
        nonlocal order
        order += 1
        said = _style(body)
        if not said:
            return
        for s in _without_brackets(selectors).split(","):  # commas within brackets part no selectors
            m = _SELECTOR.fullmatch(s.strip())
            if m and m[0]:
                marks = re.findall(r"[.#][^.#]+", m[2])
                ids = sum(k[0] == "#" for k in marks)
                spec = (ids, len(marks) - ids, bool(m[1]))
                ranked = {p: ((strong, -layer if strong else layer, spec, order, at), v) for p, (strong, at, v) in said.items()}
                held = found.setdefault((m[1] and m[1].lower(), frozenset(marks)), {})
                held |= {p: v for p, v in ranked.items() if p not in held or v[0] > held[p][0]}

    for css in sheets:
        # what is open: (selectors or None, whether it holds, layer)
        stack: list[tuple[str | None, bool, int, int]] = [(None, True, _UNLAYERED, -1)]
        held: list[str] = []
        for m in _CSS.finditer(css):
            part = m[0]
            if part not in ("{", "}", ";"):
                if not part.startswith(("/*", "<!--", "-->")):
                    held.append('""' if m[1] else part)
                elif part.startswith("/*"):
                    held.append(" ")
                continue
            text, held = "".join(held).strip(), []
            selectors, holds, layer, path = stack[-1]
            if part == "{":
                if text.startswith("@"):
                    at, _, rest = text[1:].partition(" ") if re.match(r"@[\w-]+\s", text) else (re.match(r"@([\w-]*)", text)[1], "", re.sub(r"^@[\w-]*", "", text))
                    at = at.strip().lower()
                    if at == "layer":
                        layer = path = layers.setdefault((path, rest.strip() or str(len(layers))), len(layers))
                    stack.append((selectors, holds and (at == "layer" or at == "media" and _on_screen(rest)), layer, path))
                else:
                    stack.append((text, holds and selectors is None, layer, path))
                continue
            if selectors is not None and holds and text:
                note(selectors, text, layer)
            elif part == ";" and selectors is None and text.lower().startswith("@layer"):
                for one in text[6:].split(","):
                    layers.setdefault((path, one.strip()), len(layers))
            if part == "}" and len(stack) > 1:
                stack.pop()
        if stack[-1][0] is not None and stack[-1][1] and held:
            note(stack[-1][0], "".join(held), stack[-1][2])
    out: dict[str, list[Rule]] = {}
    for (tag, marks), said in found.items():
        out.setdefault(min(marks) if marks else tag, []).append(Rule(tag, marks, said))
    return out


def _without_brackets(selectors: str) -> str:
    """What stands in brackets gives way to a character that no selector has."""
    out, depth = [], 0
    for part in re.split(r"([()\[\]])", selectors):
        if part in ("(", "["):
            depth += 1
        elif part in (")", "]"):
            depth = max(0, depth - 1)
            out.append("\0")
        elif not depth:
            out.append(part)
    return "".join(out) + "\0" * bool(depth)


def _style(body: str) -> dict[str, tuple[bool, int, str]]:
    """Of display and visibility: property -> (important, place, value), as far as something is said."""
    out: dict[str, tuple[bool, int, str]] = {}
    for at, part in enumerate(body.split(";")):
        k, _, v = part.partition(":")
        k, v = k.strip().lower(), v.strip().lower()
        strong = re.search(r"!\s*important$", v)
        v = v[: strong.start()].strip() if strong else v
        if k == "display" and v or k == "visibility" and v in ("visible", "hidden", "collapse", "inherit", "initial", "unset", "revert", "revert-layer"):
            out[k] = max(out.get(k, (False, -1, "")), (bool(strong), at, v))
    return out


def _visible(node: Node, hidden: bool, css: dict[str, list[Rule]], parent: Node) -> tuple[bool, bool]:
    """(displayed, hidden) of an element under one that is hidden or not."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or node.tag == "input" or node.tag == "dialog" and "open" not in a or node.foreign and node.tag in UNSEEN_FOREIGN:
        return False, hidden
    if parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary":
        return False, hidden
    best: dict[str, tuple[tuple, str]] = {}
    if node.foreign and ("display" in a or "visibility" in a):
        best = {p: ((False, -1), v) for p, (_, _, v) in _style(f"display:{a.get('display', '')};visibility:{a.get('visibility', '')}").items()}
    if css:
        marks = {"." + c for c in a.get("class", "").split()}
        if "id" in a:
            marks.add("#" + a["id"])
        for s in (node.tag, *marks):
            for rule in css.get(s, ()):
                if (rule.tag is None or rule.tag == node.tag) and rule.marks <= marks:
                    for p, said in rule.said.items():
                        if p not in best or said[0] > best[p][0]:
                            best[p] = said
    if "style" in a:
        for p, (strong, at, v) in _style(a["style"]).items():
            if p not in best or (strong, _INLINE) > best[p][0][:2]:
                best[p] = ((strong, _INLINE, at), v)
    if not best:
        return True, hidden
    seen = best["visibility"][1] if "visibility" in best else "inherit"
    hidden = seen in ("hidden", "collapse") or hidden and seen not in ("visible", "initial")
    return "display" not in best or best["display"][1] != "none", hidden


class _Page:
    """Lines with pending breaks, indents and list marks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.breaks, self.space, self.mark = 0, False, ""
        self.indent = 0

    def end(self, breaks: int) -> None:
        self.breaks = max(self.breaks, breaks)
        self.space = False

    def put(self, text: str) -> None:
        if self.breaks and (self.line or self.lines):
            self.flush()
            if self.breaks > 1 and self.lines and self.lines[-1] != "":
                self.lines.append("")
        self.breaks = 0
        if not self.line:
            self.line.append(" " * (min(self.indent, INDENT) - len(self.mark)) + self.mark)
            self.mark = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []

    def text(self) -> str:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _layout(top: Node, css: dict[str, list[Rule]], hidden: bool, depth: int) -> str:
    page = _Page()
    # (node, parent, hidden, pre, list counter) to enter, or a function to call on leaving
    todo: list = [(k, top, hidden, False, None) for k in reversed(top.kids)]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, parent, hidden, pre, count = item
        if isinstance(node, str):
            if hidden or parent.tag == "details" and "open" not in parent.attrs:
                continue
            if pre:
                for k, part in enumerate(node.split("\n")):
                    if k:
                        if page.line and not page.breaks:
                            page.flush()
                        elif not page.breaks:
                            page.lines.append("")
                    if part:
                        page.put(part)
                continue
            words = _SPACE.sub(" ", node) if "  " in node or not _FLAT(node) else node
            core = words.strip(" ")
            if core:
                page.space = page.space or words[0] == " "
                page.put(core)
            if words and words[-1] == " ":
                page.space = bool(page.line) and not page.breaks
            continue
        shown, hidden = _visible(node, hidden, css, parent)
        if not shown:
            continue
        tag = node.tag
        if tag == "br":
            if not hidden:
                if page.line and not page.breaks:
                    page.flush()
                elif not page.breaks and page.lines and page.lines[-1]:
                    page.lines.append("")
                page.space = False
            continue
        if tag == "table" and depth < TABLES:
            rows = _table(node, css, hidden, depth)
            if rows:
                page.end(2)
                for k, r in enumerate(rows):
                    if k:
                        page.end(1)
                    page.put(r)
                page.end(2)
            continue
        if tag == "wbr" or tag == "img":
            continue
        gap = 0
        if tag in BLOCKS:
            nested = tag in ("ul", "ol", "menu", "dir") and count is not None
            gap = 2 if tag in SPACED and not nested else 1
            page.end(gap)
        inner = count if tag not in BLOCKS or tag == "li" else None
        lead = 0
        if tag in ("ul", "ol", "menu", "dir"):
            first = node.attrs.get("start", "1")
            inner = [int(first) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", first) else 1, tag == "ol"]
        elif tag == "li":
            number, ordered = count or [0, False]
            if ordered and re.fullmatch(r"-?\d{1,9}", node.attrs.get("value", "")):
                number = int(node.attrs["value"])
            mark = f"{number}. " if ordered else "- "
            if count:
                count[0] = number + 1
            page.mark, lead = "" if hidden else mark, len(mark)
            inner = [1, False]
        elif tag in ("blockquote", "dd"):
            lead = 2
        if lead:
            page.indent += lead

        def leave(gap=gap, lead=lead, li=tag == "li"):
            if gap:
                page.end(gap)
            if lead:
                page.indent -= lead
            if li:
                page.mark = ""

        if gap or lead:
            todo.append(leave)
        elif node.foreign and tag in ("text", "math") and not hidden:
            # set off by a space, as what is placed apart
            page.space = bool(page.line) and not page.breaks
            todo.append(lambda: setattr(page, "space", bool(page.line) and not page.breaks))
        todo += [(k, node, hidden, pre or tag in ("pre", "textarea", "xmp"), inner) for k in reversed(node.kids)]
    return page.text()


def _table(table: Node, css: dict[str, list[Rule]], hidden: bool, depth: int) -> list[str]:
    """The table's lines."""
    grid: list[list[tuple[list[str], int, int]]] = []  # of each row the cells: lines, first column, the column after the last
    titles: list[str] = []
    reach: list[list[int]] = []  # cells of former rows that reach into this one: first column, the column after the last, rows left
    todo = [(k, table, hidden) for k in reversed(table.kids)]
    row: list | None = None

    def begin() -> list:
        for r in reach:
            r[2] -= 1
        reach[:] = sorted(r for r in reach if r[2] > 0)
        grid.append([])
        return grid[-1]

    while todo:
        node, parent, hide = todo.pop()
        if isinstance(node, str):
            if node.strip() and not hide:
                titles.append(_SPACE.sub(" ", node).strip(" "))
            continue
        shown, hide = _visible(node, hide, css, parent)
        if not shown:
            continue
        if node.tag == "tr" or node.tag in ("td", "th") and row is None:
            row = begin()
        if node.tag in ("td", "th"):
            at = row[-1][2] if row else 0
            for first, after, _ in reach:
                if first <= at < after:
                    row.append(([""], at, after))
                    at = after
            span = min(SPAN, max(1, _number(node.attrs.get("colspan"), 1)))
            down = _number(node.attrs.get("rowspan"), 1)
            row.append((_layout(node, css, hide, depth + 1).split("\n"), at, at + span))
            if down != 1 and len(reach) < REACHING:
                reach.append([at, at + span, down or sys.maxsize])
        elif node.tag == "caption":
            titles += [t for t in [_layout(node, css, hide, depth + 1)] if t]
        elif node.tag in ("tr", "tbody", "thead", "tfoot", "colgroup"):
            todo += [(k, node, hide) for k in reversed(node.kids)]
        elif inner := _layout_one(node, css, hide, depth + 1):
            titles.append(inner)
    # only columns in which a cell begins are there
    starts = sorted({at for row in grid for _, at, _ in row})
    place = {c: k for k, c in enumerate(starts)}
    room = [0] * len(starts)
    cells = [[(lines, place[at], bisect_left(starts, after)) for lines, at, after in row] for row in grid]
    for row in cells:
        for lines, at, after in row:
            if after == at + 1:
                room[at] = max(room[at], *map(width, lines))
    upto = [0, *accumulate(room)]
    out = [line for t in titles for line in t.split("\n")]
    for row in cells:
        for k in range(max((len(lines) for lines, _, _ in row), default=0)):
            said = []
            for lines, at, after in row:
                part = lines[k] if k < len(lines) else ""
                said.append(part + " " * (upto[after] - upto[at] + 3 * (after - at - 1) - width(part)))
            line = " | ".join(said).rstrip()
            if line.strip(" |"):
                out.append(line)
    return out


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"[0-9]{1,9}", value) else default


def _layout_one(node: Node, css: dict[str, list[Rule]], hidden: bool, depth: int) -> str:
    top = Node("#part", {})
    top.kids.append(node)
    return _layout(top, css, hidden, depth)


def render(source: str | None) -> str:
    """All visible text of a page."""
    if not source:
        return ""
    root, css = parse(source)
    return _layout(root, css, False, 0)


SCHEMA = "id long, text string, n_chars long, n_lines long"


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id, its visible text, and that text's code points and lines. No shuffle."""

    def start():
        def apply(cols):
            texts = [render(h) for h in cols["html"]]
            return {"id": cols["id"], "text": texts, "n_chars": [len(t) for t in texts], "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]}

        return apply

    return map_columns(pages.selectExpr(f"cast(`{id_col}` as bigint) as id", f"cast(`{html_col}` as string) as html"), SCHEMA, start)
