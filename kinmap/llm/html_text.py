"""Visible text of HTML pages: a tree with implied tags, visibility rules, and a renderer that keeps blocks, lists and tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import Carried, bounded_batches, slices
from kinmap.llm.words import text_column

# Fixed element sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
TEXT_ONLY = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes datalist object audio video canvas svg math map".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
CLOSES_P = BLOCKS - frozenset("body html dd dt li option optgroup td th tr tbody thead tfoot summary legend".split()) | {"li", "dd", "dt", "summary"}
HEAD_ONLY = frozenset("base link meta title style script template noscript head html".split())
#: A start tag ends the elements on its right that are open above the nearest of the barriers.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ()),
}
#: Ends of inner elements do not reach beyond these.
SCOPES = frozenset("table td th caption button object template".split())
#: Tables in tables up to this depth are laid out; deeper ones are text without a layout.
NESTED = 40
#: Width that the screen of a media query has, in pixels.
SCREEN = 1280

_TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|/([a-zA-Z][^\s/>]*)[^>]*>?|([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?/][^>]*>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_CSS = re.compile(r"[^{};]*+[{};]")
_COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+|\[[^\]\"']*(?:\"[^\"]*\"|'[^']*')?\s*\])*)", re.I)
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:(=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]*))\s*)?\]")
_FEATURE = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9.]+)\s*(px|em|rem)\s*\)")


class Node:
    """``shown``: the element and what it holds have boxes; ``visible``: its own text is seen."""

    __slots__ = ("attributes", "children", "shown", "tag", "visible")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []
        self.shown = self.visible = True


def attributes_of(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class TreeBuilder:
    """Builds the tree; ``styles`` gathers the text of style elements and ``title`` the first title."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.open = [self.root]
        self.counts: dict[str, int] = {}
        self.styles: list[str] = []
        self.title: str | None = None

    def build(self, source: str) -> Node:
        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if not m:
                tail = source.find("<", at)
                while 0 <= tail < end - 1 and not re.match(r"[a-zA-Z]", source[tail + 1]):
                    tail = source.find("<", tail + 1)
                self.text(source[at : tail if 0 <= tail < end - 1 else end])  # a tag that never ends is no text
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if m[1]:
                self.end(m[1].lower())
            elif m[2]:
                tag = m[2].lower()
                if tag in RAW or tag in TEXT_ONLY:
                    stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    inside = source[at : stop.start() if stop else end]
                    at = stop.end() if stop else end
                    self.closed(tag, m[3], inside)
                else:
                    self.start(tag, m[3])
        return self.root

    def closed(self, tag: str, source: str, inside: str) -> None:
        if tag == "style":
            self.styles.append(inside)
        elif tag == "title" and self.title is None:
            self.title = _SPACE.sub(" ", unescape(inside)).strip(" ")
        if tag == "textarea":
            node = Node(tag, attributes_of(source))
            node.children.append(unescape(inside).removeprefix("\n"))
            self.open[-1].children.append(node)

    def text(self, source: str) -> None:
        if "&" in source:
            source = unescape(source)
        top = self.open[-1]
        if top.tag == "head" and _SPACE.sub("", source):
            self.pop_to("head")  # text ends the head
            top = self.open[-1]
        top.children.append(source)

    def pop(self) -> None:
        self.counts[self.open.pop().tag] -= 1

    def pop_to(self, tag: str) -> None:
        while self.open[-1].tag != tag:
            self.pop()
        self.pop()

    def close(self, tags: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        """Ends the open elements of ``tags`` above the innermost barrier, and all within them."""
        if not any(self.counts.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in barriers:
                i += 1
                break
        for j in range(max(i, 1), len(self.open)):
            if self.open[j].tag in tags:
                while len(self.open) > j:
                    self.pop()
                return

    def start(self, tag: str, source: str) -> None:
        if self.counts.get("head") and tag not in HEAD_ONLY:
            self.pop_to("head")
        if tag in ("html", "body") and self.counts.get(tag):
            return
        if tag in CLOSES_P and self.counts.get("p"):
            self.close(("p",), tuple(SCOPES))
        if tag in IMPLIED_ENDS:
            self.close(*IMPLIED_ENDS[tag])
        node = Node(tag, attributes_of(source) if source and source != "/" else None)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.push(Node("tr"))
        self.open[-1].children.append(node)
        between = tag == "form" and self.open[-1].tag in ("table", "tbody", "thead", "tfoot", "tr")  # such a form holds nothing
        if tag not in VOID and not between:
            self.open.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        elif tag == "p" and not self.counts.get("p"):
            self.open[-1].children.append(Node("p"))
        elif tag not in ("body", "html") and self.counts.get(tag):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    while len(self.open) > i:
                        self.pop()
                    return
                if self.open[i].tag in SCOPES and tag not in SCOPES and tag not in ("tr", "tbody", "thead", "tfoot"):
                    return


def on_screen(query: str) -> bool:
    """Whether a media query holds for a screen of ``SCREEN`` pixels; features other than its width hold for none."""
    for one in query.lower().split(","):
        words = one.split()
        negated = words[:1] == ["not"]
        media = [w for w in words if w not in ("not", "only", "and") and w[0].isalpha() and not w.endswith(")")]
        holds = all(m in ("all", "screen") for m in media[:1])
        features = re.findall(r"\([^()]*\)", one)
        for f in features:
            m = _FEATURE.fullmatch(f)
            width = float(m[2].strip(".") or 0) * (1 if m[3] == "px" else 16) if m and m[2].count(".") < 2 else None
            holds &= width is not None and (SCREEN >= width if m[1] == "min" else SCREEN <= width)
        if holds != negated:
            return True
    return not query.strip()


def css_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that a screen applies, also inside the at-rules that hold for it."""
    open_: list[bool] = []  # of the blocks around: whether their rules count
    selectors = None
    for m in _CSS.finditer(re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)):
        text, end = m[0][:-1].strip(), m[0][-1]
        if selectors is not None:
            declared += m[0][: -1 if end == "}" else None]
            if end == "}":
                if all(open_):
                    yield selectors, declared
                selectors = None
        elif end == "{" and text.startswith("@"):
            name, _, rest = text[1:].partition(" ")
            if name.lower() in ("media", "supports", "layer", "container"):
                open_.append(on_screen(rest) if name.lower() == "media" else name.lower() != "container")
            else:
                selectors, declared = "", ""  # a block of declarations (or of frames) that no element has
        elif end == "{":
            selectors, declared = text, ""
        elif end == "}" and open_:
            open_.pop()


class Step(NamedTuple):
    """One compound of a selector: what an element must be, and how it stands to what the compound before it matched."""

    tag: str | None
    classes: frozenset[str]
    ids: frozenset[str]
    attributes: tuple[tuple[str, str | None], ...]
    child: bool
    first: bool
    bit: int
    rule: tuple | None  # of the last compound: (specificity, order, declarations)

    def fits(self, node: Node, classes: set[str]) -> bool:
        own = node.attributes
        return (self.tag is None or self.tag == node.tag) and self.classes <= classes and self.ids <= {own.get("id")} and all(k in own and v in (None, own[k]) for k, v in self.attributes)


def declarations(source: str) -> list[tuple[str, str, bool]]:
    return [(m[1].lower(), m[2].lower(), bool(m[3])) for m in _DECLARED.finditer(source)]


class Visibility:
    """What is seen: by kind of element, by attribute, and by the cascade of display and visibility over style elements (tags, classes, ids,
    attributes, descendants and children; other selectors match nothing) and style attributes."""

    def __init__(self, styles: list[str]) -> None:
        self.steps: dict[str, list[Step]] = {}
        self.bits = 0
        order = 0
        for sheet in styles if any(_HIDING.search(s) for s in styles) else ():
            for selectors, body in css_rules(sheet):
                if found := declarations(body):
                    for one in selectors.split(","):
                        order += 1
                        self.add(one.strip(), order, found)

    def add(self, selector: str, order: int, found: list) -> None:
        parts = re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", selector)
        steps, child = [], False
        for part in parts:
            if part == ">":
                child = True
                continue
            m = _COMPOUND.fullmatch(part)
            if not m or not part:
                return
            inner = _PART.findall(m[2] or "")
            tag = m[1].lower() if m[1] and m[1] != "*" else None
            named = {c: frozenset(x[1] for x in inner if x[0] == c) for c in ".#"}
            attributes = tuple((x[2].lower(), (x[4] or x[5] or x[6]) if x[3] else None) for x in inner if x[2])
            steps.append((tag, named["."], named["#"], attributes, child))
            child = False
        if not steps or child or steps[0][4]:
            return
        weight = (sum(len(s[2]) for s in steps), sum(len(s[1]) + len(s[3]) for s in steps), sum(s[0] is not None for s in steps))
        for i, s in enumerate(steps):
            last = i + 1 == len(steps)
            key = "#" + min(s[2]) if s[2] else "." + min(s[1]) if s[1] else s[0] or "*"
            self.steps.setdefault(key, []).append(Step(*s, first=i == 0, bit=self.bits, rule=(weight, order, found) if last else None))
            self.bits += 1

    def mark(self, root: Node) -> None:
        """Sets ``shown`` and ``visible`` of all elements. With each element go the compounds that its parent, and that any element around
        it, has matched so far."""
        stack: list[tuple[Node, int, int]] = [(root, 0, 0)]
        while stack:
            node, around, above = stack.pop()
            for child in node.children:
                if isinstance(child, str):
                    continue
                matched = self.decide(child, node.visible, around, above)
                if child.shown and child.children:
                    stack.append((child, around | matched, matched))

    def decide(self, node: Node, inherited: bool, around: int, above: int) -> int:
        own, matched = node.attributes, 0
        best: dict[str, tuple] = {}
        if self.steps:
            classes = set(own.get("class", "").split())
            keys = [node.tag, "*", *("." + c for c in classes), *(["#" + own["id"]] if "id" in own else ())]
            for step in (s for k in keys for s in self.steps.get(k, ())):
                if (step.first or (above if step.child else around) >> (step.bit - 1) & 1) and step.fits(node, classes):
                    if step.rule is None:
                        matched |= 1 << step.bit
                    else:
                        for name, value, important in step.rule[2]:
                            best[name] = max(best.get(name, ((),)), ((important, False, *step.rule[:2]), value))
        if "style" in own:
            for name, value, important in declarations(own["style"]):
                best[name] = max(best.get(name, ((),)), ((important, True, (), 0), value))
        display, visibility = (best[n][1] if n in best else None for n in ("display", "visibility"))
        absent = node.tag in HIDDEN or (node.tag == "dialog" and "open" not in own) or ("hidden" in own and display is None)
        node.shown = not absent and display != "none"
        node.visible = inherited if visibility in (None, "inherit", "unset") else visibility not in ("hidden", "collapse")
        return matched


def width_of(text: str) -> int:
    return len(text) if text.isascii() else sum(1 + (east_asian_width(c) in "WF") for c in text)


def number(value: str | None, default: int, least: int, most: int) -> int:
    return min(max(int(value), least), most) if value and re.fullmatch(r"-?[0-9]{1,9}", value.strip()) else default


class Renderer:
    """Lines of the visible text; blocks begin new lines, spaced ones also leave an empty line around them."""

    def __init__(self, nested: int = 0) -> None:
        self.nested = nested
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the current line
        self.space = False  # before the next text
        self.gap = 0  # empty lines before the next line
        self.indent: list[str] = []
        self.marker = ""  # of a list item whose first line is to come
        self.lists: list[int | None] = []
        self.pre = 0

    def words(self, text: str) -> None:
        if self.pre:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self.parts.append(first)
            for line in more:
                self.line(True)
                self.parts.append(line)
            return
        clean = _SPACE.sub(" ", text)
        if clean == " " or not clean:
            self.space = self.space or bool(clean and self.parts)
            return
        if clean[0] == " " or self.space:
            clean = (" " if self.parts else "") + clean.lstrip(" ")
        self.space = clean[-1] == " "
        self.parts.append(clean.rstrip(" "))

    def line(self, keep_empty: bool = False) -> None:
        text = "".join(self.parts)
        self.parts, self.space = [], False
        if not text and not self.marker and not keep_empty:
            return
        if not text.strip() and not keep_empty:
            return
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        prefix = "".join(self.indent)
        if self.marker:
            prefix = prefix[: -len(self.marker)] + self.marker if self.indent else self.marker
            self.marker = ""
        self.lines.append((prefix + text).rstrip())

    def block(self, spaced: bool) -> None:
        self.line()
        if spaced and self.lines:
            self.gap = 1

    def enter(self, node: Node) -> bool:
        """False if the node's children are not to be visited."""
        tag = node.tag
        if tag == "br":
            if self.parts:
                self.line()
            elif self.lines and not self.gap:
                self.lines.append("")
            return False
        if tag == "table":
            self.block(True)
            self.table(node)
            return False
        if tag in BLOCKS:
            self.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and self.lists))
        if tag == "hr":
            self.parts.append("---")
            self.block(True)
        elif tag in ("ul", "menu", "dir"):
            self.lists.append(None)
        elif tag == "ol":
            self.lists.append(number(node.attributes.get("start"), 1, -(10**6), 10**6))
        elif tag == "li":
            at = self.lists[-1] if self.lists else None
            self.marker = "- " if at is None else f"{at}. "
            if at is not None:
                self.lists[-1] = at + 1
            self.indent.append(" " * len(self.marker))
        elif tag in ("blockquote", "dd"):
            self.indent.append("  ")
        elif tag in ("pre", "textarea"):
            self.pre += 1
        elif tag == "img" and node.visible and node.attributes.get("alt"):
            self.words(node.attributes["alt"])
        return True

    def leave(self, node: Node) -> None:
        tag = node.tag
        if tag == "pre":
            if self.parts and not "".join(self.parts):
                self.parts = []
        if tag in BLOCKS:
            self.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and len(self.lists) > 1))
        if tag in ("ul", "menu", "dir", "ol"):
            if self.lists:
                self.lists.pop()
        elif tag in ("li", "blockquote", "dd"):
            if tag == "li":
                self.marker = ""
            self.indent.pop()
        elif tag in ("pre", "textarea"):
            self.pre -= 1

    def shown(self, node: Node) -> Iterator:
        """Children that are seen: of closed details only the summary."""
        closed = node.tag == "details" and "open" not in node.attributes
        for child in node.children:
            if isinstance(child, str):
                if not closed and node.visible:
                    yield child
            elif child.shown and not (closed and child.tag != "summary"):
                yield child

    def flat(self, node: Node) -> str:
        """The text of an element on one line; blocks and breaks inside it are spaces."""
        out, stack = [], [self.shown(node)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                out.append(child)
            else:
                if child.tag in BLOCKS or child.tag == "br":
                    out.append(" ")
                if child.tag == "img" and child.visible:
                    out.append(child.attributes.get("alt", ""))
                stack.append(self.shown(child))
        return _SPACE.sub(" ", "".join(out)).strip(" ")

    def inner(self, node: Node) -> list[str]:
        """The lines of an element by itself, with its own blocks, lists and tables."""
        if self.nested >= NESTED:
            return [t] if (t := self.flat(node)) else []
        return Renderer(self.nested + 1).lines_of(node)

    def cells(self, row: Node, loose: list[str]) -> list[tuple[list[str], int, int]]:
        """Lines, columns and rows of a row's cells, also of those inside other elements; what is in no cell goes to ``loose``."""
        cells, stack = [], [self.shown(row)]
        loose.append(" ")
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                loose.append(child)
            elif child.tag in ("td", "th"):
                cells.append((self.inner(child), number(child.attributes.get("colspan"), 1, 1, 1000), number(child.attributes.get("rowspan"), 1, 0, 65534)))
                loose.append(" ")
            elif child.tag == "table":
                loose.append(" " + self.flat(child) + " ")
            else:
                if child.tag in BLOCKS or child.tag == "br":
                    loose.append(" ")
                if child.tag == "img" and child.visible:
                    loose.append(child.attributes.get("alt", ""))
                stack.append(self.shown(child))
        return cells

    def table(self, node: Node) -> None:
        groups: dict[str, list[list[Node]]] = {"thead": [], "tbody": [], "tfoot": []}
        plain: list[Node] | None = None  # rows outside any group, up to the next
        before: list[str] = []
        loose: list[str] = []
        for child in self.shown(node):
            if isinstance(child, str):
                loose.append(child)
                continue
            if child.tag == "tr":
                if plain is None:
                    groups["tbody"].append(plain := [])
                plain.append(child)
                continue
            if child.tag in groups:
                plain = None
                rows: list[Node] = []
                stack = [self.shown(child)]
                while stack:
                    x = next(stack[-1], None)
                    if x is None:
                        stack.pop()
                    elif isinstance(x, str):
                        loose.append(x)
                    elif x.tag == "tr":
                        rows.append(x)
                    elif x.tag in groups:
                        stack.append(self.shown(x))
                    else:
                        loose.append(" " + self.flat(x))
                groups[child.tag].append(rows)
            elif child.tag == "caption":
                before += self.inner(child)
            else:
                loose.append(" " + self.flat(child))
        grid = [row for kind in groups.values() for rows in kind for row in self.placed([self.cells(r, loose) for r in rows])]
        text = _SPACE.sub(" ", "".join(loose)).strip(" ")
        for line in [*before, *([text] if text else [])]:
            self.parts.append(line)
            self.line(True)
        widths = column_widths(grid)
        for row in grid:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                line, done = [], 0  # of the row's columns
                for at, span, lines in row:
                    text = lines[i] if i < len(lines) else ""
                    line.append(" " * (sum(widths.get(c, 0) + 2 for c in range(done, at))))
                    room = sum(widths.get(c, 0) + 2 for c in range(at, at + span))
                    line.append(text + " " * max(2 if text else 0, room - width_of(text)))
                    done = at + span
                self.parts.append("".join(line).rstrip(" "))
                self.line(True)
        self.gap = 1 if self.lines else 0

    @staticmethod
    def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
        """(column, columns, lines) of the cells of one group's rows; columns that a cell from above reaches into are left free."""
        out, taken = [], {}  # column: rows that are still taken
        for i, row in enumerate(rows):
            at, own = 0, []
            for lines, span, down in row:
                while taken.get(at, 0) > i:
                    at += 1
                own.append((at, span, lines))
                if down != 1:
                    for c in range(at, at + span):
                        taken[c] = i + down if down else len(rows)
                at += span
            out.append(own)
        return out

    def lines_of(self, root: Node) -> list[str]:
        stack = [(root, self.shown(root))]
        while stack:
            node, children = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                if node is not root:
                    self.leave(node)
            elif isinstance(child, str):
                self.words(child)
            elif self.enter(child):
                stack.append((child, self.shown(child)))
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def column_widths(grid: list[list[tuple[int, int, list[str]]]]) -> dict[int, int]:
    """The width of each column's widest cell. Where one wide cell among many rows would make the table's padding many times its text, the
    column takes the widest width that does not."""
    found: dict[int, list[int]] = {}
    text = 0
    for row in grid:
        for at, span, lines in row:
            own = [width_of(x) for x in lines]
            text += sum(own)
            if span == 1:
                found.setdefault(at, []).extend(own)
    room = 10_000 + 8 * text
    out = {}
    for at, widths in found.items():
        widths.sort()
        total, n = sum(widths), len(widths)
        while n and widths[n - 1] * n - total > room // max(len(found), 1):
            n -= 1
            total -= widths[n]
        out[at] = widths[n - 1] if n else 0
    return out


def page_text(source: str) -> tuple[str | None, str]:
    """Title and visible text."""
    builder = TreeBuilder()
    root = builder.build(source)
    Visibility(builder.styles).mark(root)
    return builder.title, "\n".join(Renderer().lines_of(root))


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row a page: the columns ``keep`` (``key`` alone by default), title, text.

    No shuffle; whole pages, in time about linear in their length. Null html has a null title and text, empty html an empty text; null
    keys and repeated rows come back as they are; an empty table gives an empty result; further columns are not read, and ``keep``
    may not name an added one. Markup that is broken never fails: ends are implied, and what cannot be a tag is text.
    """
    carried = Carried(pages, [key] if keep is None else keep)
    own = carried.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            column = batch.column("_html")
            got = [page_text(s) for s in text_column(column).to_pylist()]
            nulls = column.is_null().to_pylist()
            texts = [None if null else g[1] for g, null in zip(got, nulls)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.array([g[0] for g in got], pa.string()), pa.array(texts, pa.string())], names=[*own, "title", "text"])

    read = pages.select(*carried.columns, F.col(f"`{html}`").alias("_html"))
    return bounded_batches(read).mapInArrow(run, f"{carried.ddl}, title string, text string").select(*carried.restored, "title", "text")
