"""Layout-aware rendering of HTML pages to text.

A tree builder applies the implied tags of HTML (a paragraph ends where a block starts, list items, table
rows and cells end each other, a row implies a table body), at any depth. Visibility follows the elements that are never shown, the hidden attribute, closed
details, and a small cascade of `display` and `visibility`: style sheets with one simple selector a rule, ordered by importance, specificity and place, then inline
styles; rules for other media than screens don't count, and what is inside a hidden element may be visible again. Rendering collapses blanks as a browser does, keeps
paragraph spacing, list markers with their nesting, preformatted text, and pads table cells to columns. Formulas are inline
text, of drawings the text elements are shown, text areas keep their lines, and each option takes a line.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow

# Element names of HTML by how they behave.
NEVER = frozenset("head script style template noscript title meta link base iframe object embed audio video canvas datalist param source track annotation annotation-xml".split())
# Parts of drawings that are not painted where they stand, and HTML elements that end a drawing or formula.
UNPAINTED = frozenset("defs symbol clippath mask pattern marker desc metadata lineargradient radialgradient filter".split())
FOREIGN_ENDERS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr tbody thead tfoot caption".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE_SCOPE = frozenset("table td th caption html body".split())
# What a start tag closes, and the elements at which the search for it stops.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select", "datalist")),
    "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
}
P_ENDERS = BLOCK - frozenset("html body dt dd li tr tbody thead tfoot caption legend".split()) | {"li", "dd", "dt"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DECLARATION = re.compile(r"([\w-]+)\s*:((?:[^;\"']|\"[^\"]*\"|'[^']*')*)")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SIMPLE = re.compile(r"\*|[.#]?[\w-]+")
BLANKS = re.compile(r"[ \t\n\r\f]+")
# Fields that show their value.
VALUED = frozenset("submit button reset text search email url tel number".split())
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")


class Node:
    __slots__ = ("attrs", "kids", "shown", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.shown = tag, attrs, [], True


def declarations(style: str) -> Iterator[tuple[str, bool, str]]:
    """(property, important, value) of each display and visibility."""
    for m in DECLARATION.finditer(COMMENT.sub(" ", style)):
        name, (value, mark, _) = m[1].lower(), m[2].lower().partition("!important")
        if name in ("display", "visibility"):
            yield name, bool(mark), value.strip()


class Sheet:
    """What style sheets say of display and visibility, by simple selector: (important, specificity, place, value)."""

    def __init__(self):
        self.rules: dict[tuple[str, str], list] = {}
        self.place = 0

    def read(self, css: str) -> None:
        css, at = COMMENT.sub(" ", css), 0
        while (open_ := css.find("{", at)) >= 0:
            head = css[at:open_].rpartition(";")[2].strip()
            depth, end = 1, open_ + 1
            while depth and (m := re.compile(r"[{}]").search(css, end)):
                depth, end = depth + (1 if m[0] == "{" else -1), m.end()
            body, at = css[open_ + 1 : end - 1 if not depth else len(css)], end if not depth else len(css)
            if head.startswith("@"):
                name, _, media = head[1:].lower().partition(" ")
                if name in ("supports", "layer") or name == "media" and any(re.match(r"\s*(only\s+)?(all|screen)\b|\s*\(", x) for x in media.split(",")):
                    self.read(body)
                continue
            found = list(declarations(body))
            for selector in map(str.strip, head.split(",")) if found else ():
                if SIMPLE.fullmatch(selector):
                    rank = {"*": 0, ".": 2, "#": 3}.get(selector[0], 1)
                    for name, important, value in found:
                        self.place += 1
                        self.rules.setdefault((selector if rank else "*", name), []).append((important, rank, self.place, value))

    def value(self, node: Node, name: str) -> str:
        """The property's value for an element, or an empty string."""
        a, found = node.attrs, []
        if self.rules:
            for selector in ("*", node.tag, "#" + a.get("id", ""), *("." + c for c in a.get("class", "").split())):
                found += self.rules.get((selector, name), ())
        if "style" in a:
            found += [(important, 4, i, value) for i, (n, important, value) in enumerate(declarations(a["style"])) if n == name]
        return max(found)[3] if found else ""


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def build_tree(html: str) -> tuple[Node, Sheet]:
    """The tree of a page, and its style sheets. A tag with a quote that nothing closes ends at the next >."""
    root = Node("html", {})
    stack, sheet, at = [root], Sheet(), 0
    count: Counter = Counter()  # open elements by name, so that deep pages need no search in vain

    def push(node: Node) -> None:
        stack[-1].kids.append(node)
        stack.append(node)
        count[node.tag] += 1

    def cut(i: int) -> None:
        count.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def close(names, stops) -> None:
        i = len(stack) - 1
        while i > 0 and any(count[x] > 0 for x in names) and stack[i].tag not in stops:
            if stack[i].tag in names:
                cut(i)
            i -= 1

    end = len(html)
    while at < end:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if text:
            stack[-1].kids.append(unescape(text) if "&" in text else text)
        if not m:
            break
        ends, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        at, tag = m.end(), (name or "").lower()
        if not tag:
            continue
        if ends:
            if tag == "p" and not count["p"]:
                stack[-1].kids.append(Node("p", {}))
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
                continue
            for i in range(len(stack) - 1, 0, -1) if count[tag] > 0 else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                    break  # an end tag inside a cell does not reach outside it
            continue
        if tag in ("html", "body") and raw:
            root.attrs.update(attributes(raw))
        if tag == "html" or tag == "body" and count["body"] > 0:
            continue
        foreign = count["svg"] > 0 or count["math"] > 0
        if foreign and tag in FOREIGN_ENDERS:
            i = len(stack) - 1
            while i > 0 and stack[i].tag not in HTML_INSIDE and stack[i].tag not in ("svg", "math"):
                i -= 1
            while i > 0 and stack[i].tag in ("svg", "math"):
                cut(i)  # HTML goes on where the drawing or formula stands
                i -= 1
        if tag in P_ENDERS:
            close(("p",), INLINE_SCOPE)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            cut(-1)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if stack[-1].tag == "head" and tag not in NEVER:
            cut(-1)
        if tag == "tr" and stack[-1].tag == "table":
            push(Node("tbody", {}))
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr", {}))
        node = Node(tag, attributes(raw) if raw and raw != "/" else {})
        if tag in VOID or tag in RAW or foreign and raw and SELF_CLOSED.search(raw):
            stack[-1].kids.append(node)
        else:
            push(node)
        if tag in RAW and not (foreign and raw and SELF_CLOSED.search(raw)):
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            body = html[at : stop.start() if stop else end]
            at = stop.end() if stop else end
            if tag == "style":
                sheet.read(body)
            elif tag == "xmp":
                node.kids.append(body)
            elif tag == "textarea":
                node.kids.append(unescape(body).removeprefix("\n"))
    return root, sheet


def prune(node: Node, sheet: Sheet, seen: bool = True) -> bool:
    """Take away what isn't displayed and the text of hidden elements; whether anything of the node shows.

    Hidden list items and cells keep their number and their place.
    """
    if node.tag in NEVER:
        return False
    a, display = node.attrs, sheet.value(node, "display")
    if display == "none" or not display and ("hidden" in a or node.tag == "dialog" and "open" not in a):
        return False
    visibility = sheet.value(node, "visibility")
    if visibility in ("hidden", "collapse", "visible", "initial"):
        seen = visibility in ("visible", "initial")
    if node.tag == "input":
        if seen and a.get("value") and a.get("type", "text").lower() in VALUED:
            node.kids.append(a["value"])
    kids, some = [], False
    for kid in node.kids:
        if isinstance(kid, str):
            if seen:
                kids.append(kid)
        elif prune(kid, sheet, seen):
            kids.append(kid)
            some = True
    node.kids, node.shown = kids, seen or some
    return node.shown or node.tag in ("li", "td", "th", "tr", "tbody", "thead", "tfoot")


def columns(text: str) -> int:
    """The places that a line takes: two for wide characters, none for marks that combine."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Collects inline text into lines; blanks collapse, and a wanted gap appears once text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.gap, self.blank = "", 0, False

    def write(self, text: str, pre: bool = False) -> None:
        if pre:
            first, *rest = text.split("\n")
            self._put(first)
            for x in rest:
                self.lines.append(self.now.rstrip())
                self.now = x
            return
        text = BLANKS.sub(" ", text)
        if text.startswith(" "):
            self.blank, text = True, text[1:]
        if text:
            tail = text.endswith(" ")
            self._put((" " if self.blank and self.now else "") + (text[:-1] if tail else text))
            self.blank = tail

    def _put(self, text: str) -> None:
        if text and not self.now and self.gap and self.lines:
            self.lines.extend([""] * (self.gap - 1))
        if text:
            self.gap = 0
            self.now += text

    def line_break(self) -> None:
        self.lines.append(self.now.rstrip())
        self.now, self.blank = "", False

    def block(self, gap: int) -> None:
        if self.now.strip():
            self.lines.append(self.now.rstrip())
        self.now, self.blank = "", False
        self.gap = max(self.gap, gap)

    def add(self, lines: list[str], gap: int) -> None:
        if lines:
            self.block(gap)
            if self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.lines.extend(lines)
            self.gap = gap

    def done(self) -> list[str]:
        self.block(1)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def render_list(node: Node) -> list[str]:
    step = -1 if "reversed" in node.attrs else 1
    out, number = [], 1 if step > 0 else sum(isinstance(k, Node) and k.tag == "li" for k in node.kids)
    start = node.attrs.get("start", "")
    if re.fullmatch(r"-?\d{1,9}", start):
        number = int(start)
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip():
                out.append(BLANKS.sub(" ", kid).strip())
        else:
            lines = render(kid)
            if kid.tag == "li":
                if re.fullmatch(r"-?\d{1,9}", kid.attrs.get("value", "")):
                    number = int(kid.attrs["value"])
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += step
                if not kid.shown:
                    continue
                out += [(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(lines or [""])]
            else:
                out += ["  " + x if x else "" for x in lines]
    return [x.rstrip() for x in out]


def render_table(node: Node) -> list[str]:
    """Rows of cells, each column as wide as its widest line; a cell of several lines takes several lines.

    A cell that spans columns or rows shows in the first of them, and keeps the others' places empty.
    """
    rows, above, taken = [], [], {}  # taken: for how many more rows a column is held by a cell from above

    def span(cell: Node, name: str) -> int:
        n = cell.attrs.get(name, "1").strip()
        return min(max(int(n), 1), 1000) if re.fullmatch(r"\d{1,6}", n) else 1  # HTML's own limit

    def place(row: list, cell: Node) -> None:
        while taken.get(len(row), 0) > 0:
            row.append([])
        for k in range(span(cell, "colspan")):
            taken[len(row)] = span(cell, "rowspan")
            row.append(render(cell) if k == 0 else [])

    def walk(x: Node) -> None:
        for kid in x.kids:
            if isinstance(kid, str):
                if kid.strip():
                    above.append(BLANKS.sub(" ", kid).strip())
            else:
                if kid.tag == "tr":
                    row = []
                    for c in kid.kids:
                        if isinstance(c, Node) and c.tag in ("td", "th"):
                            place(row, c)
                        elif isinstance(c, Node):
                            above.extend(render(c))
                        elif isinstance(c, str) and c.strip():
                            above.append(BLANKS.sub(" ", c).strip())
                    rows.append(row)
                    for k in [k for k, n in taken.items() if n]:
                        taken[k] -= 1
                elif kid.tag in ("tbody", "thead", "tfoot", "colgroup"):
                    walk(kid)
                else:
                    above.extend(render(kid))

    walk(node)
    rows = [r for r in rows if any(r)]
    width = [0] * max(map(len, rows), default=0)
    for r in rows:
        for i, c in enumerate(r):
            width[i] = max([width[i], *map(columns, c)])
    out = above
    for r in rows:
        for k in range(max(map(len, r))):
            cells = [c[k] if k < len(c) else "" for c in r]
            while cells and not cells[-1].strip():
                cells.pop()
            out.append(" | ".join(c + " " * (width[i] - columns(c)) for i, c in enumerate(cells)).rstrip(" "))
    return out


def painted(svg: Node) -> list[Node]:
    """The text elements and embedded HTML of a drawing that are shown, in order."""
    out, todo = [], [svg]
    while todo:
        x = todo.pop()
        if x.tag in ("text", "foreignobject"):
            out.append(x)
        else:
            todo += [k for k in reversed(x.kids) if isinstance(k, Node) and k.tag not in UNPAINTED]
    return out


def render(node: Node, pre: bool = False) -> list[str]:
    out = Lines()

    def walk(x: Node, pre: bool) -> None:
        closed = x.tag == "details" and "open" not in x.attrs
        shown = False
        for kid in x.kids:
            if isinstance(kid, str):
                if not closed:
                    out.write(kid, pre)
                continue
            tag = kid.tag
            if tag == "br":
                out.line_break()
                continue
            if closed:
                if tag != "summary" or shown:
                    continue
                shown = True
            if tag in ("ul", "ol", "menu"):
                out.add(render_list(kid), 1 if x.tag == "li" else 2)
            elif tag == "table":
                out.add(render_table(kid), 2)
            elif tag == "hr":
                out.add(["---"], 2)
            elif tag == "blockquote":
                out.add(["> " + y if y else ">" for y in render(kid)], 2)
            elif tag == "svg":
                for t in painted(kid):
                    out.write(" ")
                    walk(t, False)
                    out.write(" ")
            elif tag == "textarea":
                for t in kid.kids:
                    out.write(t, True)
            elif tag in ("option", "optgroup"):
                out.block(1)
                if kid.attrs.get("label"):
                    out.write(kid.attrs["label"])
                    out.block(1)
                if tag == "optgroup" or not kid.attrs.get("label"):
                    walk(kid, False)
                out.block(1)
            elif tag == "select":
                out.block(1)
                walk(kid, False)
                out.block(1)
            elif tag in BLOCK:
                gap = 2 if tag in SPACED else 1
                out.block(gap)
                if tag == "dd":
                    out.add(["  " + y if y else "" for y in render(kid)], 1)
                else:
                    walk(kid, pre or tag == "pre")
                out.block(gap)
            else:
                walk(kid, pre)

    if node.tag in ("svg", "textarea", "select", "option", "optgroup"):
        node, inner = Node("", {}), node
        node.kids.append(inner)
    walk(node, pre or node.tag == "pre")
    return out.done()


def visible_text(html: str | None) -> str:
    html = (html or "").replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    root, sheet = build_tree(html)
    limit = sys.getrecursionlimit()
    # calls of Python by Python use no C stack; an open element takes four of them at most, with those it implies
    sys.setrecursionlimit(max(limit, limit + 12 * html.count("<")))
    try:
        return "\n".join(render(root)) if prune(root, sheet) else ""
    finally:
        sys.setrecursionlimit(limit)


def _runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            x = b.slice(at, 256)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([visible_text(h) for h in x.column(1).to_pylist()], pa.string())], names=["page_id", "text"])


def render_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text): the visible text of every page, laid out.

    A null or empty page gives an empty text. Ids, null or repeated, pass through with each row rendered
    by itself; broken markup is rendered as far as it goes; whole pages are read, of any length. Other
    columns are not read, and an empty table gives no rows.
    """
    rows = narrow(df, id_col, html_col).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_runner, f"page_id {kind}, text string")
