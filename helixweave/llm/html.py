"""Layout-aware text of HTML pages.

A tokenizer (one regular expression) feeds a tree builder that knows void and raw-text elements, tags
that end others by implication (p, li, td, option, ...), and misnested ends. Rendering walks the tree:
nothing invisible (head, script, hidden attributes, inline or style-sheet ``display:none``, text whose inherited ``visibility`` is not visible) is shown;
block elements begin new lines, paragraphs and headings are set apart by a blank line, list items get
their marker and indent, ``pre`` keeps its white space, and the cells of a table are padded so that
its columns line up.

Edge cases: null pages give null text, empty pages an empty text; unclosed and stray tags never fail;
nesting deeper than MAX_DEPTH is flattened, keeping its text; unknown entities stay as written; pages of
any length are read whole; rows that repeat are rendered each; an empty table gives an empty result; a
kept column may have any name: one called ``html`` is kept, one called ``text`` becomes ``text_in``.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg datalist title meta link base".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure menu xmp".split())
ENDS_P = BLOCK - frozenset("body html dd dt li option optgroup legend caption tbody td tfoot th thead tr summary figcaption".split())
#: A start tag ends the open elements of its set, up to the nearest element of the scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
HEAD_ONLY = frozenset("base link meta script style title template noscript".split())
MAX_DEPTH = 200
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_HIDES = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_NUMBER = re.compile(r"[ \t\n\r\f]*(-?[0-9]{1,9})(?![0-9])")
_MEDIA = re.compile(r"@media\b([^{};]*)\{", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"^(\w+)?(?:\.([\w-]+))?(?:#([\w-]+))?$")
_WHITE = re.compile(r"[ \t\n\r\f]+")
#: White space for Python that is none for HTML.
_ODD = re.compile("[\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


def on_screen(sheet: str) -> str:
    """The style sheet without its comments and without @media blocks for other than all screens."""
    sheet, at = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S), 0
    while m := _MEDIA.search(sheet, at):
        at = m.end()
        if not any(" ".join(q.lower().split()).removeprefix("only ") in ("", "all", "screen") for q in m[1].split(",")):
            depth, end = 1, at
            while depth and end < len(sheet):
                depth += {"{": 1, "}": -1}.get(sheet[end], 0)
                end += 1
            sheet, at = sheet[: m.start()] + sheet[end:], m.start()
    return sheet


def number(value: str | None, default: int, least: int, most: int) -> int:
    """The whole number that an attribute's value begins with, within bounds; default where there is none."""
    m = _NUMBER.match(value or "")
    return min(most, max(least, int(m[1]))) if m else default


def selectors(sheet: str) -> tuple[list[tuple], list[tuple]]:
    """(tag, class, id) of the simple selectors whose rule hides, and (tag, class, id, visibility); others are not interpreted."""
    hidden, veils = [], []
    for heads, rule in _RULE.findall(on_screen(sheet)):
        none, seen = _HIDES.search(rule), _VISIBILITY.search(rule)
        if none or seen:
            found = [m.groups() for x in heads.split(",") if (m := _SIMPLE.match(x.strip())) and any(m.groups())]
            hidden += found if none else []
            veils += [(*m, seen[1].lower()) for m in found] if seen else []
    return hidden, veils


def matches(n: Node, rule: tuple) -> bool:
    t, c, i = rule[:3]
    return (not t or t == n.name) and (not c or c in n.attrs.get("class", "").split()) and (not i or i == n.attrs.get("id"))


def veil(root: Node, rules: list[tuple]) -> None:
    """Takes the text of invisible elements out of the tree: visibility is inherited, and a descendant may be visible again."""
    todo = [(root, True)]
    while todo:
        n, seen = todo.pop()
        for r in rules:
            seen = r[3] == "visible" if matches(n, r) else seen
        if m := _VISIBILITY.search(n.attrs.get("style", "")):
            seen = m[1].lower() == "visible"
        if not seen:
            n.children = [c for c in n.children if isinstance(c, Node)]
            n.attrs.pop("value", None)
        todo += [(c, seen) for c in n.children if isinstance(c, Node)]


def parse(html: str) -> tuple[Node, list[tuple]]:
    """The tree without invisible text, and the simple selectors (tag, class, id) that style sheets hide."""
    root = Node("#root")
    stack, hidden, veils, at = [root], [], [], 0

    def close(names, scope):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in scope:
                return
            if stack[i].name in names:
                # everything of the set that is open here ends
                while i > 1 and stack[i - 1].name in names:
                    i -= 1
                del stack[i:]
                return

    def text(s):
        if s:
            if stack[-1].name == "head" and not s.isspace():
                stack.pop()
            stack[-1].children.append(unescape(s))

    while at < len(html):
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if m["cdata"]:
            stack[-1].children.append(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not any(n.name == "p" for n in stack):
                stack[-1].children.append(Node("p"))
            else:
                limit = {"table"} if name not in ("table", "body", "html") and name not in BLOCK - {"td", "th", "tr", "table"} else set()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
                    if stack[i].name in limit:
                        break
            continue
        attrs = {}
        for a in _ATTR.finditer(m["attrs"] or ""):
            attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        if name in ("html", "body") and any(n.name == name for n in stack):
            continue
        if stack[-1].name == "head" and name not in HEAD_ONLY:
            stack.pop()
        if name in ENDS_P:
            close({"p"}, {"table", "td", "th", "button"})
        if name in IMPLIED:
            close(*IMPLIED[name])
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at : end.start() if end else len(html)]
            at = end.end() if end else len(html)
            if name == "style":
                both = selectors(body)
                hidden += both[0]
                veils += both[1]
            elif name == "textarea":
                node.children.append(unescape(body))
            elif name == "xmp":
                node.children.append(body)
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
    if _VISIBILITY.search(html):
        veil(root, veils)
    return root, hidden


class Renderer:
    """Lines of visible text; collapses white space as a browser does."""

    def __init__(self, hidden: list[tuple]):
        self.hidden = hidden
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a blank line is due before the next text
        self.space = False  # a collapsed space is due before the next word
        self.indent = ""
        self.marker = ""

    def invisible(self, n: Node) -> bool:
        a = n.attrs
        if n.name in UNSEEN or "hidden" in a or (n.name == "input" and a.get("type", "").lower() == "hidden") or (n.name == "dialog" and "open" not in a):
            return True
        if "style" in a and _HIDES.search(a["style"]):
            return True
        return any(matches(n, r) for r in self.hidden)

    def end_line(self):
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def put(self, s: str):
        if not self.line:
            if self.blank and self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank = False
            self.line.append(self.indent + self.marker)
            self.indent, self.marker = self.indent + " " * len(self.marker), ""
            s = s.lstrip(" ") if not s.startswith(" ") else s
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(s)

    def text(self, s: str, pre: bool):
        if pre:
            for i, part in enumerate(s.split("\n")):
                if i:
                    if not self.line:
                        self.lines.append("")
                    self.end_line()
                if part:
                    if not self.line:
                        self.put("")
                    self.line.append(part)
            return
        words = [w for w in _WHITE.split(s) if w] if _ODD.search(s) else s.split()
        if s[:1].isspace() and s[:1] != " " and self.line:
            self.space = True
        if words:
            self.put(" ".join(words))
            self.space = s[-1:] in " \t\n\r\f"

    def children(self, n: Node, pre: bool):
        for i, c in enumerate(n.children):
            if isinstance(c, str):
                self.text(c[1:] if pre and i == 0 and n.name == "pre" and c[:1] == "\n" else c, pre)
            else:
                self.node(c, pre)

    def node(self, n: Node, pre: bool = False):
        if self.invisible(n):
            return
        name = n.name
        if name == "br":
            if self.line:
                self.end_line()
            elif self.lines and self.lines[-1]:
                self.lines.append("")
            return
        if name == "img":
            return
        if name == "input" and n.attrs.get("type", "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url", "tel", "number"):
            if n.attrs.get("value"):
                self.text(n.attrs["value"], False)
            return
        if name not in BLOCK:
            self.children(n, pre)
            return
        self.end_line()
        self.blank |= name in SPACED and not (name in ("ul", "ol") and self.indent)
        if name == "table":
            self.table(n)
        elif name in ("ul", "ol", "menu"):
            self.list(n, name == "ol")
        elif name in ("blockquote", "dd"):
            old, self.indent = self.indent, self.indent + "  "
            self.children(n, pre)
            self.end_line()
            self.indent = old
        elif name == "details" and "open" not in n.attrs:
            for c in n.children:
                if isinstance(c, Node) and c.name == "summary":
                    self.node(c)
                    break
        else:
            self.children(n, pre or name in ("pre", "xmp"))
        self.end_line()
        self.blank |= name in SPACED and not (name in ("ul", "ol") and self.indent)

    def list(self, n: Node, numbered: bool):
        at = number(n.attrs.get("start"), 1, -(10**9), 10**9)
        old = self.indent
        for c in n.children:
            if isinstance(c, Node) and c.name == "li" and not self.invisible(c):
                self.end_line()
                self.indent, self.marker = old, f"{at}. " if numbered else "- "
                at += 1
                self.children(c, False)
                self.end_line()
                self.indent, self.marker = old, ""
            elif isinstance(c, Node):
                self.node(c)
            else:
                self.text(c, False)

    def cell(self, n: Node) -> list[str]:
        inner = Renderer(self.hidden)
        inner.children(n, False)
        return inner.finish() or [""]

    def table(self, n: Node):
        rows: list[list[tuple[int, list[str]]]] = []
        held: dict[int, int] = {}  # columns that a rowspan above still fills

        def walk(node: Node):
            for c in node.children:
                if not isinstance(c, Node):
                    self.text(c, False)
                elif self.invisible(c):
                    continue
                elif c.name == "caption":
                    self.end_line()
                    self.children(c, False)
                    self.end_line()
                elif c.name in ("thead", "tbody", "tfoot"):
                    walk(c)
                elif c.name == "tr":
                    row, col = [], 0
                    for d in c.children:
                        if isinstance(d, Node) and d.name in ("td", "th") and not self.invisible(d):
                            while held.get(col, 0) > 0:
                                held[col] -= 1
                                col += 1
                            span, down = (number(d.attrs.get(k), 1, 1, 1000) for k in ("colspan", "rowspan"))
                            row.append((col, self.cell(d)))
                            for k in range(col, col + span):
                                held[k] = down - 1
                            col += span
                        elif isinstance(d, Node) and d.name not in ("td", "th"):
                            self.node(d)
                        elif isinstance(d, str):
                            self.text(d, False)
                    for k in held:
                        held[k] = held[k] - 1 if k >= col and held[k] > 0 else held[k]
                    rows.append(row)
                else:
                    self.node(c)

        walk(n)
        self.end_line()
        columns = sorted({c for row in rows for c, _ in row})
        width = {c: max((len(x) for row in rows for k, cell in row if k == c for x in cell), default=0) for c in columns}
        for row in rows:
            if not any(x for _, cell in row for x in cell):
                continue
            cells = dict(row)
            for i in range(max(len(cell) for _, cell in row)):
                parts = [(cells[c][i] if c in cells and i < len(cells[c]) else "").ljust(width[c]) for c in columns]
                if not self.line:
                    self.put("")
                self.line.append("  ".join(parts).rstrip())
                self.end_line()

    def finish(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


def visible_text(html: str | None) -> str | None:
    if html is None:
        return None
    root, hidden = parse(html)
    r = Renderer(hidden)
    r.children(root, False)
    return "\n".join(r.finish())


def _render(batches):
    for batch in batches:
        html = batch.column(batch.num_columns - 1).to_pylist()
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(map(visible_text, html), pa.string())], [*batch.schema.names[:-1], "text"])


def html_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of pages, with the visible text."""
    # the kept columns travel under names of their own
    own = [f"k{i}" for i in range(len(keep))]
    rows = pages.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)), F.col("html").cast("string").alias("html"))
    got = rows.mapInArrow(_render, T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())]))
    return got.select(*(F.col(k).alias("text_in" if c == "text" else c) for c, k in zip(keep, own, strict=True)), "text")
