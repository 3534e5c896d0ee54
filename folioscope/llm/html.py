"""Layout-aware text of HTML pages: a tree builder with implied tags, then a renderer of what is visible.

The builder reads tags and text in one pass, closes what the rules say is closed by a tag (a paragraph
by a block, a list item by the next, cells by cells and rows), ignores end tags that match nothing open,
and closes all at the end. The renderer leaves out what is not shown (head parts, scripts, styles, hidden
elements), collapses white space outside pre, sets blocks on lines of their own with blank lines round
paragraphs and headings, marks list items, and pads table cells so that columns stand in line.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import map_slices

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
#: Without one of these letters in a tag's attributes, none of them matters here.
_MATTERS = re.compile(r"hidden|style|start|type|span", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title noscript template iframe noembed noframes object audio video canvas datalist".split())
#: What may stand in a head; anything else, and text, begins the body.
HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main menu nav search section summary tr caption thead tbody tfoot option optgroup".split())
#: For a start tag: what it closes if open, and where the search for it stops.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset("td th tr thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("td th tr thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("td th tr thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
_CELL_STOP = frozenset(["table", "td", "th", "caption"])


def attributes(source: str) -> dict[str, str]:
    """Attributes by lower-case name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    if source and _MATTERS.search(source):
        for m in _ATTRIBUTE.finditer(source):
            out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, source: str = ""):
        self.tag, self.attributes, self.children = tag, attributes(source), []


def build(source: str) -> Node:
    """The tree of a page; children are nodes and strings with entities resolved."""
    root = Node("#root")
    stack, count = [root], Counter()

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        count[node.tag] += 1

    def pop(at: int) -> None:
        for node in stack[at:]:
            count[node.tag] -= 1
        del stack[at:]

    def close(names: frozenset, stop: frozenset) -> None:
        """Closes what is open of names, up to the next one of stop."""
        while any(count[n] for n in names):
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in stop:
                    return
                if stack[at].tag in names:
                    pop(at)
                    break
            else:
                return

    def add_text(text: str) -> None:
        if text:
            if count["head"] and not text.isspace():
                close(frozenset(["head"]), frozenset())
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            add_text(source[at:])
            break
        add_text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not count[tag]:
                if tag == "p":
                    stack[-1].children.append(Node("p"))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
                if stack[i].tag in _CELL_STOP and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html"):
                    break
            continue
        if count["head"] and tag not in HEAD:
            close(frozenset(["head"]), frozenset())
        if tag in BLOCK and tag not in ("html", "body", "option", "optgroup"):
            close(frozenset(["p"]), _CELL_STOP | {"button", "object"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag == "tr" and stack[-1].tag == "table":
            push(Node("tbody"))
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push(Node("tr"))
        node = Node(tag, m[3] or "")
        if tag in VOID or (m[3] or "").endswith("/") and (count["svg"] or count["math"] or tag in ("svg", "math")):
            stack[-1].children.append(node)
        elif tag in RAW:
            stack[-1].children.append(node)
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            text = source[at : stop.start()] if stop else source[at:]
            node.children.append(entities.unescape(text) if tag in ("textarea", "title") else text)
            at = stop.end() if stop else end
        else:
            push(node)
    return root


class _Lines:
    """Lines of text under way: pieces join with collapsed spaces, blocks ask for breaks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now = ""
        self.blank = False
        self.prefix = ""

    def text(self, text: str) -> None:
        words = text.split()
        if not words:
            if text and self.now and not self.now.endswith(" "):
                self.now += " "
            return
        if text[0].isspace() and self.now and not self.now.endswith(" "):
            self.now += " "
        self.now += " ".join(words) + (" " if text[-1].isspace() else "")

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(line)

    def end(self, force: bool = False) -> None:
        line = self.now.rstrip()
        self.now = ""
        if line:
            self.put(line)
        elif force and self.lines and not self.blank:
            self.lines.append("")

    def space(self) -> None:
        self.end()
        self.blank = True


def _shown(node: Node, inherited: bool) -> bool | None:
    """Whether a node's own text is visible; None if nothing below it is displayed."""
    if node.tag in UNSEEN:
        return None
    a = node.attributes
    if not a:
        return inherited
    if "hidden" in a or node.tag == "input" and a.get("type", "").strip().lower() == "hidden":
        return None
    for rule in a.get("style", "").lower().split(";"):
        name, _, value = rule.partition(":")
        name, value = name.strip(), value.replace("!important", "").strip()
        if name == "display" and value == "none":
            return None
        if name == "visibility":
            inherited = value not in ("hidden", "collapse")
    return inherited


def _number(text: str | None, least: int, most: int, otherwise: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return min(most, max(least, int(m[1]))) if m else otherwise


def _run(task: Generator) -> None:
    """Runs a task that yields its sub-tasks: depth is a list here, not the call stack."""
    todo = [task]
    while todo:
        try:
            todo.append(next(todo[-1]))
        except StopIteration:
            todo.pop()


def _render(node: Node, out: _Lines, shown: bool) -> Generator:
    number = _number(node.attributes.get("start"), -(10**9), 10**9, 1) if node.tag == "ol" else 1
    for child in node.children:
        if isinstance(child, str):
            if shown:
                out.text(child)
            continue
        seen = _shown(child, shown)
        if seen is None:
            continue
        tag = child.tag
        if tag == "br":
            out.end(force=True)
        elif tag == "hr":
            out.space()
        elif tag == "table":
            out.space()
            yield _table(child, out, seen)
            out.space()
        elif tag == "pre":
            out.space()
            for line in _plain(child, seen).strip("\n").split("\n"):
                out.put(line.rstrip())
            out.space()
        elif tag == "li":
            out.end()
            inner = _Lines()
            yield _render(child, inner, seen)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            for i, line in enumerate(_finish(inner)):
                out.put((mark if not i else " " * len(mark)) + line if line else "")
        elif tag in BLOCK:
            spaced = tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li")
            out.space() if spaced else out.end()
            yield _render(child, out, seen)
            out.space() if spaced else out.end()
        else:
            yield _render(child, out, seen)


def _plain(node: Node, shown: bool) -> str:
    parts: list[str] = []
    todo: list[tuple] = [(node, shown)]
    while todo:
        x, seen = todo.pop()
        if isinstance(x, str):
            if seen:
                parts.append(x)
            continue
        below = seen if x is node else _shown(x, seen)
        if below is not None:
            if x.tag == "br":
                parts.append("\n")
            todo += [(c, below) for c in reversed(x.children)]
    return "".join(parts)


def _table(table: Node, out: _Lines, shown: bool) -> Generator:
    """Rows of cells on a grid: a cell may span columns and rows; what stands loose in a table goes before it."""
    rows: list[dict[int, tuple[int, str]]] = []
    taken: dict[int, int] = {}
    todo = [(c, shown) for c in reversed(table.children)]
    while todo:
        x, above = todo.pop()
        if isinstance(x, str):
            if x.strip() and above:
                out.text(x)
                out.end()
            continue
        seen = _shown(x, above)
        if seen is None:
            continue
        if x.tag in ("thead", "tbody", "tfoot"):
            taken = {}
            todo += [(c, seen) for c in reversed(x.children)]
        elif x.tag == "tr":
            row, at = {}, 0
            for c in x.children:
                if isinstance(c, str):
                    if c.strip() and seen:
                        out.text(c)
                        out.end()
                    continue
                inside = _shown(c, seen)
                if inside is None:
                    continue
                while taken.get(at):
                    at += 1
                inner = _Lines()
                yield _render(c, inner, inside)
                span = _number(c.attributes.get("colspan"), 1, 1000, 1)
                row[at] = span, " ".join(line.strip() for line in _finish(inner) if line.strip())
                down = _number(c.attributes.get("rowspan"), 0, 65534, 1) or 65534
                for i in range(at, at + span):
                    taken[i] = down
                at += span
            taken = {i: n - 1 for i, n in taken.items() if n > 1}
            rows.append(row)
        elif x.tag == "caption" or x.tag not in ("colgroup", "col"):
            yield _render(x, out, seen)
            out.end()
    width = [0] * max((at + span for r in rows for at, (span, _) in r.items()), default=0)
    for spans in (1, 2):  # cells of one column first, then what wider ones need beyond them
        for r in rows:
            for at, (span, text) in r.items():
                if span == 1 if spans == 1 else span > 1:
                    have = sum(width[at : at + span]) + 3 * (span - 1)
                    width[at + span - 1] += max(0, len(text) - have)
    for r in rows:
        cells, at = [], 0
        while at < len(width):
            span, text = r.get(at, (1, ""))
            cells.append(text.ljust(sum(width[at : at + span]) + 3 * (span - 1)))
            at += span
        while cells and not cells[-1].strip():
            cells.pop()
        if cells:
            out.put(" | ".join(cells).rstrip())


def _finish(out: _Lines) -> list[str]:
    out.end()
    while out.lines and not out.lines[-1]:
        out.lines.pop()
    return out.lines


def render(source: str | None) -> str:
    """All visible text of a page; '' for null, empty or textless pages."""
    if not source:
        return ""
    out = _Lines()
    _run(_render(build(source), out, True))
    return "\n".join(_finish(out))


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """key, text of every page: one row per input row, whatever its key; other columns do not matter."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([part.column(0), pa.array([render(x) for x in part.column(1).to_pylist()], pa.string())], ["key", "text"])

    rows = pages.select(pages[key].alias("key"), pages[source].alias("source"))
    return map_slices(rows, run, f"key {pages.schema[key].dataType.simpleString()}, text string", "html").withColumnRenamed("key", key)
