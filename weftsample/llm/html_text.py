"""HTML extraction by layout: a tree builder with implied tags, visibility rules, a renderer."""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, table, whole_text

# Element names by what they do, as the HTML standard lists them.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INVISIBLE = frozenset(
    "script style title head template noscript iframe noembed noframes audio video "
    "canvas datalist meta link base param source track annotation annotation-xml".split()
)
#: Parts of a drawing that are not drawn where they stand.
UNDRAWN = frozenset(
    "desc defs metadata symbol clippath mask pattern marker filter lineargradient "
    "radialgradient".split()
)
#: Foreign elements, in which an empty element may end itself, and those that lead back.
FOREIGN, INTEGRATED = frozenset({"svg", "math"}), frozenset({"foreignobject", "annotation-xml"})
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol p pre search section summary table tbody tfoot thead tr td th caption ul".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset".split())
#: Start tags that end an open ``p``.
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption dd dt legend".split())
#: Start tag: open elements that it ends, and the elements this does not reach beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: End tags do not reach beyond these.
SCOPES = frozenset("table td th caption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|\"|')*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b")
#: Kinds of input whose value a page does not show as text.
WITHOUT_TEXT = frozenset("hidden checkbox radio password file image range color".split())
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # fixed values: the spans that the HTML standard allows
_SPACE = re.compile(r"[ \t\n\r\f]+")


def parse(page: str):
    """Events of the tree: ``(+1, name, attributes)``, ``(0, text, None)``, ``(-1, name, None)``.

    Missing end tags are implied, end tags without a start are dropped, and all
    that is open is closed at the end; so starts and ends are always balanced.
    """
    stack: list[str] = []
    open_: Counter[str] = Counter()
    at, size, last_tag = 0, len(page), page.rfind(">")

    def close_to(depth: int):
        while len(stack) > depth:
            open_[stack[-1]] -= 1
            yield -1, stack.pop(), None

    def depth_of(names, limits) -> int | None:
        found = None
        if not any(open_[n] for n in names):
            return None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in limits:
                break
            if stack[k] in names:
                found = k
        return found

    def foreign() -> bool:
        if not (open_["svg"] or open_["math"]):
            return False
        return next(n for n in reversed(stack) if n in FOREIGN or n in INTEGRATED) in FOREIGN

    while at < size:
        token = _TOKEN.search(page, at) if at <= last_tag or "<!" in page[at:] else None
        if not token:
            yield 0, html.unescape(page[at:]), None
            break
        if token.start() > at:
            yield 0, html.unescape(page[at : token.start()]), None
        at = token.end()
        name = (token.group(2) or "").lower()
        if not name:
            continue
        if token.group(1):
            for k in range(len(stack) - 1, -1, -1) if open_[name] else ():
                if stack[k] == name:
                    yield from close_to(k)
                    break
                if stack[k] in SCOPES and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if name in CLOSES_P and (k := depth_of({"p"}, SCOPES)) is not None:
            yield from close_to(k)
        if name in IMPLIED and (k := depth_of(*IMPLIED[name])) is not None:
            yield from close_to(k)
        if name in ("td", "th") and open_["table"] and depth_of({"tr"}, {"table"}) is None:
            stack.append("tr")
            open_["tr"] += 1
            yield 1, "tr", ""
        yield 1, name, token.group(3)
        if name in VOID or token.group(3).endswith("/") and (name in FOREIGN or foreign()):
            yield -1, name, None
        elif name in RAW:
            end = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            stop = end.start() if end else size
            text = page[at:stop]
            if name == "textarea":
                text = html.unescape(re.sub(r"\A(?:\r\n|\r|\n)", "", text))
            yield 0, text, None
            yield -1, name, None
            at = page.find(">", stop) + 1 or size
        else:
            stack.append(name)
            open_[name] += 1
    yield from close_to(0)


def hidden(name: str, attributes: str) -> bool:
    """Elements that a page does not show.

    What stands in an ``object`` with data is for browsers that cannot show the data.
    """
    if name in INVISIBLE or (name == "dialog" and "open" not in _values(attributes)):
        return True
    if not attributes or attributes.isspace():
        return False
    if name == "object" and _values(attributes).get("data"):
        return True
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).strip().lower()
        if key == "hidden" and value != "until-found":
            return True
        if key == "style" and _HIDING.search(html.unescape(value)):
            return True
    return False


def visibility(attributes: str | None) -> bool | None:
    """Whether an element says that it is visible or hidden; None where it inherits that."""
    if not attributes or "visibility" not in attributes.lower():
        return None
    found = _VISIBILITY.findall(_values(attributes).get("style", "").lower())
    return found[-1] == "visible" if found else None


def _span(own: dict[str, str], name: str, most: int) -> int:
    value = own.get(name, "").strip()
    return min(int(value[:9]), most) if value.isdecimal() else 1


def list_sizes(page: str) -> list[int]:
    """Items of each list of a page, in the order of the lists."""
    sizes, inside = [], []
    for kind, name, _ in parse(page):
        if name in ("ul", "ol", "menu", "dir") and kind > 0:
            inside.append(len(sizes))
            sizes.append(0)
        elif name in ("ul", "ol", "menu", "dir") and kind < 0:
            inside.pop()
        elif name == "li" and kind > 0 and inside:
            sizes[inside[-1]] += 1
    return sizes


def _values(attributes: str | None) -> dict[str, str]:
    """Values of attributes by their names in lower case; of repeated ones the first counts."""
    found = reversed(_ATTRIBUTE.findall(attributes or ""))
    return {key.lower(): html.unescape("".join(values)) for key, *values in found}


class _Block:
    """Lines of a block under construction, and the line that is being written."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.prefix = ""

    def write(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.line.append(first)
            for part in rest:
                self.end_line(True)
                self.line.append(part)
            return
        for k, part in enumerate(_SPACE.split(text)):
            if k:
                self.space = True
            if part:
                if self.space and self.line:
                    self.line.append(" ")
                self.space = False
                self.line.append(part)

    def end_line(self, always: bool = False) -> None:
        text = "".join(self.line).rstrip()
        self.line, self.space = [], False
        if text or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.prefix + text if text or self.prefix else "")
            if self.prefix.strip():
                self.prefix = " " * len(self.prefix)

    def add(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self.line = [line]
            self.end_line(True)


class _Table:
    """Cells by row and column; ``down`` tells up to which row a column is taken from above."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, _Block]]] = []
        self.caption: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.down: dict[int, int] = {}

    def open_cell(self, attributes: str) -> None:
        own = _values(attributes)
        self.spans.append(
            (max(_span(own, "colspan", MOST_COLUMNS), 1), _span(own, "rowspan", MOST_ROWS))
        )

    def add_cell(self, cell: _Block) -> None:
        """Put a cell into the first free columns of the last row; a span of 0 rows is all."""
        if not self.rows:
            self.rows.append([])
        wide, high = self.spans.pop()
        row, at = len(self.rows) - 1, 0
        if self.rows[-1]:
            at = self.rows[-1][-1][0] + self.rows[-1][-1][1]
        while self.down.get(at, -1) >= row:
            at += 1
        self.rows[-1].append((at, wide, cell))
        if high != 1:
            last = row + (high or MOST_ROWS) - 1
            self.down.update((k, last) for k in range(at, at + wide))

    def lines(self) -> list[str]:
        """Rows with their cells at their columns; a row is as high as its highest cell.

        A row with a single cell at its start does not widen a column.  A column
        in which no cell begins takes no room.
        """
        rows = [[(at, wide, c.lines or [""]) for at, wide, c in row] for row in self.rows]
        rows = [row for row in rows if any(any(cell) for _, _, cell in row)]
        places = {at: k for k, at in enumerate(sorted({at for row in rows for at, _, _ in row}))}
        widths = [0] * len(places)
        several = [row for row in rows if len(row) > 1 or row[0][0]]
        beyond = []
        for row in several:
            for at, wide, cell in row:
                first = places[at]
                last = max((places[k] for k in range(at, at + wide) if k in places), default=first)
                size = max(map(len, cell))
                if first == last:
                    widths[first] = max(widths[first], size)
                else:
                    beyond.append((first, last, size))
        for first, last, size in sorted(beyond):
            lacking = size - sum(widths[first : last + 1]) - 2 * (last - first)
            widths[last] += max(lacking, 0)
        begins = [sum(widths[:k]) + 2 * k for k in range(len(widths))] if several else [0]
        out = list(self.caption)
        for row in rows:
            for k in range(max(len(cell) for _, _, cell in row)):
                line = ""
                for at, _, cell in row:
                    if k < len(cell) and cell[k]:
                        line = line.ljust(begins[places[at]]) + cell[k]
                out.append(line.rstrip())
        return out


class _Select:
    """Options of a list: a closed one shows the chosen option, an open one shows all."""

    def __init__(self, attributes: str) -> None:
        own = _values(attributes)
        size = own.get("size", "").strip()
        self.open = "multiple" in own or size.isdecimal() and int(size) > 1
        self.options: list[tuple[dict[str, str], str]] = []

    def lines(self) -> list[str]:
        texts = [own.get("label") or text for own, text in self.options]
        if self.open:
            return texts
        chosen = [k for k, (own, _) in enumerate(self.options) if "selected" in own][-1:]
        usable = [k for k, (own, _) in enumerate(self.options) if "disabled" not in own]
        return [texts[k] for k in chosen or usable[:1]]


class _Inset:
    """Drawings and lists: elements in which only the text of some elements is shown."""

    def __init__(self) -> None:
        self.shown: list[tuple[str, bool]] = []
        self.selects: list[_Select] = []
        self.chosen: list[dict[str, str]] = []

    def hides(self) -> bool:
        """True where text by itself is not shown."""
        return bool(self.shown) and not self.shown[-1][1]

    def undrawn(self, name: str) -> bool:
        return name in UNDRAWN and any(n == "svg" for n, _ in self.shown)

    def start(self, name: str, attributes: str, blocks: list[_Block]) -> None:
        inside = self.shown[-1][0] if self.shown else ""
        if name in ("svg", "select"):
            self.shown.append((name, False))
            if name == "select":
                self.selects.append(_Select(attributes))
        elif inside == "svg" and name in ("text", "foreignobject"):
            self.shown.append((name, True))
            blocks[-1].space = True
        elif inside == "text" and name == "tspan" and _values(attributes).keys() & {"x", "y", "dy"}:
            blocks[-1].space = True
        elif inside == "select" and name == "option":
            self.shown.append((name, True))
            self.chosen.append(_values(attributes))
            blocks.append(_Block())

    def end(self, name: str, blocks: list[_Block]) -> None:
        if not self.shown or self.shown[-1][0] != name:
            return
        self.shown.pop()
        if name == "option":
            option = blocks.pop()
            option.end_line()
            self.selects[-1].options.append((self.chosen.pop(), " ".join(option.lines)))
        elif name == "select":
            select = self.selects.pop()
            if select.open:
                blocks[-1].add(select.lines())
            else:
                blocks[-1].write(f" {' '.join(select.lines())} ")
        else:
            blocks[-1].space = True


def render(page: str) -> str:
    """All visible text of a page, laid out.

    White space collapses except in ``pre``; paragraphs, headings, lists and
    tables stand apart by an empty line; list items have bullets or numbers and
    are indented by depth; table cells are aligned in columns, beside cells that
    span rows and below those that span columns.  Formulas, the labels of
    drawings and buttons, the preset text of fields and the options that a list
    shows are part of it.  Text is visible again inside a hidden element that sets
    its visibility back, but not in one that is not displayed.  A page without visible text is the empty string.
    """
    blocks, tables, lists, dark, pre = [_Block()], [], [], 0, 0
    inset, shown = _Inset(), [True]
    sizes = iter(list_sizes(page) if "reversed" in page.lower() else ())
    for kind, value, attributes in parse(page):
        if kind > 0:
            items = next(sizes, 0) if value in ("ul", "ol", "menu", "dir") else 0
            if dark or hidden(value, attributes) or inset.undrawn(value):
                dark += 1
                continue
            own = visibility(attributes)
            shown.append(shown[-1] if own is None else own)
            inset.start(value, attributes, blocks)
            if shown[-1] or value not in ("hr", "input"):
                _start(value, attributes, blocks, tables, lists, items)
            pre += value in ("pre", "textarea")
        elif kind < 0:
            if dark:
                dark -= 1
                continue
            shown.pop()
            pre -= value in ("pre", "textarea")
            _end(value, blocks, tables, lists)
            inset.end(value, blocks)
        elif not dark and shown[-1] and not inset.hides():
            blocks[-1].write(value, pre > 0)
    blocks[0].end_line()
    return "\n".join(blocks[0].lines).strip("\n")


def _start(name, attributes, blocks, tables, lists, items) -> None:
    block = blocks[-1]
    if name == "br":
        block.end_line(True)
    elif name in BLOCK or name == "textarea":
        block.end_line()
        if name in SPACED and not (name in ("ul", "ol") and lists):
            block.gap = True
    if name == "hr":
        block.add(["---"])
    elif name in ("ul", "ol", "menu", "dir"):
        own = _values(attributes)
        step = -1 if name == "ol" and "reversed" in own else 1
        lists.append([name, _number(own.get("start"), items if step < 0 else 1), step])
    elif name == "li":
        own = lists[-1] if lists else ["ul", 1, 1]
        own[1] = _number(_values(attributes).get("value"), own[1])
        mark = f"{own[1]}. " if own[0] == "ol" else "- "
        own[1] += own[2]
        block.prefix = "  " * max(0, len(lists) - 1) + mark
    elif name == "input":
        own = _values(attributes)
        if own.get("value", "").strip() and own.get("type", "").lower() not in WITHOUT_TEXT:
            block.write(f" {own['value']} ")
    elif name == "dd":
        block.prefix = "    "
    elif name == "table":
        tables.append(_Table())
    elif tables and name == "tr":
        tables[-1].rows.append([])
    elif tables and name in ("thead", "tbody", "tfoot"):
        tables[-1].down.clear()  # no cell spans rows of another group
    elif tables and name in ("td", "th", "caption"):
        blocks.append(_Block())
        if name != "caption":
            tables[-1].open_cell(attributes)


def _number(text: str | None, otherwise: int) -> int:
    found = re.match(r"\s*([+-]?[0-9]{1,9})", text or "")
    return int(found.group(1)) if found else otherwise


def _end(name, blocks, tables, lists) -> None:
    block = blocks[-1]
    if name in BLOCK or name == "textarea":
        block.end_line()
        if name in SPACED and not (name in ("ul", "ol") and len(lists) > 1):
            block.gap = True
    if name in ("ul", "ol", "menu", "dir") and lists:
        lists.pop()
        block.prefix = ""
    elif name in ("li", "dd"):
        block.prefix = ""
    elif name == "table" and tables:
        block.add(tables.pop().lines())
        block.gap = True
    elif tables and name in ("td", "th", "caption") and len(blocks) > 1:
        cell = blocks.pop()
        if name == "caption":
            tables[-1].caption += cell.lines
        else:
            tables[-1].add_cell(cell)


@F.pandas_udf(T.StringType())
def _rendered(pages: pd.Series) -> pd.Series:
    return pages.map(render)


def page_texts(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id``, ``text``: the visible text of each whole page; a null page has none.

    Rows are rendered each; other columns are not read.  Pages are never cut,
    however deep their elements are nested.
    """
    return pages.select(column(id_col).alias("id"), _rendered(whole_text(html_col)).alias("text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_texts(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("id").alias("page_id"), "text", F.length("text").cast("bigint").alias("n_chars")
    )
