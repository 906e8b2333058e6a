"""HTML to visible text, laid out.

A scanner cuts markup into tags, comments and text in one pass. A tree builder closes implied tags (items, cells, rows, options,
terms, headings, paragraphs before blocks, a head at the first thing that can't be in one), opens rows that cells lack, and puts what stands in a table
outside of cells and captions before it. Visibility rules drop what is never shown: elements that browsers don't display, `hidden`,
`display: none`, and the content of `visibility: hidden` but for what is `visible` again. The renderer walks the tree without recursion:
blocks stand apart (paragraphs, headings, lists, tables and quotations by an empty line, other blocks by a line break), list items are marked or
numbered and indented by depth, preformatted text keeps its blanks, and table cells are padded to columns, with spans and cells of several lines.

Time grows with the length of a page: no tag looks at more of the open elements than it closes. Two layouts give way before they could multiply a
page: lists indent no further than ``DEEPEST`` levels, and tables inside more than ``NESTED`` tables, with wide cells before the last one
of a row (``WIDE``), or that would be nearly all blanks (``BLOWN``) give a cell a block instead of a column. No text is lost by either.

Defined cases: null or empty html gives an empty text; broken markup never fails: unclosed elements end with the document, declarations in
brackets are comments, and a tag or comment that never ends takes the rest with it, as in browsers; text of images is their alt text; rows that
repeat render alike; an empty table gives no rows; other columns are not touched, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import common

VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
UNSEEN = set(
    "area audio base basefont canvas datalist embed head iframe link meta noembed noframes noscript object param rp script source style template title track video".split()
)
#: Elements whose content is no markup: without and with character references.
RAW, TEXT = set("script style xmp iframe noembed noframes noscript".split()), {"title", "textarea"}
#: Blocks by an empty line, and by a line break.
APART = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp listing".split())
BLOCK = APART | set("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary".split())
#: Blocks that end an open paragraph.
ENDS_P = BLOCK - {"body", "html", "legend", "optgroup", "option"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an element ends if it is open, and what that may not lie beyond.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)), "button": (("button",), ()),
}
#: Parts of a table, those that hold parts only, and those that hold content.
SECTIONS, CELLS = {"tbody", "thead", "tfoot"}, {"td", "th"}
PARTS = SECTIONS | CELLS | {"caption", "colgroup", "col", "tr"}
FRAME, HOLDS = SECTIONS | {"table", "tr", "colgroup"}, ("td", "th", "caption")
#: What may stand in a head; anything else ends it.
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: Layout: levels of indentation, aligned tables in one another, widest cell before a row's last, blanks a character of a table's text.
DEEPEST, NESTED, WIDE, BLOWN = 20, 4, 120, 64

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
ATTR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
NEEDED = {"alt", "colspan", "hidden", "open", "rowspan", "start", "style", "value"}
USEFUL = re.compile("|".join(sorted(NEEDED)), re.I)
STYLE = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([a-z-]+)")
NOTE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
BLANKS = re.compile(r"[ \t\n\r\f]+")
NOTE_END = re.compile(r"--!?>")
ENDINGS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW | TEXT}


def scan(html: str) -> Iterator[tuple[str, str, dict]]:
    """("text", what, {}), ("start", name, attributes) and ("end", name, {}) in order; comments and declarations are left out."""
    at, size = 0, len(html)
    while at < size:
        low = html.find("<", at)
        if low < 0:
            low = size
        if low > at:
            yield "text", unescape(html[at:low]), {}
        if low >= size:
            return
        after = html[low + 1 : low + 2]
        if after.isascii() and after.isalpha() or after == "/" and html[low + 2 : low + 3].isascii() and html[low + 2 : low + 3].isalpha():
            found = TAG.match(html, low)
            if found is None:  # it never ends
                return
            at, name = found.end(), found[2].lower()
            if found[1]:
                yield "end", name, {}
                continue
            yield "start", name, attributes(found[3])
            if name in ENDINGS:
                stop = ENDINGS[name].search(html, at)
                until = stop.start() if stop else size
                if until > at:
                    inner = html[at:until]
                    yield "text", unescape(inner) if name in TEXT else inner, {}
                at = until
            elif name == "plaintext":
                yield "text", html[at:], {}
                return
        elif after == "!" and html.startswith("--", low + 2):
            if html.startswith((">", "->"), low + 4):
                at = html.index(">", low + 4) + 1
                continue
            stop = NOTE_END.search(html, low + 4)
            if stop is None:
                return
            at = stop.end()
        elif after in ("!", "?", "/") and after:
            if html.startswith("</>", low):
                at = low + 3
                continue
            stop = html.find(">", low) if after != "/" or low + 2 < size else -2
            if stop == -1:
                return
            if stop == -2:
                yield "text", "</", {}
                return
            at = stop + 1
        else:
            yield "text", "<", {}
            at = low + 1


def attributes(raw: str) -> dict[str, str]:
    """Those that layout needs; the first of a name counts."""
    out: dict[str, str] = {}
    if raw and USEFUL.search(raw):
        for found in ATTR.finditer(raw):
            name = found[1].lower()
            if name in NEEDED and name not in out:
                value = found[2] or ""
                out[name] = unescape(value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0] else value)
    return out


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class Builder:
    """The tree. ``where`` has the places of every open element by name, so nothing is looked for along the open ones."""

    def __init__(self):
        self.root = Node("#root", {})
        self.open, self.where, self.begun = [self.root], {}, False

    def last(self, *names: str) -> int:
        """Where the innermost open element of these names is; 0 if none is."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def cut(self, at: int) -> None:
        """Close everything from this place on."""
        while len(self.open) > at:
            self.where[self.open.pop().tag].pop()

    def end_open(self, names: tuple, beyond: tuple) -> None:
        at = self.last(*names)
        if at and at > self.last("table", "template", *HOLDS, *beyond):
            self.cut(at)

    def put(self, kid: Node | str, shown: bool = True) -> None:
        """Into the open element; what is shown and no part goes before the table instead of straight into it."""
        if shown and self.open[-1].tag in FRAME:
            before = self.open[self.last("table") - 1].kids
            before.insert(len(before) - 1, kid)  # an open table is its holder's last kid
        else:
            self.open[-1].kids.append(kid)

    def start(self, tag: str, attrs: dict) -> None:
        if tag == "html" or tag == "head" and self.begun:
            return
        self.begun = True
        if self.open[-1].tag == "head" and tag not in HEAD:
            self.cut(len(self.open) - 1)
        if tag == "body" and self.where.get("body"):
            return
        if tag in PARTS:
            self.part(tag, attrs)
            return
        if self.open[-1].tag in FRAME:
            if tag == "form":
                return  # holds nothing there
            if tag == "table":
                self.cut(self.last("table"))
        if tag in ENDS_P:
            self.end_open(("p",), ("button",))
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.cut(len(self.open) - 1)
        node = Node(tag, attrs)
        self.put(node, tag not in ("script", "style", "template"))
        if tag not in VOID:
            self.push(node)

    def part(self, tag: str, attrs: dict) -> None:
        """A part of the innermost table, whatever is open in it; outside of tables it is no element."""
        table = self.last("table")
        if not table or tag == "col" or self.last("template") > table:
            return
        keep = table + 1
        for kinds in (SECTIONS, {"tr"}) if tag in CELLS else (SECTIONS,) if tag == "tr" else ():
            keep += keep < len(self.open) and self.open[keep].tag in kinds
        self.cut(keep)
        for name in ("tr", tag) if tag in CELLS and self.open[-1].tag != "tr" else (tag,):
            node = Node(name, attrs if name == tag else {})
            self.open[-1].kids.append(node)
            self.push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.put(Node("br", {}))
            return
        names = tuple(HEADINGS) if tag in HEADINGS else (tag,)
        beyond = () if tag == "table" else ("table",) if tag in PARTS or tag in ("body", "html") else ("table", *HOLDS)
        at = self.last(*names)
        if at and (tag in ("template", *beyond) or at > self.last("template", *beyond)):  # a table's content doesn't end what is around it
            self.cut(at)

    def text(self, data: str) -> None:
        data = data.replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")
        if not data:
            return
        here = self.open[-1]
        if here.tag in ("pre", "listing", "textarea") and not here.kids and data[0] == "\n":
            data = data[1:]
        shown = bool(data.strip(" \t\n\f"))
        if shown and here.tag not in RAW | TEXT:
            self.begun = True
            if here.tag == "head":
                self.cut(len(self.open) - 1)
        self.put(data, shown and here.tag not in ("script", "style", "template"))


def tree(html: str) -> Node:
    builder = Builder()
    for kind, what, attrs in scan(html):
        if kind == "text":
            builder.text(what)
        elif kind == "start":
            builder.start(what, attrs)
        else:
            builder.end(what)
    return builder.root


class Lines:
    """Lines of a page or of a cell: inline text is collected until a block or a break ends its line."""

    def __init__(self, cell: bool = False):
        self.out: list[str] = []
        self.cell, self.line, self.blank, self.gap, self.hard = cell, [], True, False, False
        self.marks: list[str] = []
        self.marked = 0  # how many open items have shown their mark

    def add(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.split("\n")
            self.line.append(first)
            self.hard |= bool(first)
            for part in more:
                self.hard = True
                self.flush()
                self.line.append(part)
                self.hard = bool(part)
            self.blank = False
            return
        text = BLANKS.sub(" ", text)
        if self.blank and text[:1] == " ":
            text = text[1:]
        if text:
            self.line.append(text)
            self.blank = text[-1] == " "

    def flush(self) -> None:
        """End the line, if anything is in it."""
        text = "".join(self.line)
        if not self.hard:
            text = text.rstrip(" ")
        if text or self.hard:
            self.emit(text.rstrip(" \t") if self.hard and not text.strip() else text)
        self.line, self.blank, self.hard = [], True, False

    def emit(self, text: str) -> None:
        if self.gap and self.out:
            self.out.append("")
        self.gap = False
        if not text:
            self.out.append("")
            return
        lead = "  " * min(self.marked, DEEPEST) + "".join(self.marks[self.marked :])
        self.marked = len(self.marks)
        self.out.append(lead + text)

    def block(self, apart: bool) -> None:
        self.flush()
        self.gap |= apart and not self.marks and not self.cell

    def broken(self) -> None:
        if "".join(self.line).strip():
            self.flush()
        elif self.out and not self.cell and not self.marks and self.out[-1]:
            self.line, self.blank, self.gap = [], True, True

    def done(self) -> list[str]:
        self.flush()
        return [x for x in self.out if x] if self.cell else self.out


class Table:
    def __init__(self):
        self.captions: list[str] = []
        self.rows: list[list[tuple[int, int, list[str]]]] = []

    def lines(self) -> list[str]:
        """Rows of (span over columns, span over rows, lines of the cell), padded to columns."""
        placed, held = [], {}  # held: column to (columns, rows it still fills)
        for row in self.rows:
            at, cells, later = 0, [], {c: (w, n - 1) for c, (w, n) in held.items() if n > 1}
            for wide, deep, text in row:
                while at in held:
                    at += held[at][0]
                cells.append((at, wide, text))
                if deep > 1:
                    later[at] = (wide, deep - 1)
                at += wide
            placed.append(cells)
            held = later
        if any(len(x) > WIDE for cells in placed for _, _, text in cells[:-1] for x in text):
            return [*self.captions, *(x for cells in placed for _, _, text in cells for x in text)]
        columns = sorted({at for cells in placed for at, _, _ in cells})
        width = dict.fromkeys(columns, 0)
        spans = []
        for cells in placed:
            for at, wide, text in cells[:-1]:
                longest = max(map(len, text), default=0)
                if wide == 1:
                    width[at] = max(width[at], longest)
                else:
                    spans.append((at, wide, longest))
        for at, wide, longest in spans:
            own = columns[bisect_left(columns, at) : bisect_left(columns, at + wide)]
            width[own[-1]] += max(0, longest - sum(width[c] for c in own) - 2 * (len(own) - 1))
        left, x = {}, 0
        for c in columns:
            left[c] = x
            x += width[c] + 2
        out = list(self.captions)
        size = sum(max(len(text) for _, _, text in cells) * left[cells[-1][0]] for cells in placed if cells)
        if size > BLOWN * (1000 + sum(len(x) for cells in placed for _, _, text in cells for x in text)):
            return [*out, *(x for cells in placed for _, _, text in cells for x in text)]
        for cells in placed:
            for k in range(max((len(text) for _, _, text in cells), default=0)):
                line, end = [], 0
                for at, _, text in cells:
                    if k < len(text):
                        line += [" " * (left[at] - end), text[k]]
                        end = max(left[at], end) + len(text[k])
                out.append("".join(line).rstrip(" "))
        return out


def number(raw: str | None, usual: int, most: int = 10**9) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", raw or "")
    return max(-most, min(most, int(found[1]))) if found else usual


def look(attrs: dict) -> tuple[str | None, str | None, str | None]:
    """display, visibility and white-space that an element's own style sets; of several the last counts."""
    style = attrs.get("style")
    found = dict(STYLE.findall(NOTE.sub("", style).lower())) if style else {}
    display = found.get("display") or ("none" if "hidden" in attrs else None)
    return display, found.get("visibility"), found.get("white-space")


def lay_out(root: Node) -> list[str]:
    """Lines of the tree. The walk holds, for each open element, what its end has to do."""
    page = Lines()
    outs: list[Lines] = [page]
    tables: list[Table] = []
    #: kids still to come, tag, visible, preformatted, next number of an ordered list (None: unnumbered), as a block by style
    stack: list[list] = [[iter(root.kids), "#root", True, False, None, False]]
    while stack:
        kids, tag, visible, pre, _, styled = stack[-1]
        out = outs[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            if tag == "li":
                out.flush()
                out.marks.pop()
                out.marked = min(out.marked, len(out.marks))
            elif tag == "table":
                out.block(True)
                own = tables.pop()
                for line in own.lines():
                    out.emit(line)
                out.block(True)
            elif tag in ("td", "th", "caption") and tables:
                if len(tables) <= NESTED:
                    outs.pop()
                    done = out.done()
                    if tag == "caption":
                        tables[-1].captions += done
                    else:
                        tables[-1].rows[-1][-1][2].extend(done)
                else:
                    out.block(False)
            elif tag in BLOCK or styled:
                out.block(tag in APART and not (tag in ("ul", "ol", "menu") and bool(out.marks)))
            continue
        if isinstance(kid, str):
            if visible and tag not in FRAME:
                out.add(kid, pre)
            continue
        name = kid.tag
        display, visibility, space = look(kid.attrs)
        if display == "none" or (name in UNSEEN and display is None) or name == "dialog" and "open" not in kid.attrs and display is None:
            continue
        seen = visible if visibility not in ("visible", "hidden", "collapse") else visibility == "visible"
        kept = space.startswith("pre") if space else pre or name in ("pre", "textarea", "listing", "xmp", "plaintext")
        styled = display in ("block", "flex", "grid", "flow-root", "list-item")
        if name == "br":
            out.broken()
            continue
        if name == "wbr":
            continue
        if name == "img":
            if seen and kid.attrs.get("alt"):
                out.add(kid.attrs["alt"], False)
            continue
        count = None
        if name == "table":
            out.block(True)
            tables.append(Table())
        elif name == "tr" and tables:
            tables[-1].rows.append([])
        elif name in ("td", "th", "caption") and tables:
            if len(tables) <= NESTED:
                if name != "caption":
                    if not tables[-1].rows:
                        tables[-1].rows.append([])
                    deep = number(kid.attrs.get("rowspan"), 1, 65534)
                    tables[-1].rows[-1].append((max(1, number(kid.attrs.get("colspan"), 1, 1000)), deep if deep > 0 else 65534 if deep == 0 else 1, []))
                outs.append(Lines(True))
            else:
                out.block(False)
        elif name == "li":
            out.flush()
            holder = stack[-1]
            if holder[4] is not None:
                value = number(kid.attrs.get("value"), holder[4])
                holder[4] = value + 1
                out.marks.append(f"{value}. " if seen else "")
            else:
                out.marks.append("- " if seen else "")
        elif name in BLOCK or styled:
            if name == "ol":
                count = number(kid.attrs.get("start"), 1)
            out.block(name in APART and not (name in ("ul", "ol", "menu") and bool(out.marks)))
        stack.append([iter(kid.kids), name, seen, kept, count, styled])
    return page.done()


def render(html: str | None) -> str:
    return "\n".join(lay_out(tree(html))).strip("\n") if html else ""


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(render, batch.column("html").to_pylist()), pa.string())], names=["key", "text"])


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and text of every page."""
    read = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return read.mapInArrow(common.sparing(_render), f"key {dict(read.dtypes)['key']}, text string").withColumnRenamed("key", key)


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
