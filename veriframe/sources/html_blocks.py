"""HTML pages as rows of leaf blocks; what the blocks mean is decided in Spark.

A task reads a page tag by tag and keeps one flat state: the open elements with
marks into the lists of texts, cells and blocks so far.  When an element ends, its marks say what it was: a table, a block that held
no further block, or something to be looked through.  Nothing recurses and no
list is copied, so depth costs no more than length.  Heading rules, table
collapsing and line numbering are Column expressions in ``corpus``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa

from .html_tokens import attributes, tokens

#: Fixed: elements that make a block, that never hold content, and that a new block ends.
BLOCK = frozenset("div p li tr td th table body html h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
BARRIERS = frozenset("table div ul ol td th body".split())
STYLED = frozenset("span font b strong".split())
#: Fixed: blocks that don't make the block around them a container.
CELLS = frozenset("td th tr".split())
#: Fixed: the most columns that HTML lets a cell span.
MOST_COLUMNS = 1000
BLOCK_TYPE = "struct<seq:int,kind:string,tag:string,text:string,bold:boolean,grid:array<array<struct<text:string,colspan:int>>>,anchor:string>"


class _Open:
    """An open element, and how much had been seen when it began."""

    __slots__ = ("tag", "bold", "has_block", "blocks", "texts", "styled", "plain", "first_cell", "row", "cell")

    def __init__(self, tag: str, bold: bool) -> None:
        self.tag, self.bold, self.has_block = tag, bold, False
        self.row: list[list[int]] = []
        self.cell: list[int] = []


def _columns(colspan: str) -> int:
    number = re.match(r"[ \t\r\n]*0*([0-9]{1,9})", colspan)
    return min(max(int(number[1]), 1), MOST_COLUMNS) if number else 1


class _Blocks:
    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.texts: list[str] = []
        self.rows: list[list[list[int]]] = []  # of the outermost open table
        self.cells: list[list[int]] = []  # first text, text after the last, columns
        self.styled = self.plain = 0  # styled elements so far, and those of them with text that isn't bold
        self.open: list[_Open] = []
        self.counts: Counter[str] = Counter()
        self.depths: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of each tag stand
        self.body_depth = -1

    def start(self, tag: str, written: str) -> None:
        if tag == "body":
            if self.body_depth >= 0:
                return
            self.body_depth = len(self.open)
            self.blocks.clear()
        self._end_before(tag)
        own = attributes(written)
        style = own.get("style", "")
        if own.get("id") and ":" not in tag and tag != "body":
            self.blocks.append({"kind": "anchor", "tag": tag, "text": own["id"]})
        element = _Open(tag, tag in ("b", "strong") or "font-weight:7" in style or "font-weight:bold" in style)
        if tag == "table" and not self.counts["table"]:
            self.rows, self.cells = [], []
        element.blocks, element.texts, element.styled, element.plain, element.first_cell = len(self.blocks), len(self.texts), self.styled, self.plain, len(self.cells)
        if tag == "tr":
            self.rows.append(element.row)
        elif tag in ("td", "th"):
            element.cell = [len(self.texts), len(self.texts), _columns(own.get("colspan", ""))]
            self.cells.append(element.cell)
            if self.open and self.open[-1].tag == "tr":
                self.open[-1].row.append(element.cell)
        self.depths[tag].append(len(self.open))
        self.open.append(element)
        self.counts[tag] += 1
        if tag in VOID or written.endswith("/"):
            self._close()

    def end(self, tag: str) -> None:
        # what stands behind the body's end still belongs to it
        if self.counts[tag] and tag not in ("body", "html"):
            self.close_to(self.depths[tag][-1])

    def text(self, data: str) -> None:
        if not (self.open and self.open[-1].tag in ("script", "style")) and (text := unescape(data).strip()):
            self.texts.append(text)

    def _end_before(self, tag: str) -> None:
        ends = CLOSES.get(tag, {"p"} if tag in BLOCK else set())
        # an element ends those of ``ends`` that stand above the last barrier; one that is both is ended
        if (depth := self._deepest(ends)) > self._deepest(BARRIERS - ends):
            self.close_to(depth)

    def _deepest(self, tags: Iterable[str]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self._close()

    def _close(self) -> None:
        done = self.open.pop()
        tag = done.tag
        self.counts[tag] -= 1
        self.depths[tag].pop()
        if done.cell:
            done.cell[1] = len(self.texts)
        if tag == "tr" and not done.row:
            done.row.extend(self.cells[done.first_cell :])
        if len(self.open) > self.body_depth and not self.counts["table"]:
            if tag == "table":
                grid = [[{"text": self._text(a, b), "colspan": n} for a, b, n in row] for row in self.rows]
                self.blocks[done.blocks :] = [{"kind": "table", "tag": tag, "grid": grid}]
            elif tag in BLOCK and not done.has_block:
                bold = self.plain == done.plain if self.styled > done.styled else done.bold
                self.blocks[done.blocks :] = [{"kind": "text", "tag": tag, "text": self._text(done.texts, len(self.texts)), "bold": bold}]
        if tag in STYLED:
            self.styled += 1
            self.plain += len(self.texts) > done.texts and not done.bold
        if self.open and (done.has_block or (tag in BLOCK and tag not in CELLS)):
            self.open[-1].has_block = True

    def _text(self, start: int, end: int) -> str:
        return re.sub(r"\s+", " ", " ".join(self.texts[start:end])).strip()


def leaf_blocks(html: str) -> list[dict]:
    """Blocks in page order: anchors, whole tables, and texts of blocks that hold no further block."""
    found = _Blocks()
    for kind, what, written in tokens(html):
        if kind == "start":
            found.start(what, written)
        elif kind == "end":
            found.end(what)
        else:
            found.text(what)
    found.close_to(0)
    return found.blocks


def _anchored(blocks: list[dict]) -> list[dict]:
    """Blocks numbered, each with the last id seen."""
    anchor = None
    for k, b in enumerate(blocks):
        anchor = b["text"] if b["kind"] == "anchor" else anchor
        b["seq"], b["anchor"] = k, anchor
    return blocks


def block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, html, ...) to (doc_id, blocks, ...)."""
    grid = pa.list_(pa.list_(pa.struct([("text", pa.string()), ("colspan", pa.int32())])))
    kind = pa.list_(pa.struct([("seq", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("text", pa.string()), ("bold", pa.bool_()), ("grid", grid), ("anchor", pa.string())]))
    for batch in batches:
        for i in range(batch.num_rows):  # a page at a time, as one may be very long
            own = batch.slice(i, 1)
            yield own.set_column(1, "blocks", pa.array([_anchored(leaf_blocks(own.column(1)[0].as_py() or ""))], kind))
