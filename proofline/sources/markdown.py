"""Markdown as semantic units: headings, paragraphs, list items, quotations, table cells, code blocks.

A block parser in one pass over the lines with a stack of containers, and an inline pass that leaves the
text.  Lines and columns count from 1, columns in code points.  Rules that evidence relies on: a unit's
text is normalised and empty units are dropped; the first block of an item that directly follows the
item's own tight text has no unit of its own; HTML blocks and image texts contribute nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from proofline.functions.text import CURVED_QUOTES, PLAIN_QUOTES, Normalization

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^`]*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_HTML = re.compile(r" {0,3}<(?:!--|[?!]|/?(?:address|article|aside|blockquote|body|center|dd|details|dialog|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/>]|$))", re.I)
_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TASK = re.compile(r"\[([ xX])\][ \t]+")
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(f"[{_SPACE}]+")
_DIVIDED = re.compile(f"[-\u00ad\u2010][{_SPACE}]*[\n\r\u2028\u2029][{_SPACE}]*(?=(.))", re.S)
_FOLD = str.maketrans(CURVED_QUOTES, PLAIN_QUOTES)


def normalize_text(text: str, options: Normalization = Normalization()) -> str:
    """The column expression's counterpart for texts that are parsed in Python."""
    if options.quotes:
        text = text.translate(_FOLD)
    if options.dehyphenate:
        text = _DIVIDED.sub(lambda m: "" if m.group(1).islower() else m.group(), text)
    return _BLANKS.sub(" ", text).strip(" ")


@dataclass
class Unit:
    kind: str
    text: str
    line: int
    column: int
    section: list[str] = field(default_factory=list)


_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


def inline_text(source: str) -> str:
    """Text of inline Markdown: marks off, links and code as their text, images out, breaks as line breaks."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    s = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep(_code(m.group(2))), source, flags=re.S)
    s = re.sub(r"(?<![\\$])\$\$?([^$\n]+?)\$\$?", lambda m: keep(m.group(1)), s)
    s = _ESCAPED.sub(lambda m: keep(m.group(1)), s)
    s = re.sub(r"<br(?=[\s/>])[^>]*>", "\n", s, flags=re.I)
    s = re.sub(r"<((?:https?|mailto|ftp):[^<>\s]*|[\w.+-]+@[\w-]+\.[\w.-]+)>", lambda m: keep(m.group(1)), s)
    s = re.sub(r"<!--.*?-->|</?[A-Za-z][^<>]*>", "", s, flags=re.S)
    link = r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\](?:\((?:[^()\s]|\([^()]*\))*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|\[[^\]]*\])"
    s = re.sub("!" + link, "", s)
    s = re.sub(link, lambda m: m.group(1), s)
    for mark in (r"\*\*\*", r"\*\*", r"\*", "~~", "~"):
        s = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", s, flags=re.S)
    for mark in ("___", "__", "_"):
        s = re.sub(rf"(?<![^\W_]){mark}(?=\S)(.+?)(?<=\S){mark}(?![^\W_])", r"\1", s, flags=re.S)
    s = re.sub(r"(?: {2,}|\\)\n", "\n", s)
    s = html.unescape(s)
    for _ in range(3):
        s = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], s)
    return s


def _code(s: str) -> str:
    s = s.replace("\n", " ")
    return s[1:-1] if len(s) > 2 and s[0] == s[-1] == " " and s.strip() else s


def _cells(line: str) -> list[tuple[int, str]]:
    """(offset, text) of the cells of a table row."""
    out, start, i = [], 0, 0
    bare = line.rstrip()
    start = len(bare) - len(bare.lstrip())
    if bare[start : start + 1] == "|":
        start += 1
    i = start
    code = False
    while i <= len(bare):
        c = bare[i : i + 1]
        if c == "\\":
            i += 2
            continue
        code ^= c == "`"
        if (c == "|" and not code) or (not c and i > start):
            cell = bare[start:i]
            out.append((start + len(cell) - len(cell.lstrip()), cell.strip()))
            start = i + 1
        i += 1
    return out


class _Parser:
    def __init__(self, options: Normalization):
        self.options = options
        self.units: list[Unit] = []
        self.stack: list[tuple[int, str]] = []

    def finish(self, kind: str, text: str, line: int, column: int, level: int = 0) -> None:
        text = normalize_text(text, self.options)
        if kind == "heading":
            while self.stack and self.stack[-1][0] >= level:
                self.stack.pop()
        if text:
            self.units.append(Unit(kind, text, line, column, [t for _, t in self.stack]))
            if kind == "heading":
                self.stack.append((level, text))

    def blocks(self, lines: list[tuple[int, int, str]], inside: str) -> None:
        """``lines``: (line number, column offset, text without its containers' marks)."""
        i, n = 0, len(lines)
        while i < n:
            number, offset, line = lines[i]
            if not line.strip():
                i += 1
                continue
            lead = len(line) - len(line.lstrip(" "))
            if m := _ATX.match(line):
                self.finish("heading", inline_text(m.group(2) or ""), number, offset + lead + 1, len(m.group(1)))
                i += 1
            elif m := _FENCE.match(line):
                j, close = i + 1, re.compile(rf" {{0,3}}{re.escape(m.group(2)[0])}{{{len(m.group(2))},}}[ \t]*$")
                while j < n and not close.match(lines[j][2]):
                    j += 1
                self.finish("code_block", "\n".join(x[2] for x in lines[i + 1 : j]), number, offset + lead + 1)
                i = j + 1
            elif _BREAK.match(line):
                i += 1
            elif lead >= 4:
                j = i
                while j < n and (not lines[j][2].strip() or lines[j][2].startswith("    ")):
                    j += 1
                self.finish("code_block", "\n".join(x[2][4:] for x in lines[i:j]), number, offset + 5)
                i = j
            elif _QUOTE.match(line):
                i = self.quote(lines, i)
            elif _ITEM.match(line):
                i = self.items(lines, i)
            elif _HTML.match(line):
                while i < n and lines[i][2].strip():
                    i += 1
            elif i + 1 < n and "|" in line and _RULE.match(lines[i + 1][2]) and len(_cells(line)) == len(_cells(lines[i + 1][2])):
                i = self.table(lines, i)
            else:
                i = self.paragraph(lines, i, inside)

    def paragraph(self, lines: list[tuple[int, int, str]], i: int, inside: str) -> int:
        number, offset, line = lines[i]
        column = offset + len(line) - len(line.lstrip()) + 1
        text: list[str] = []
        j = i
        while j < len(lines) and lines[j][2].strip():
            now = lines[j][2]
            if j > i:
                if m := _SETEXT.match(now):
                    self.finish("heading", inline_text("\n".join(text)), number, column, 1 if m.group(1)[0] == "=" else 2)
                    return j + 1
                item = _ITEM.match(now)
                if _ATX.match(now) or _FENCE.match(now) or _BREAK.match(now) or _QUOTE.match(now) or _HTML.match(now) or (item and item.group(3).strip("\n") and (not item.group(2)[0].isdigit() or item.group(2)[:-1] == "1") and now[item.end() :].strip()):
                    break
            text.append(now.lstrip() if j > i else now.strip(" \t") if j + 1 == len(lines) else now.lstrip())
            j += 1
        self.finish(inside, inline_text("\n".join(text)), number, column)
        return j

    def quote(self, lines: list[tuple[int, int, str]], i: int) -> int:
        inner: list[tuple[int, int, str]] = []
        while i < len(lines):
            number, offset, line = lines[i]
            if m := _QUOTE.match(line):
                inner.append((number, offset + m.end(), line[m.end() :]))
            elif line.strip() and inner and inner[-1][2].strip() and not (_ATX.match(line) or _FENCE.match(line) or _BREAK.match(line) or _ITEM.match(line)):
                inner.append((number, offset, line))
            else:
                break
            i += 1
        self.blocks(inner, "blockquote")
        return i

    def items(self, lines: list[tuple[int, int, str]], i: int) -> int:
        m = _ITEM.match(lines[i][2])
        width = m.end() if m.group(3).strip("\n") and len(m.group(3)) <= 4 else len(m.group(1)) + len(m.group(2)) + 1
        number, offset, line = lines[i]
        first = line[width:]
        task = _TASK.match(first)
        inner = [(number, offset + width, first)]
        j, blank = i + 1, False
        while j < len(lines):
            k, o, now = lines[j]
            if not now.strip():
                blank = True
                inner.append((k, o, ""))
            elif len(now) - len(now.lstrip(" ")) >= width:
                inner.append((k, o + width, now[width:]))
                blank = False
            elif blank or _ITEM.match(now) or _ATX.match(now) or _FENCE.match(now) or _QUOTE.match(now) or _BREAK.match(now):
                break
            else:
                inner.append((k, o, now))
            j += 1
        before = len(self.units)
        if task:
            # the mark stays in the item's text in its plain form
            inner[0] = (number, offset + width, first)
        self.item_blocks(inner)
        if task and len(self.units) > before:
            u = self.units[before]
            u.text = re.sub(r"^\[[ xX]\] ?", f"[{task.group(1).lower()}] ", u.text)
        return j

    def item_blocks(self, inner: list[tuple[int, int, str]]) -> None:
        """Blocks of an item; text directly followed by a nested list takes the list's first text along."""
        head = 0
        while head < len(inner) and inner[head][2].strip() and not _ITEM.match(inner[head][2]):
            head += 1
        if 0 < head < len(inner) and _ITEM.match(inner[head][2]) and not any(p.match(inner[0][2]) for p in (_ATX, _FENCE, _QUOTE, _HTML, _BREAK)):
            before = len(self.units)
            self.blocks(inner[head:], "list_item")
            number, offset, line = inner[0]
            text = inline_text("\n".join(x[2].lstrip() for x in inner[:head]))
            if len(self.units) > before and self.units[before].kind == "list_item":
                u = self.units[before]
                u.text, u.line, u.column = normalize_text(text, self.options) + u.text, number, offset + len(line) - len(line.lstrip()) + 1
            else:
                self.finish("list_item", text, number, offset + 1)
            return
        self.blocks(inner, "list_item")

    def table(self, lines: list[tuple[int, int, str]], i: int) -> int:
        width = len(_cells(lines[i][2]))
        j = i
        while j < len(lines) and lines[j][2].strip() and (j == i or "|" in lines[j][2] or j == i + 1):
            if j != i + 1:
                number, offset, line = lines[j]
                for at, cell in _cells(line)[:width]:
                    self.finish("table_cell", inline_text(cell.replace("\\|", "|")), number, offset + at + 1)
            j += 1
        return j


def parse_units(source: str, options: Normalization = Normalization()) -> list[Unit]:
    """The units of a Markdown text, in order."""
    parser = _Parser(options)
    parser.blocks([(i, 0, line.rstrip("\r").replace("\t", "    ") if line.startswith("\t") else line.rstrip("\r")) for i, line in enumerate(source.split("\n"), 1)], "paragraph")
    return parser.units


_SCHEMA = pa.schema([("id", pa.string()), ("source", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("section", pa.list_(pa.string()))])


def units_of(files: DataFrame, options: Normalization = Normalization()) -> DataFrame:
    """Unit rows of Markdown files: ``files`` has id, source, text (null texts have none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, s, text in zip(*(batch.column(c).to_pylist() for c in ("id", "source", "text"))):
                rows += [(i, s, n, u.kind, u.text, u.line, u.column, u.section) for n, u in enumerate(parse_units(text or "", options))]
            yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return files.select("id", "source", "text").mapInArrow(run, "id string, source string, ord int, kind string, text string, line int, col int, section array<string>")
