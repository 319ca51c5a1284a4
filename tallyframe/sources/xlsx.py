"""Decoding of workbook files by ranged reads: a task holds a piece of a sheet and the shared strings."""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal, InvalidOperation
from typing import BinaryIO
from xml.etree import ElementTree

READ = 1 << 20  # bytes of the file read at a time
PIECE = 1 << 16  # bytes of a sheet's text parsed at a time
DATE_STYLES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}  # fixed values: built-in date formats
SHARED = "xl/sharedStrings.xml"


@dataclass(frozen=True)
class Part:
    """Where the compressed bytes of a file inside a workbook lie."""

    method: int
    start: int
    size: int


@dataclass(frozen=True)
class Sheet:
    number: int
    name: str
    part: Part


@dataclass(frozen=True)
class Book:
    sheets: list[Sheet]
    shared: Part | None
    dates: list[str]  # cell styles that show dates
    later: bool  # days are counted from 1904


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def open_book(file: BinaryIO) -> Book:
    """The parts of a workbook, by its directory; only the small ones among them are read."""
    try:
        book = zipfile.ZipFile(file)
    except ValueError as err:  # a file too short for a directory, where some file systems refuse to seek
        raise zipfile.BadZipFile("File is not a zip file") from err
    names = set(book.namelist())

    def part(name: str) -> Part:
        info = book.getinfo(name)
        # the local header repeats the name and may have other extra fields than the directory
        file.seek(info.header_offset + 26)
        skip = sum(struct.unpack("<HH", file.read(4)))
        return Part(info.compress_type, info.header_offset + 30 + skip, info.compress_size)

    links = {}
    for node in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        target = node.get("Target", "")
        links[node.get("Id")] = target.lstrip("/") if target.startswith("/") else "xl/" + target
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = []
    for number, node in enumerate(n for n in root.iter() if local(n.tag) == "sheet"):
        link = next(v for k, v in node.attrib.items() if local(k) == "id")
        sheets.append(Sheet(number, node.get("name"), part(links[link])))
    later = any(local(n.tag) == "workbookPr" and n.get("date1904") in ("1", "true") for n in root.iter())
    dates = _date_styles(book.read("xl/styles.xml")) if "xl/styles.xml" in names else []
    return Book(sheets, part(SHARED) if SHARED in names else None, dates, later)


def _date_styles(styles: bytes) -> list[str]:
    """Numbers of the cell styles that show dates."""
    root = ElementTree.fromstring(styles)
    shown = set(DATE_STYLES)
    for node in root.iter():
        if local(node.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", node.get("formatCode", ""))
            number = int(node.get("numFmtId", -1))
            shown = shown | {number} if re.search(r"[dmyhsDMYHS]", code) else shown - {number}
    cells = next((n for n in root if local(n.tag) == "cellXfs"), ())
    return [str(i) for i, n in enumerate(cells) if int(n.get("numFmtId", 0)) in shown]


def _ranges(file: BinaryIO, part: Part) -> Iterator[bytes]:
    for at in range(0, part.size, READ):
        file.seek(part.start + at)
        yield file.read(min(READ, part.size - at))


def pieces(file: BinaryIO, part: Part) -> Iterator[bytes]:
    """The bytes of a part, decompressed `PIECE` of them at a time."""
    if part.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise zipfile.BadZipFile(f"compression method {part.method}")
    stream = zlib.decompressobj(-15)
    for rest in _ranges(file, part):
        if part.method == zipfile.ZIP_STORED:
            yield rest
            continue
        while rest and not stream.eof:
            yield stream.decompress(rest, PIECE)
            rest = stream.unconsumed_tail
    yield stream.flush()


def elements(file: BinaryIO, part: Part, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of one name, each dropped once the next one is asked for."""
    parser = ElementTree.XMLPullParser(("start", "end"))
    above: list[ElementTree.Element] = []
    for piece in pieces(file, part):
        parser.feed(piece)
        for event, node in parser.read_events():
            if event == "start":
                above.append(node)
                continue
            above.pop()
            if local(node.tag) == tag:
                yield node
                if above:
                    above[-1].remove(node)
    parser.close()


def text_of(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if local(t.tag) == "t")


def shared_strings(file: BinaryIO, part: Part | None) -> list[str]:
    return [text_of(node) for node in elements(file, part, "si")] if part else []


def _column_no(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _exact(text: str) -> str:
    """A stored number without an exponent, as the cell holds it."""
    try:
        number = Decimal(text)
    except InvalidOperation:
        return text
    return format(number, "f") if "E" in text.upper() and number.is_finite() else text


def _dated(text: str, base: datetime) -> str:
    """A serial day number as an ISO date, with a time if it has one."""
    try:
        days = float(text)
    except ValueError:
        return text
    if base.year == 1899 and days < 60:  # the serial calendar has a 29 February 1900
        days += 1
    moment = base + timedelta(seconds=round(days * 86400))
    return moment.strftime("%Y-%m-%d" if moment.time() == moment.min.time() else "%Y-%m-%d %H:%M:%S")


def sheet_rows(file: BinaryIO, part: Part, shared: list[str], dates: set[str], later: bool) -> Iterator[tuple[int, list]]:
    """Number and cells of every row that is not empty."""
    base = datetime(1904, 1, 1) if later else datetime(1899, 12, 30)
    number = 0
    for node in elements(file, part, "row"):
        cells: list = []
        for cell in node:
            at = _column_no(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            kind = cell.get("t")
            value = next((c.text for c in cell if local(c.tag) == "v"), None)
            if kind == "inlineStr":
                value = text_of(cell)
            elif kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "b" and value is not None:
                value = "True" if value == "1" else "False"
            elif kind == "e":
                value = None
            elif kind in (None, "n") and value is not None:
                value = _dated(value, base) if cell.get("s") in dates else _exact(value)
            cells[at] = value
        number = int(node.get("r", number + 1))  # the number may be left out
        if any(c not in (None, "") for c in cells):
            yield number, cells
