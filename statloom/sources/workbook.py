"""Cell grids of .xlsx workbooks, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Characters that XML cannot hold; the format writes their codes instead.
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


class NotAWorkbook(ValueError):
    """The bytes are no .xlsx workbook."""


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    dates = {i for i, code in own.items() if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code.lower()))}
    cells = root.find(f"{_MAIN}cellXfs")
    formats = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return {i for i, f in enumerate(formats) if f in _DATE_FORMATS | dates}


def all_sheets(data: bytes) -> Iterator[tuple[str, list[list], str | None]]:
    """(name, grid, what is wrong with it or None) of each sheet; cells are str, float, bool, datetime or None.

    Of merged cells only the first is filled.  Raises NotAWorkbook for anything else, such
    as the old binary format under the new name.
    """
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        names = {s.get(_LINK): s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        strings = []
        if "xl/sharedStrings.xml" in book.namelist():
            strings = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        dates = _date_styles(book)
    except (zipfile.BadZipFile, zlib.error, EOFError, KeyError, ValueError, ElementTree.ParseError) as wrong:
        raise NotAWorkbook(f"{type(wrong).__name__}: {wrong}") from wrong
    for link, name in names.items():
        target = links.get(link, "")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if path not in book.namelist():
            yield name, [], f"no part {path}"
            continue
        try:
            yield name, _grid(ElementTree.fromstring(book.read(path)), strings, dates), None
        except (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, EOFError, ValueError, IndexError, TypeError, OverflowError) as wrong:
            yield name, [], f"{type(wrong).__name__}: {wrong}"


def sheets(data: bytes) -> list[tuple[str, list[list]]]:
    """(name, grid) of each sheet that can be read; a bad sheet is passed over, the others are read."""
    return [(name, grid) for name, grid, wrong in all_sheets(data) if wrong is None]


def cell_text(value) -> str | None:
    """A cell as text: a date heads its year, empty is null."""
    if hasattr(value, "year"):
        return str(value.year)
    return None if value is None else str(value).strip() or None


_STYLES = f'<styleSheet xmlns="{_MAIN[1:-1]}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>'


def packed(tables: list[tuple[str, dict[tuple[int, int], str | float | date]]]) -> bytes:
    """A workbook with these sheets, each a name and its cells by (row, column): texts, numbers and dates."""
    letters = lambda c: (letters(c // 26 - 1) if c >= 26 else "") + chr(65 + c % 26)
    held = io.BytesIO()
    parts = range(1, len(tables) + 1)
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="r{i}"/>' for i, (name, _) in zip(parts, tables, strict=True))
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in parts)
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_LINK[1:].partition("}")[0]}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        book.writestr("xl/styles.xml", _STYLES)
        for i, (_, cells) in zip(parts, tables, strict=True):
            lines: dict[int, list[str]] = {}
            for (r, c), value in sorted(cells.items()):
                at = f"{letters(c)}{r + 1}"
                dated = isinstance(value, date)
                value = (value - date(1899, 12, 30)).days if dated else value
                told = f'<c r="{at}"{' s="1"' * dated}><v>{value!r}</v></c>' if isinstance(value, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t>{escape(_UNWRITABLE.sub(lambda m: f"_x{ord(m[0]):04X}_", value))}</t></is></c>'
                lines.setdefault(r, []).append(told)
            rows = "".join(f'<row r="{r + 1}">{"".join(line)}</row>' for r, line in lines.items())
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
    return held.getvalue()


def _grid(root, strings: list[str], dates: set[int]) -> list[list]:
    cells: dict[tuple[int, int], object] = {}
    for r, row in enumerate(root.iter(f"{_MAIN}row")):
        r = int(row.get("r", r + 1)) - 1
        for c, cell in enumerate(row.findall(f"{_MAIN}c")):
            c = _column(cell.get("r")) if cell.get("r") else c
            value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
            if kind == "inlineStr":
                cells[r, c] = _text(cell)
            elif value is None or value.text is None:
                continue
            elif kind == "s":
                cells[r, c] = strings[int(value.text)]
            elif kind == "b":
                cells[r, c] = value.text == "1"
            elif kind in ("str", "d"):
                cells[r, c] = value.text
            elif kind != "e":
                number = float(value.text)
                date = int(cell.get("s", 0)) in dates
                cells[r, c] = datetime(1899, 12, 30) + timedelta(days=number) if date else number
    rows = max((r for r, _ in cells), default=-1) + 1
    columns = max((c for _, c in cells), default=-1) + 1
    return [[cells.get((r, c)) for c in range(columns)] for r in range(rows)]
