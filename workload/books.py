"""Files written by tasks, to read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of the given sheets; texts are shared strings, numbers are numbers, None is no cell."""
    shared: dict[str, int] = {}

    def cell(value) -> str:
        if isinstance(value, str):
            return f'<c t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
        return "<c/>" if value is None else f"<c><v>{value}</v></c>"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f"<workbook {_MAIN} {_REL}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows)
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>")
        texts = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>{texts}</sst>")
    return out.getvalue()


def write_files(df: DataFrame, folder: str, by: str, render: Callable[[pd.DataFrame], tuple[str, bytes]]) -> DataFrame:
    """One file per value of `by`, named and filled by `render` in the task that has its rows. Returns the paths."""
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        name, content = render(rows)
        system, path = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(content)
        return pd.DataFrame({"path": [f"{folder}/{name}"]})

    return df.groupBy(by).applyInPandas(write, "path string")


def write_books(df: DataFrame, folder: str, book: str, order: str, extra: dict[str, list[list]] | None = None) -> DataFrame:
    """One workbook per value of `book`: its rows in `order` on a first sheet, then the `extra` sheets.
    Returns the paths."""
    names = [c for c in df.columns if c not in (book, order)]

    def render(rows: pd.DataFrame) -> tuple[str, bytes]:
        cells = rows.sort_values(order)[names].itertuples(index=False)
        data = [[None if pd.isna(v) else v for v in r] for r in cells]
        return f"book_{rows[book].iloc[0]}.xlsx", book_bytes({"Clients": [names, *data], **(extra or {})})

    return write_files(df, folder, book, render)
