"""Spreadsheet workbooks: many files per job, one task per sheet, rows decoded as they stream past."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tallyframe.operators.parse import PLACE
from tallyframe.operators.skew import attach
from tallyframe.sources import xlsx
from tallyframe.sources.files import PATHS_PER_TASK, open_at_random

_PART = pa.struct([("method", pa.int32()), ("start", pa.int64()), ("size", pa.int64())])
_SHEETS = pa.schema([
    ("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("part", _PART), ("shared", _PART),
    ("dates", pa.list_(pa.string())), ("later", pa.bool_()), ("error", pa.string()),
])
_ROWS = pa.schema([
    ("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string())),
])
_AT_ONCE = 10_000  # rows given out at a time


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _described(err: Exception) -> str:
    return f"{type(err).__name__}: {err}"


def _sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sheet: where its part of the file lies, and what its cells need."""
    def plain(part: xlsx.Part | None) -> dict | None:
        return asdict(part) if part else None

    for batch in batches:
        rows: list[tuple] = []
        for path in batch.column("path").to_pylist():
            try:
                with open_at_random(path) as file:
                    book = xlsx.open_book(file)
                rows += [(path, s.number, s.name, plain(s.part), plain(book.shared), book.dates, book.later, None) for s in book.sheets]
            except Exception as err:  # a broken file is reported, not fatal
                rows.append((path, -1, None, None, None, [], False, _described(err)))
        yield _batch(rows, _SHEETS)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def part(value: dict | None) -> xlsx.Part | None:
        return xlsx.Part(**value) if value else None

    for batch in batches:
        for s in batch.to_pylist():
            rows: list[tuple] = []
            try:
                if s["error"]:
                    rows.append((s["path"], -1, None, 0, [s["error"]]))
                else:
                    with open_at_random(s["path"]) as file:
                        shared = xlsx.shared_strings(file, part(s["shared"]))
                        for number, cells in xlsx.sheet_rows(file, part(s["part"]), shared, set(s["dates"]), s["later"]):
                            rows.append((s["path"], s["sheet_no"], s["sheet"], number, cells))
                            if len(rows) == _AT_ONCE:
                                yield _batch(rows, _ROWS)
                                rows = []
            except Exception as err:
                rows.append((s["path"], -1, None, 0, [_described(err)]))
            yield _batch(rows, _ROWS)


def workbook_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Non-empty rows of every sheet. A file or sheet that cannot be decoded gives one row with sheet_no -1
    and the reason as its only cell.

    Files are read by ranges: first the directory of each, then every sheet in a task of its own, which
    holds a piece of the sheet, the workbook's shared strings and 10,000 rows. No task holds a file, and
    the file format ends a sheet at 1,048,576 rows.
    """
    given = spark.createDataFrame([(str(p),) for p in paths], "path string")
    listed = given.repartition(max(1, -(-len(paths) // PATHS_PER_TASK)), "path").mapInArrow(_sheets, from_arrow_schema(_SHEETS))
    # a row per sheet says little about the work: small partitions are not put together
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks, "path", "sheet_no").mapInArrow(_decoded, from_arrow_schema(_ROWS))


def sheet_summary(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """Per workbook: sheet names in order, header cells of the first (or the named) sheet, and an error."""
    heads = rows.groupBy("path", "sheet_no", "sheet").agg(F.min_by("cells", "row_no").alias("header"))
    return heads.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("sheet_no", "sheet", "header"))).alias("_s")
    ).select(
        "path",
        F.transform(F.filter("_s", lambda s: s.sheet_no >= 0), lambda s: s.sheet).alias("sheets"),
        F.get(F.filter("_s", lambda s: (s.sheet == sheet) if sheet else (s.sheet_no >= 0)), F.lit(0)).header.alias("header"),
        F.coalesce(
            F.get(F.get(F.filter("_s", lambda s: s.sheet_no < 0), F.lit(0)).header, F.lit(0)),
            F.when(~F.exists("_s", lambda s: s.sheet == sheet), F.lit(f"no sheet named {sheet}")) if sheet else F.lit(None),
        ).alias("error"),
    )


def scan_workbook(rows: DataFrame, paths: Sequence[str], headers: list[str], sheet: str | None = None) -> DataFrame:
    """Rows of the first (or the named) sheet of workbooks that share a header, with `_row`."""
    wanted = rows.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    chosen = rows.join(wanted, "path", "left_semi")
    chosen = chosen.filter(F.col("sheet") == sheet) if sheet else chosen.filter("sheet_no = 0")
    top = chosen.groupBy("path").agg(F.min("row_no").alias("_top"))
    parts = F.split("path", "/")
    return attach(chosen, top, ["path"], how="inner").filter("row_no > _top").select(
        *[F.get("cells", F.lit(i)).alias(f"_c{i}") for i in range(len(headers))],
        (F.col("row_no") - F.col("_top") - 1).alias(PLACE[0]),
        F.element_at(parts, -1).alias(PLACE[1]),
        F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias(PLACE[2]),
        F.col("path").alias(PLACE[3]),
    )
