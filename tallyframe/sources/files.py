"""Reading report files: listing, probing, fingerprints and numbered delimited rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.errors import ParserError
from tallyframe.operators.parse import PLACE
from tallyframe.operators.skew import attach
from tallyframe.sources.catalog import READERS
from tallyframe.storage import written

SUPPORTED = (".csv", ".xlsx", ".xls", ".pdf")
PATHS_PER_TASK = 16
_CSV = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def list_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files of a folder as (path, size); contents are not read."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return (
        spark.read.format("binaryFile").load(folder)
        .select("path", F.col("length").alias("size"))
        .filter(suffix.isin(*SUPPORTED, *READERS))
    )


def _opener(at_random: bool = False):
    """Open a path of any file system Arrow knows; nested so that it travels by value."""

    def open_stream(path: str):
        from urllib.parse import unquote, urlparse

        from pyarrow import fs

        if path.startswith("file:"):
            path = unquote(urlparse(path).path)
        if "://" in path:
            system, inner = fs.FileSystem.from_uri(path)
        else:
            system, inner = fs.LocalFileSystem(), path
        return system.open_input_file(inner) if at_random else system.open_input_stream(inner, compression=None)

    return open_stream


def open_at_random(path: str):
    """A file opened for ranged reads, on any file system Arrow knows."""
    return _opener(at_random=True)(path)


def _over_paths(spark: SparkSession, paths: Sequence[str], fn, schema: str) -> DataFrame:
    """One row per path, spread over tasks; `fn` works on one opened file."""
    open_stream = _opener()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([fn(path, open_stream) for path in pdf["path"]])

    rows = spark.createDataFrame([(str(p),) for p in paths], "path string")
    return rows.repartition(max(1, -(-len(paths) // PATHS_PER_TASK)), "path").mapInPandas(run, schema)


_PROBE = (
    "path string, file_name string, file_id string, readable boolean, size_seen bigint,"
    " zipped boolean, header_line string"
)


def probe(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Name, parent folder, zip signature and first non-blank line of every file.

    Reads on until that line ends outside quotes, so a header of any length, with line ends inside quoted
    names or after any amount of blank space, comes whole.
    """

    def look(path, open_stream):
        parts = path.rstrip("/").replace("\\", "/").split("/")
        row = {
            "path": path, "file_name": parts[-1], "file_id": parts[-2] if len(parts) > 1 else "",
            "readable": True, "size_seen": 0, "zipped": False, "header_line": None,
        }
        try:
            with open_stream(path) as stream:
                zipped, seen, record = header(stream)
        except OSError:
            return {**row, "readable": False}
        text = None
        if record and not zipped:
            try:
                text = record.decode("utf-8")
            except UnicodeDecodeError:
                text = record.decode("latin-1")
        return {**row, "size_seen": seen, "zipped": zipped, "header_line": text}

    def header(stream):
        """Zip signature, bytes seen and the first record that is not blank. A quote that never closes
        leaves the first line as it is."""
        block = stream.read(1 << 16)
        if block.startswith(b"PK"):
            return True, len(block), b""
        data, seen = block.removeprefix(b"\xef\xbb\xbf").lstrip(), len(block)
        checked = quotes = 0
        while True:
            while (end := min((k for k in (data.find(b"\n", checked), data.find(b"\r", checked)) if k >= 0), default=-1)) >= 0:
                quotes += data.count(b'"', checked, end)
                checked = end + 1
                if quotes % 2 == 0:
                    return False, seen, data[:end]
            if not (block := stream.read(1 << 20)):
                break
            seen += len(block)
            quotes += data.count(b'"', checked)
            checked = len(data)
            data = data + block if data else block.lstrip()
        lines = data.splitlines()
        return False, seen, data if (quotes + data.count(b'"', checked)) % 2 == 0 else lines[0] if lines else b""

    return _over_paths(spark, paths, look, _PROBE)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SHA-256 of every file, streamed in blocks, so a file of any size needs little memory."""

    def digest(path, open_stream):
        import hashlib

        sha = hashlib.sha256()
        with open_stream(path) as stream:
            while block := stream.read(1 << 20):
                sha.update(block)
        return {"path": path, "file_name": path.rstrip("/").split("/")[-1], "sha256": sha.hexdigest()}

    return _over_paths(spark, paths, digest, "path string, file_name string, sha256 string")


def fingerprint_readable(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """`fingerprint` of the paths that can be opened; the probes name those that cannot."""
    seen = list(dict.fromkeys(str(p) for p in paths))
    readable = [r.path for r in probe(spark, seen).filter("readable").collect()]
    return fingerprint(spark, readable)


def expand(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The given files, and for a folder the supported files in it."""
    out: list[str] = []
    for path in paths:
        path = str(path)
        if suffix_like(path):
            out.append(path)
        else:
            out += sorted(r["path"] for r in list_batch(spark, path).select("path").collect())
    return out


def suffix_like(path: str) -> bool:
    return path.rstrip("/").lower().endswith((*SUPPORTED, *READERS)) and not path.endswith("/")


def split_header(line: str) -> list[str]:
    """Header names of a delimited file; repeated names get a number, unnamed ones a position."""
    import csv

    names: list[str] = []
    for i, name in enumerate(next(csv.reader([line]), [])):
        name = name.strip() or f"Unnamed: {i}"
        n, unique = 0, name
        while unique in names:
            n += 1
            unique = f"{name}.{n}"
        names.append(unique)
    return names


# A field that ends in its line, and one that a line leaves open, for a quoted cell that goes on.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+,'
_OPEN = r'"[^"]*+(?:""[^"]*+)*+$'
_OPENS = f"^(?:{_FIELD})*+{_OPEN}"
_STAYS_OPEN = r'^[^"]*+(?:""[^"]*+)*+$'
_REOPENS = rf'^[^"]*+(?:""[^"]*+)*+"[^,]*+,(?:{_FIELD})*+{_OPEN}'


def stored_lines(spark: SparkSession, paths: Sequence[str], blank: bool = False) -> DataFrame:
    """Lines, written once with path, split and an id that rises by one within a split.

    Every later step reads this table. How a file is cut into splits depends on the cores known at the
    moment of the scan, so numbers taken in one scan must not be joined to lines of another. `blank`
    keeps lines of white space as well.
    """
    lines = spark.read.text([str(p) for p in paths]).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    if not blank:
        lines = lines.filter(F.col("value").rlike(r"\S"))
    return written(lines.withColumn("_id", F.monotonically_increasing_id()))


def _before(column: Column) -> Column:
    """Running sum over the earlier splits of a file."""
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def _decoded(lines: DataFrame, utf8: DataFrame) -> DataFrame:
    """`line`: the text in the file's encoding, without byte order mark and carriage return."""
    text = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return lines.join(utf8, "_path").withColumn("line", F.regexp_replace(text, r"^\x{FEFF}|\r$", ""))


def _same_count(got: DataFrame, expected: int) -> DataFrame:
    """Fails if the joined lines are not as many as were stored."""
    rows = written(got)
    found = rows.count()
    if found != expected:
        raise ParserError(f"Rows were lost while numbering lines: {found} of {expected}")
    return rows


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Non-blank lines with their 0-based number within the file: `_path, line_no, line`.

    One stored pass; a table with one row per split holds the lines before each, so the lines are not
    sorted. Catalyst broadcasts that table only if it is small.
    """
    return _numbered(stored_lines(spark, paths))


def _numbered(lines: DataFrame) -> DataFrame:
    splits = written(lines.groupBy("_path", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_all"), F.bool_and(F.is_valid_utf8("value")).alias("_utf8")))
    utf8 = splits.groupBy("_path").agg(F.bool_and("_utf8").alias("utf8"))
    starts = splits.select("_path", "_block", (_before(F.col("_all")) - F.col("_first")).alias("_shift"))
    total = splits.agg(F.coalesce(F.sum("_all"), F.lit(0))).first()[0]
    numbered = _decoded(lines.join(starts, ["_path", "_block"]), utf8)
    return _same_count(numbered.select("_path", (F.col("_id") + F.col("_shift")).alias("line_no"), "line"), total)


def numbered_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV records with their 0-based number within the file: `_path, line_no, line`, blank lines left out.

    A quoted cell may run over line ends. Whether a line starts inside quotes depends on all lines before
    it, but a line can only keep, turn or set that state, so it follows from running sums within splits
    and from one row per split; files stay split. A quote inside an unquoted cell is a plain character.
    """
    quoted, opens = F.col("value").contains('"'), F.col("value").rlike(_OPENS)
    lines = stored_lines(spark, paths)
    broken = lines.filter(quoted & opens).select("_path").distinct()
    names = [r["_path"] for r in broken.collect()]  # of the paths given
    if not names:
        return _numbered(lines)
    plain = _numbered(attach(lines, broken, ["_path"], how="left_anti"))
    rows = stored_lines(spark, names, blank=True)
    stays = F.col("value").rlike(_STAYS_OPEN) | F.col("value").rlike(_REOPENS)
    rows = rows.withColumn("_opens", quoted & opens).withColumn("_stays", ~quoted | stays)
    upto = Window.partitionBy("_path", "_block").orderBy("_id")
    turns = F.sum(F.when(F.col("_opens") & ~F.col("_stays"), 1).otherwise(0)).over(upto)
    rows = rows.withColumn("_turns", turns).withColumn("_set", F.last(
        F.when(F.col("_opens") == F.col("_stays"), F.struct(F.col("_opens").cast("int").alias("to"), F.col("_turns").alias("at"))),
        ignorenulls=True).over(upto))
    # state after each line as far as its split tells: `_set` overrides what came before the split
    ends = rows.groupBy("_path", "_block").agg(
        F.max("_turns").alias("_turns"), F.max_by("_set", "_id").alias("_set"),
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"))
    chain = Window.partitionBy("_path").orderBy("_block")
    ends = ends.withColumn("_total", F.sum("_turns").over(chain))
    since = F.last(F.when(F.col("_set").isNotNull(), F.struct(
        F.col("_set.to").alias("to"), (F.col("_total") - F.col("_turns") + F.col("_set.at")).alias("at"))), ignorenulls=True).over(chain)
    after = (F.coalesce(since["to"], F.lit(0)) + F.col("_total") - F.coalesce(since["at"], F.lit(0))) % 2
    ends = written(ends.withColumn("_after", after).select(
        "_path", "_block", "_utf8", F.coalesce(F.lag("_after").over(chain), F.lit(0)).alias("_carry")))
    state = (F.coalesce(F.col("_set.to"), F.col("_carry")) + F.col("_turns") - F.coalesce(F.col("_set.at"), F.lit(0))) % 2
    rows = rows.join(ends, ["_path", "_block"]).withColumn("_state", state)
    inside = F.coalesce(F.lag("_state").over(upto), F.col("_carry")) == 1
    rows = rows.withColumn("_inside", inside).filter(F.col("_inside") | F.col("value").rlike(r"\S"))
    rows = rows.withColumn("_starts", F.sum(F.when(F.col("_inside"), 0).otherwise(1)).over(upto))
    counts = rows.groupBy("_path", "_block").agg(F.max("_starts").alias("_n"))
    offsets = written(counts.select("_path", "_block", _before(F.col("_n")).alias("_start")))
    utf8 = ends.groupBy("_path").agg(F.bool_and("_utf8").alias("utf8"))
    rows = _decoded(rows.join(offsets, ["_path", "_block"]), utf8)
    rows = rows.withColumn("line_no", F.col("_start") + F.col("_starts") - 1)
    records = rows.groupBy("_path", "line_no").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_id", "line"))).alias("_lines"))
    return plain.unionByName(
        records.select("_path", "line_no", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("line")))


def place(path: Column) -> tuple[Column, Column, Column]:
    """File name, parent folder and full path of a URL-encoded path."""
    parts = F.split(path, "/")

    def part(i: int) -> Column:
        return F.url_decode(F.regexp_replace(F.element_at(parts, i), r"\+", "%2B"))

    return part(-1).alias("_file_name"), part(-2).alias("_file_id"), path.alias("_file_path")


def scan_csv(spark: SparkSession, paths: Sequence[str], headers: list[str]) -> DataFrame:
    """Rows of delimited files that share a header, all cells as text, with `_row`.

    Files are split between tasks, also those with line ends inside quoted cells. Rows shorter than the
    header end in nulls; of longer ones `_beyond` holds what follows the header's last cell, if it is not blank.
    """
    columns = [f"_c{i}" for i in range(len(headers))]
    layout = ", ".join(f"{c} string" for c in columns)
    # few rows have as many commas as the header has names, and only they are looked at cell by cell
    commas = F.length("line") - F.length(F.translate("line", ",", ""))
    first = f"^(?:{_FIELD}){{{len(headers)}}}"
    rest = F.when(F.col("line").rlike(first), F.regexp_replace("line", first, ""))
    beyond = F.when(commas >= len(headers), F.when(rest.rlike(r'[^\s,"]'), rest)).alias("_beyond")
    return (
        numbered_records(spark, paths).filter("line_no > 0")
        .select(F.from_csv("line", layout, _CSV).alias("_r"), beyond, (F.col("line_no") - 1).alias("_row"), *place(F.col("_path")))
        .select(*[F.col(f"_r.{c}").alias(c) for c in columns], "_beyond", *PLACE)
    )
