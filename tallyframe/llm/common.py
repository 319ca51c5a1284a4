"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.storage import written

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
HASHED_SIDE = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
# Words are runs of anything but ASCII white space; the same pattern holds in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, `doc_id` and `text`, the null text being empty. Other columns are not read."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def lowered(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct `row`, so that work columns cannot clash with their names."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def let(value: Column, body) -> Column:
    """`body` of a value that is evaluated once, inside a column expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stored(df: DataFrame, batch_rows: int | None = None, hashed_side: str | None = None) -> DataFrame:
    """`df` written once to the shared checkpoint folder and read back, so a lost executor costs nothing.

    The shuffle files of the write are dropped once it has ended, as nothing reads them again. `batch_rows`:
    rows that Python functions in it are given at a time, for rows that are large. `hashed_side`: partitions of
    at most that size are joined by a hash table, as adaptive execution finds; larger ones are sorted.
    """
    conf = df.sparkSession.conf
    wanted = {CLEANUP: "true"}
    if batch_rows is not None:
        wanted[BATCH_ROWS] = str(batch_rows)
    if hashed_side is not None:
        wanted[HASHED_SIDE] = hashed_side
    before = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        return written(df)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more, as all that came of it is stored itself."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
