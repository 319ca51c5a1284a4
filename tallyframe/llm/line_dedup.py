"""Line dedup: content-defined chunks of lines, repeated chunks removed after comparing their bytes.

A rolling hash (cyclic polynomial) over the hashes of the last few lines ends a chunk where its low bits
are zero, so boundaries follow the content and an inserted line moves only those near it. Chunks of
several lines that occur more than once anywhere are compared byte by byte; all but the first go.

Boundaries that depend on more than the lines of a passage miss short passages in other surroundings. With
`PAIRS` every line ends a piece and a chunk is two neighbouring pieces, so that chunks overlap and a passage
of two lines or more is found whatever stands around it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import let, packed, stored
from tallyframe.operators.skew import attach


@dataclass(frozen=True)
class ChunkRule:
    """A chunk ends after a line where `boundary_bits` bits of the hash of the last `window` lines are
    zero: 2 ** boundary_bits lines on average. Chunks of fewer than `least_lines` lines always stay.
    `pairs`: instead, a chunk is two neighbouring lines that are not blank, with the blank ones between."""

    window: int = 3
    boundary_bits: int = 2
    least_lines: int = 2
    pairs: bool = False


DEFAULT_RULE = ChunkRule()
PAIRS = ChunkRule(pairs=True)


def line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.xxhash64(line))


def _rotated(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h


def chunk_ends(hashes: Column, rule: ChunkRule) -> Column:
    """Indexes of the last lines of the chunks; the last line always ends one."""
    def rolled(i: Column) -> Column:
        # at the top of a text the missing lines count as zero
        return reduce(
            lambda a, b: a.bitwiseXOR(b),
            [_rotated(F.coalesce(F.when(i >= k, F.get(hashes, i - k)), F.lit(0).cast("long")), k) for k in range(rule.window)],
        )

    last = F.size(hashes) - 1
    return F.filter(
        F.sequence(F.lit(0), last), lambda i: (i == last) | (rolled(i).bitwiseAND(F.lit((1 << rule.boundary_bits) - 1)) == 0)
    )


def _chunks(hashes: Column, ends: Column) -> Column:
    """array<struct<first, n, hash>>, `first` counted from 1."""
    def one(end: Column, k: Column) -> Column:
        first = F.when(k == 0, F.lit(1)).otherwise(F.get(ends, k - 1) + 2)
        n = end - first + 2
        return F.struct(first.alias("first"), n.alias("n"), F.xxhash64(F.slice(hashes, first, n)).alias("hash"))

    return F.transform(ends, one)


def _not_blank(text: Column) -> Column:
    return F.length(F.trim(F.translate(text, "\n\t\r", "   "))) > 0


def _pairs(hashes: Column, full: Column) -> Column:
    """array<struct<first, n, hash>> of each two neighbours among the lines numbered `full`."""
    def one(at: Column, k: Column) -> Column:
        n = F.get(full, k + 1) - at + 1
        return F.struct((at + 1).alias("first"), n.alias("n"), F.xxhash64(F.slice(hashes, at + 1, n)).alias("hash"))

    return F.transform(F.slice(full, F.lit(1), F.greatest(F.size(full) - 1, F.lit(0))), one)


def _cut(docs: DataFrame, rule: ChunkRule) -> DataFrame:
    """`doc` (a key per row), `lines` and `chunks` of at least `least_lines` lines."""
    rows = docs.withColumn("lines", F.split("text", "\n", -1)).withColumn("hashes", line_hashes(F.col("lines")))
    if rule.pairs:
        full = F.filter(F.transform("lines", lambda line, i: F.when(_not_blank(line), i)), lambda i: i.isNotNull())
        rows = rows.withColumn("full", full)
        return rows.withColumn("chunks", _pairs(F.col("hashes"), F.col("full"))).drop("hashes", "full")
    rows = rows.withColumn("ends", chunk_ends(F.col("hashes"), rule))
    chunks = _chunks(F.col("hashes"), F.col("ends"))
    return rows.withColumn("chunks", F.filter(chunks, lambda c: c["n"] >= rule.least_lines)).drop("hashes", "ends")


def _exploded(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk, as `c`. Outer, since for a plain explode Spark would add a filter on the size of
    the array and move it below the projections, where each element recomputes the whole array."""
    return rows.select(*columns, F.explode_outer("chunks").alias("c")).filter("c IS NOT NULL")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: ChunkRule = DEFAULT_RULE, keep: bool = False
) -> DataFrame:
    """`doc_id, text, n_lines, n_removed_lines, n_removed_chunks`; with `keep`, the row before it as `row`.

    Of equal chunks the first stays: smallest doc_id, then smallest text hash (for rows that share an id),
    then the first in the text. Chunks of blank lines alone are never removed. Equal rows with equal ids
    count as one occurrence and keep the same lines. A null id comes after all others. Null texts stay
    null, empty texts empty; a text all of whose chunks were removed becomes empty. An empty table gives
    an empty one. Lines are separated by \\n; a chunk takes its line ends along.

    With `rule.pairs` chunks overlap: a line goes if a pair it lies in occurred before, `n_removed_chunks`
    counts the stretches of lines that go, and a pair that shares a line with the first one of its kind
    stays. Every line that goes still stands elsewhere, but where passages overlap not always beside the
    same neighbour. Blank lines go only between two lines of a pair.
    """
    source = packed(docs)
    text = F.col("row")[text_col]
    key = F.struct(
        F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("id"), F.xxhash64(text).alias("h")
    )
    rows = source.select(key.alias("doc"), F.coalesce(text, F.lit("")).alias("text"), "row")
    slim = _exploded(_cut(rows.select("doc", "text"), rule), "doc")
    slim = stored(slim.select("doc", F.col("c.first").alias("first"), F.col("c.n").alias("n"), F.col("c.hash").alias("hash")))
    # 64-bit hashes choose what has to be compared; counts are combined before the shuffle
    often = slim.groupBy("hash").agg(
        F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"),
        F.min("first").alias("low"), F.max("first").alias("high"),
    ).filter((F.col("least") != F.col("most")) | (F.col("low") != F.col("high"))).select("hash")
    suspects = attach(slim, stored(often), ["hash"], how="inner")
    marks = suspects.groupBy("doc").agg(F.collect_set(F.struct("first", "n", "hash")).alias("marks"))
    # the bytes of those chunks only
    # what is marked grows with the input: a join that shuffles at every size
    again = attach(rows.select("doc", "text"), stored(marks).hint("merge"), ["doc"], how="inner")
    chunks = let(F.split("text", "\n", -1), lambda lines: F.transform("marks", lambda m: F.struct(
        m["first"].alias("first"), m["n"].alias("n"), m["hash"].alias("hash"),
        F.array_join(F.slice(lines, m["first"], m["n"]), "\n").alias("content"))))
    pieces = _exploded(again.select("doc", chunks.alias("chunks")), "doc").select("doc", "c.*")
    pieces = stored(pieces.filter(_not_blank(F.col("content"))))
    firsts = pieces.groupBy("hash", "content").agg(F.min(F.struct("doc", "first")).alias("kept"))
    checked = attach(pieces, stored(firsts), ["hash", "content"], how="inner")
    gone = checked.filter(F.struct("doc", "first") != F.col("kept"))
    if rule.pairs:
        # the second line of the first pair stays with it: in a run of equal lines two stay
        end = F.col("kept.first") + F.col("n") - 1
        gone = gone.filter((F.col("doc") != F.col("kept.doc")) | (F.col("first") > end))
    removed = stored(gone.groupBy("doc").agg(F.collect_set(F.struct("first", "n")).alias("gone")))
    out = attach(rows, removed.hint("merge"), ["doc"])
    lines = F.split("text", "\n", -1)
    cover = F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["first"], g["first"] + g["n"] - 1))))
    out = out.withColumn("cover", F.sort_array(cover))
    stays = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("cover"))
    left = let(lines, lambda ls: F.transform(stays, lambda i: F.get(ls, i - 1)))
    n_chunks = F.size("gone")
    if rule.pairs:
        n_chunks = F.size(F.filter("cover", lambda x, k: (k == 0) | (x != F.get(F.col("cover"), k - 1) + 1)))
    clean = F.when(F.col("row")[text_col].isNull(), F.lit(None).cast("string")).when(
        F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return out.select(
        *(["row"] if keep else []), F.col("row")[id_col].alias("doc_id"), clean.alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("cover"), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce(n_chunks, F.lit(0)).cast("long").alias("n_removed_chunks"),
    )
