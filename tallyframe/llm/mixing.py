"""Mixing sources to target weights by hash thresholds.

Every document has a hash of its id. A source takes each document a whole number of times and, for the
rest of its target, those with the smallest hashes once more. The threshold comes from histograms of
sizes by source and hash bucket: the bucket in which the budget ends is cut into finer buckets, level by
level, so no source is ever sorted or brought together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import WORD, packed, stored
from tallyframe.operators.skew import attach


@dataclass(frozen=True)
class MixPlan:
    """`weights` go to the sources in code point order, repeating; `copies` is the most often a document
    is taken; `hash_bits` are used in steps of `bucket_bits` per histogram."""

    weights: Sequence[int] = (5, 2, 1)
    copies: int = 3
    hash_bits: int = 60
    bucket_bits: int = 10


DEFAULT_PLAN = MixPlan()


def hash_of(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text, the same in other engines."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """Adds `ordinal`, 0 for the first in code point order, null last.

    Ranges of names are ranked in parallel; only the number of rows per range goes through the driver.
    """
    spark = sources.sparkSession
    key = [F.col(name).isNull(), F.col(name)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(sources.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id()))
    counts = sorted(ranged.groupBy("_part").count().collect())
    before, offsets = 0, {}
    for part, count in counts:
        offsets[part], before = before, before + count
    shift = F.create_map(*[F.lit(x) for item in offsets.items() for x in item]) if offsets else None
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*key)) - 1
    start = F.element_at(shift, F.col("_part")) if offsets else F.lit(0)
    return ranged.withColumn("ordinal", inside + start).drop("_part")


def targets(sources: DataFrame, plan: MixPlan = DEFAULT_PLAN) -> DataFrame:
    """`source, source_size` gain `target`: the shares of all sizes by weight; what exceeds `copies` times
    a source's size is shared out again by weight until no source exceeds it.

    Each round is one aggregate over the sources; a round that caps no further source is the last.
    """
    rows = ranked(sources, "source")
    cycle = F.array(*[F.lit(w) for w in plan.weights])
    weight = F.element_at(cycle, (F.col("ordinal") % len(plan.weights)).cast("int") + 1)
    rows = stored(rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * plan.copies))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    unit, capped = 0.0, -1
    while True:
        # the unit only grows, so a source once capped stays so
        over = F.col("weight") * F.lit(unit) > F.col("cap")
        fixed, free, count = rows.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)),
            F.sum(F.when(~over, F.col("weight"))),
            F.count(F.when(over, 1)),
        ).first()
        if count == capped or not free:
            break
        unit, capped = (total - fixed) / free, count
    target = F.when(F.col("weight") * F.lit(unit) > F.col("cap"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.lit(unit))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, plan: MixPlan = DEFAULT_PLAN) -> DataFrame:
    """The largest hash each source takes once more: `source, threshold`.

    `sized`: `source, hash, size`; `budgets`: `source, budget`. The sizes up to the threshold come as near
    to the budget as whole documents allow, from below if two are as near. Per level one histogram by
    source and bucket; only rows of the bucket in which the budget ends go on to the next level.
    """
    rows = sized
    at = budgets.select("source", F.col("budget").cast("double").alias("budget"), F.lit(0.0).alias("taken"))
    by_hash = Window.partitionBy("s").orderBy("b")
    levels = list(range(plan.hash_bits - plan.bucket_bits, -1, -plan.bucket_bits))
    for shift in levels:
        bucket = F.shiftright(F.col("hash"), shift)
        cells = rows.groupBy(F.col("source").alias("s"), bucket.alias("b")).agg(F.sum("size").cast("double").alias("n"))
        cells = cells.join(at, F.col("s").eqNullSafe(F.col("source")))
        upto = F.col("taken") + F.sum("n").over(by_hash)
        cells = cells.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        # one bucket per source: the first that reaches beyond the budget
        ends = cells.filter((F.col("upto") > F.col("budget")) & (F.col("before") <= F.col("budget")))
        ends = ends.withColumn("_first", F.row_number().over(by_hash)).filter("_first = 1")
        if shift:
            at = stored(ends.select("source", "budget", F.col("before").alias("taken"), F.col("b").alias("low")))
            rows = stored(_inside(rows, at, shift))
        else:
            # single hashes: the last one goes along if that comes nearer
            nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("before")
            return ends.select("source", F.when(nearer, F.col("b")).otherwise(F.col("b") - 1).alias("threshold"))
    raise ValueError("hash_bits must be a multiple of bucket_bits")


def _inside(rows: DataFrame, at: DataFrame, shift: int) -> DataFrame:
    """Rows of the bucket named for their source; the hash alone picks most of them, so this join is by both."""
    left = rows.withColumn("b", F.shiftright(F.col("hash"), shift)).alias("l")
    right = at.select(F.col("source").alias("s"), F.col("low")).alias("r")
    same = F.col("l.source").eqNullSafe(F.col("r.s")) & (F.col("l.b") == F.col("r.low"))
    return left.join(right, same).select("l.source", "l.hash", "l.size")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    plan: MixPlan = DEFAULT_PLAN, keep: bool = False,
) -> DataFrame:
    """`doc_id, size, source_size, target, taken` per document; with `keep`, all its columns as `row` first.

    The size is the number of words, a null text having none. Targets add up to all sizes. A null source
    is a source of its own, ranked last. Documents of one id (repeated rows, null ids) share a hash and are
    taken together. Sources without words get a target of 0 and take nothing. An empty table gives an
    empty one. The result depends on ids, sources and sizes alone, so reruns agree.
    """
    sized = stored(docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"),
        hash_of(docs[id_col]).alias("hash"), size_of(docs[text_col]).alias("size"),
    ))
    shares = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), plan))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    shares = shares.withColumn("full", F.least(full, F.lit(plan.copies)).cast("long"))
    rest = F.col("target") - F.col("full") * F.col("source_size")
    budgets = shares.filter(F.col("full") < plan.copies).select("source", rest.alias("budget"))
    limit = thresholds(sized.filter("size > 0").select("source", "hash", "size"), budgets, plan)
    shares = stored(_by_source(shares, limit))
    decided = _decide(sized, shares)
    if not keep:
        return decided.select("doc_id", "size", "source_size", "target", "taken")
    rows = packed(docs).select(
        "row", F.col("row")[id_col].alias("doc_id"), F.col("row")[source_col].cast("string").alias("source"),
        hash_of(F.col("row")[id_col]).alias("hash"), size_of(F.col("row")[text_col]).alias("size"),
    )
    return _decide(rows, shares).select("row", "doc_id", "size", "source_size", "target", "taken")


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the source, null with null, without moving a hot source into one task."""
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    out = attach(left.withColumn("_k", key), right.withColumn("_k", key).drop("source"), ["_k"])
    return out.drop("_k")


def _decide(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """`taken`: whole takes by the source, one more up to its threshold."""
    more = F.when(F.col("hash") <= F.col("threshold"), 1).otherwise(0)
    return _by_source(rows, shares).withColumn("taken", F.col("size") * (F.col("full") + more))
