"""Joins and reductions that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SkewPolicy:
    """Sizes from which a contact block is treated as a hot one.

    `hot_block`: master names of one contact compared one by one; larger blocks are segmented.
    `task_pairs`: name pairs of one contact that one task should score.
    """

    hot_block: int = 256
    task_pairs: int = 2_000_000


DEFAULT_POLICY = SkewPolicy()

# Session settings the joins below count on; the first two are Spark's defaults.
SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def fits_broadcast(*tables: DataFrame) -> bool:
    """Whether Catalyst's size estimates, read without running anything, stay below the session's
    broadcast threshold all together. Estimates of stored tables are their file sizes."""
    conf = tables[0].sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    limit = int(conf[:-1]) * units[conf[-1]] if conf[-1:] in units else int(conf)
    try:
        return sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables) <= limit
    except AttributeError:  # no local planner, as on a remote client
        return False


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", small: bool = False) -> DataFrame:
    """Join the many rows of `left` to the few rows per key of `right`.

    Adaptive execution splits the partition of a hot key (or of the null key) of `left` over
    several tasks, but only where both sides come straight from a shuffle made for the join. A
    reduced right side would keep the partitioning of its reduction instead, and Spark drops a
    plain repartition there. Joining on a hash of the key as well asks for a partitioning that
    neither side has. If `small` says that the right side is known to fit a broadcast, `left`
    need not move at all and the plain join is left to Catalyst.
    """
    on = list(on)
    if small:
        return left.join(right, on, how)
    mark = F.xxhash64(*on)
    return left.withColumn("_h", mark).join(right.withColumn("_h", mark), [*on, "_h"], how).drop("_h")


def first_row(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key in the given order.

    Spark limits the rank before the shuffle as well, so a hot key sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")
