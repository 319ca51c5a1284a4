"""Tables stored in an order, so that any page of them is read from one place.

Rows are sorted over ranges of the order; each keeps the number of its range (`part`, a folder) and its
place in it (`pos`). A small table holds the rows of every range and those before it. A page is then a
range of places, which selects folders by name and, inside them, pages of the files by their statistics.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ("part", "pos")
_WITHIN = 33  # bits of a row's number inside its task


def _folder(spark: SparkSession, path: str):
    """File system and path object of a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _folder(spark, path)
    return system.exists(at)


def publish(spark: SparkSession, made: str, path: str) -> bool:
    """Give a finished folder its name. False if another writer was first; what was made is then deleted."""
    system, source = _folder(spark, made)
    _, target = _folder(spark, path)
    system.mkdirs(target.getParent())
    if not system.exists(target) and system.rename(source, target) and not system.exists(
            spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, source.getName())):
        return True
    # a rename onto a folder that appeared meanwhile moves into it
    system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, source.getName()), True)
    system.delete(source, True)
    return False


class OrderedTable:
    """A table stored in an order. Reading a page costs what the page holds, whatever its number."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path
        # a table without rows has no folder to take its columns from
        self.rows = spark.read.schema(spark.read.parquet(f"{path}/layout").schema).parquet(f"{path}/rows")
        self.parts = spark.read.parquet(f"{path}/parts")

    @classmethod
    def write(cls, df: DataFrame, order: Sequence[Column], path: str) -> OrderedTable:
        """Store `df` under `path`, unless it is there already, and open it.

        Rows that are equal in `order` keep one arbitrary order from then on. A value that many rows share
        is spread over several ranges as long as the rest of `order` tells its rows apart.
        """
        spark = df.sparkSession
        if not exists(spark, path):
            made = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
            ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
            placed = ranged.select(
                *df.columns, F.shiftright("_n", _WITHIN).cast("int").alias("part"),
                F.col("_n").bitwiseAND(F.lit((1 << _WITHIN) - 1)).alias("pos"))
            placed.write.partitionBy("part").parquet(f"{made}/rows")
            placed.limit(0).write.parquet(f"{made}/layout")
            # as many rows as ranges
            sizes = spark.read.schema(placed.schema).parquet(f"{made}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
            before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            sizes.coalesce(1).withColumn("before", before).write.parquet(f"{made}/parts")
            publish(spark, made, path)
        return cls(spark, path)

    def count(self) -> int:
        return self.parts.agg(F.sum("n")).first()[0] or 0

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number`, counted from 1; empty after the last one."""
        return self.slice((number - 1) * size, size)

    def slice(self, first: int, size: int) -> DataFrame:
        """`size` rows from row `first` on (counted from 0), in order."""
        hit = self.parts.filter((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).collect()
        ranges = [(r.part, max(0, first - r.before), min(r.n, first + size - r.before)) for r in hit]
        tests = [(F.col("part") == p) & (F.col("pos") >= lo) & (F.col("pos") < hi) for p, lo, hi in ranges]
        return self.rows.filter(reduce(or_, tests, F.lit(False))).orderBy(*PLACE)

    def after(self, part: int, pos: int, size: int) -> DataFrame:
        """The `size` rows that follow a place, as the last row of a page names it."""
        here = self.parts.filter(F.col("part") == part).first()
        return self.slice(here.before + pos + 1, size) if here else self.slice(0, 0)
