"""A trigram index over the texts of a stored table: a search reads the rows that can hold the text.

For every row the trigrams of its searched texts are stored with the row's place, sorted by trigram. A
trigram that a large share of the rows hold tells nothing and has no postings, only its count. A search
takes the rarest trigrams of its text, intersects their places, reads those rows and looks at them again;
a text without a trigram of use is looked for in all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.skew import attach
from tallyframe.sources.ordered import PLACE, OrderedTable, exists, publish
from tallyframe.storage import spread


@dataclass(frozen=True)
class IndexRule:
    """`common`: share of the rows from which a trigram has no postings. `grams`: trigrams of a text that
    are looked up, the rarest ones. `named_places`: places up to which the scan is told them one by one, so
    that it skips pages of its files; more are joined."""

    common: float = 0.05
    grams: int = 4
    named_places: int = 2_000


DEFAULT_RULE = IndexRule()


def _grams(low: Column) -> Column:
    """The trigrams of a text in lower case. The pattern looks at the three code points from every place on; half
    a surrogate pair is none."""
    return F.regexp_extract_all(low, F.lit(r"(?=(\P{Cs}{3}))"), F.lit(1))


def held_grams(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(part, pos, gram) of every trigram a row holds. The texts are put in lower case first and then moved, so
    that this is done once per text and not once per trigram."""
    texts = rows.select(*PLACE, *[F.lower(F.coalesce(c, F.lit(""))).alias(f"_low{i}") for i, c in enumerate(columns)])
    every = F.array_distinct(F.concat(*[_grams(F.col(f"_low{i}")) for i in range(len(columns))]))
    return spread(texts, *PLACE, light=True).select(*PLACE, F.explode(every).alias("gram"))


class TextIndex:
    """Substring search in a stored table, without regard to case."""

    def __init__(self, table: OrderedTable, spark: SparkSession, path: str, columns: Sequence[str], rule: IndexRule) -> None:
        self._table, self._columns, self._rule = table, list(columns), rule
        self.counts = spark.read.parquet(f"{path}/counts")
        self.postings = spark.read.parquet(f"{path}/postings")

    @classmethod
    def write(cls, table: OrderedTable, columns: Sequence[str], path: str, rule: IndexRule = DEFAULT_RULE) -> TextIndex:
        """Store the index of some text columns under `path`, unless it is there already, and open it."""
        spark = table.rows.sparkSession
        if not exists(spark, path):
            made = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
            held = held_grams(table.rows, columns)
            counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{made}/counts")
            usual = spark.read.schema(counts.schema).parquet(f"{made}/counts").filter(F.col("n") > rule.common * table.count())
            # at most the grams of a row divided by the share are that common: a short list
            rare = held.join(F.broadcast(usual.select("gram")), "gram", "left_anti")
            # the place belongs to the range, so that one gram may span several
            rare.repartitionByRange("gram", *PLACE).sortWithinPartitions("gram", *PLACE).write.parquet(f"{made}/postings")
            publish(spark, made, path)
        return cls(table, spark, path, columns, rule)

    def _rarest(self, text: str) -> list | None:
        """The rarest trigrams of a text, rarest first; None if one occurs nowhere."""
        grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
        known = self.counts.filter(F.col("gram").isin(grams)).collect() if grams else []
        if len(known) < len(grams):
            return None
        limit = self._rule.common * self._table.count()
        return sorted((r for r in known if r.n <= limit), key=lambda r: (r.n, r.gram))[: self._rule.grams]

    def candidates(self, text: str) -> DataFrame | None:
        """Rows that hold the rarest trigrams of a text, or None where no trigram is of use."""
        rows = self._table.rows
        chosen = self._rarest(text.lower())
        if chosen is None:
            return rows.limit(0)
        if not chosen:
            return None
        hits = self.postings.filter(F.col("gram").isin([r.gram for r in chosen])).groupBy(*PLACE).agg(
            F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(chosen)).drop("_n")
        if chosen[0].n > self._rule.named_places:
            return attach(rows, hits, PLACE, "left_semi")
        places: dict[int, list[int]] = {}
        for r in hits.collect():
            places.setdefault(r.part, []).append(r.pos)
        tests = [(F.col("part") == part) & F.col("pos").isin(at) for part, at in sorted(places.items())]
        return rows.filter(reduce(or_, tests, F.lit(False)))

    def search(self, text: str) -> DataFrame:
        """The rows of which a column holds the text."""
        found = self.candidates(text)
        low = F.lit(text.lower())
        return (self._table.rows if found is None else found).filter(
            reduce(or_, [F.coalesce(F.contains(F.lower(c), low), F.lit(False)) for c in self._columns]))
