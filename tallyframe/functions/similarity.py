"""Name similarity: normalised insert/delete similarity of token-sorted names, 0 to 100."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _indel_ratio() -> Callable[[str, str], float]:
    """Build the scorer; nested so that it travels to the workers by value."""

    def ratio(a: str, b: str) -> float:
        total = len(a) + len(b)
        if total == 0:
            return 100.0
        if a == b:
            return 100.0
        # Longest common subsequence, one machine-word-like integer per character of b.
        where: dict[str, int] = {}
        for i, ch in enumerate(a):
            where[ch] = where.get(ch, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for ch in b:
            hits = row & where.get(ch, 0)
            row = ((row + hits) | (row - hits)) & full
        common = len(a) - row.bit_count()
        return (1.0 - (total - 2 * common) / total) * 100.0

    return ratio


indel_ratio = _indel_ratio()


def _score_udf():
    ratio = _indel_ratio()

    def score(batches):
        import pandas as pd

        for left, right in batches:
            yield pd.Series([ratio(x, y) for x, y in zip(left, right)], dtype="float64")

    from collections.abc import Iterator

    import pandas as pd

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, T.DoubleType())


def sorted_name_score(left: Column, right: Column) -> Column:
    """Score of two names whose tokens are already sorted.

    All pairs go through the Arrow scorer, equal ones at no more than a comparison; callers filter the
    pairs by `can_reach` first.
    """
    return _score_udf()(left, right)


def can_reach(left: str, right: str, threshold: str) -> Column:
    """Whether two names may score `threshold` or more; false only if they cannot.

    A score leaves room for (1 - threshold) of all characters to be added or removed. The length
    difference and the edit distance are lower bounds of that number. Both stay in the JVM, the
    second one gives up as soon as the room is used.
    """
    room = f"CAST(floor((1 - {threshold} / 100) * (length({left}) + length({right})) + 1e-9D) AS INT)"
    return F.expr(
        f"abs(length({left}) - length({right})) <= {room} AND levenshtein({left}, {right}, {room}) >= 0"
    )
