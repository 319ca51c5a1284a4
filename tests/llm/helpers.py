"""Small tables with every awkward case, shared by the tests of the operators."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, row string, _h string, component_id string, size long, block string"


def prose(seed: int, n: int) -> str:
    """n invented words, the same for a seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join("aeioubcdfglmnprst"[(x >> s) % 17] for s in (3, 7, 11, 15, 19)[: 2 + x % 4]))
    return " ".join(out)


def awkward_texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 120)
    words = base.split(" ")
    return [
        (1, base), (2, base), (2, base), (3, " ".join([*words[:60], "changed", *words[61:]])),
        (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "one two"), (9, "One TWO"),
        (10, prose(2, 20_000)), (11, prose(2, 20_000) + " tail"), (None, base), (None, prose(3, 30)), (None, None),
        (12, "É\n" + prose(4, 80)), (13, "x" * 5_000), (14, "x" * 5_010),
    ]


def awkward(spark):
    """Awkward documents with columns whose names the operators use for themselves."""
    rows = [(i, t, "s", "r", "h", "c", 7, "b") for i, t in awkward_texts()]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
