"""Secrets in texts: key patterns, and windows of high entropy inside candidate strings.

The entropy of a window is kept by incremental counts: per step one character enters, one leaves, and
the sum of c * log2(c) changes by two terms. Spans are code points, the end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import let, texts

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdefABCDEF"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

KEYWORD = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class CharClass:
    """Strings over `letters` are candidates; a window of them counts from `bits` per character on."""

    name: str
    pattern: str
    letters: str
    bits: float


@dataclass(frozen=True)
class SecretRules:
    """`window`: characters per entropy window. `allowed`: patterns of candidates that are no secrets
    as a whole: words, numbers, identifiers with dashes, one repeated character.

    A window of 24 random characters has 3.49 bits per character in the median over 16 letters, 3.97 over
    base32 and 4.02 over 36; the thresholds of these classes lie below what one in a thousand has. A string
    may be found by several classes. Lower-case hex is a base kind."""

    window: int = 24
    classes: tuple[CharClass, ...] = (
        CharClass("hex_entropy", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9])", HEX, 2.8),
        CharClass("base64_entropy", r"[A-Za-z0-9+/_=-]{24,}", BASE64, 3.9),
        CharClass("upper_entropy", r"(?<![A-Za-z0-9])[A-Z0-9]{24,}(?![A-Za-z0-9])", UPPER + DIGITS, 3.3),
        CharClass("lower_entropy", r"(?<![A-Za-z0-9])[a-z0-9]{24,}(?![A-Za-z0-9])", LOWER + DIGITS, 3.4),
    )
    allowed: tuple[str, ...] = (
        r"[A-Za-z]+",
        r"[0-9]+",
        r"[A-Za-z]{1,20}(?:[-_/+=][A-Za-z0-9]{0,12})++",  # possessive: Java matches a repeated group by recursion
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
        r"(.)\1*",
    )


DEFAULT_RULES = SecretRules()
KINDS = ("assign", "access", "hex")  # fixed order of the base kinds; entropy kinds follow


def _spans(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """Leftmost non-overlapping matches as array<struct<begin, end, value>>.

    `needs`: every match holds one of these strings, which are cheaper to look for.
    The pieces between the matches and the matches themselves add up to the text, so positions are
    running sums of their lengths. Texts without a match are not split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<begin:int,end:int,value:string>>").alias("out"),
    )

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        one = F.struct(begin.alias("begin"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    possible = F.regexp_like(text, F.lit(pattern))
    if needs:
        possible = reduce(or_, [F.contains(text, F.lit(n)) for n in needs]) & possible
    return F.when(
        possible, F.aggregate(pairs, start, step, lambda acc: acc["out"])
    ).otherwise(start["out"])


def _entropy_runs(value: Column, letters: str, window: int, bits: float) -> Column:
    """Maximal runs of windows with at least `bits` per character, as array<struct<begin, end>>.

    H = log2(w) - sum(c * log2 c) / w. The counts are an array by letter.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    highest = (math.log2(window) - bits) * window + 1e-9  # largest sum of c * log2 c that still counts
    start = F.struct(
        F.array_repeat(F.lit(0), len(letters)).alias("counts"),
        F.lit(0.0).alias("total"),
        F.array().cast("array<struct<begin:int,end:int>>").alias("out"),
    )

    def at(i: Column) -> Column:
        return F.instr(F.lit(letters), F.substring(value, i + 1, 1)) - 1

    def step(acc: Column, i: Column) -> Column:
        enters = at(i)
        leaves = F.when(i >= window, at(i - window)).otherwise(F.lit(-1))

        def counted(m: Column) -> Column:
            here, gone = F.get(acc["counts"], m["enters"]), F.get(acc["counts"], m["leaves"])
            change = (F.get(weight, here + 1) - F.get(weight, here)) + F.when(
                m["leaves"] >= 0, F.get(weight, gone - 1) - F.get(weight, gone)).otherwise(0.0)
            return F.struct(
                F.when(m["enters"] == m["leaves"], acc["counts"]).otherwise(F.transform(
                    acc["counts"],
                    lambda c, k: c + F.when(k == m["enters"], 1).when(k == m["leaves"], -1).otherwise(0),
                )).alias("counts"),
                (acc["total"] + F.when(m["enters"] == m["leaves"], 0.0).otherwise(change)).alias("total"),
            )

        begin, end = i - (window - 1), i + 1
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        fresh = F.array(F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end")))
        longer = F.concat(
            F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1),
            F.array(F.struct(last["begin"].alias("begin"), end.cast("int").alias("end"))),
        )
        return let(let(F.struct(enters.alias("enters"), leaves.alias("leaves")), counted), lambda n: F.struct(
            n["counts"].alias("counts"), n["total"].alias("total"),
            F.when((begin < 0) | (n["total"] > highest), acc["out"])
            .when((F.size(acc["out"]) > 0) & (last["end"] >= begin), longer)
            .otherwise(F.concat(acc["out"], fresh)).alias("out"),
        ))

    steps = F.sequence(F.lit(0), F.length(value) - 1)
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _entropy_spans(c: CharClass, rules: SecretRules) -> Column:
    """Runs of the candidates of one class that no base span covers, as array<struct<begin, end, value>>."""
    allowed = F.lit("^(?:" + "|".join(f"(?:{p})" for p in rules.allowed) + ")$")
    candidates = F.filter(_spans(F.col("text"), c.pattern), lambda s: ~F.regexp_like(s["value"], allowed))

    def inside(s: Column) -> Column:
        return F.transform(_entropy_runs(s["value"], c.letters, rules.window, c.bits), lambda r: F.struct(
            (s["begin"] + r["begin"]).alias("begin"), (s["begin"] + r["end"]).alias("end"),
            F.substring(s["value"], r["begin"] + 1, r["end"] - r["begin"]).alias("value"),
        ))

    def uncovered(r: Column) -> Column:
        return ~F.exists("base", lambda b: (b["begin"] <= r["begin"]) & (b["end"] >= r["end"]))

    return F.filter(F.flatten(F.transform(candidates, inside)), uncovered)


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SecretRules = DEFAULT_RULES
) -> DataFrame:
    """One row per document: `doc_id`, `spans` as array<struct<begin, rank, kind, end, value>>, sorted.

    Base kinds are `assign` (group 2 of 6 characters or more), `access` and `hex`; the entropy kinds
    add windows of candidate strings that no `allowed` pattern matches as a whole and that no base
    span covers. Null and empty texts have no spans, a null id stays null, repeated rows each get
    their row, other columns are not read, and an empty table gives an empty one. A very long
    candidate costs its length times the size of its letter class.
    """
    rows = texts(docs, id_col, text_col)
    text = F.col("text")

    def kind(spans: Column, rank: int, name: str) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["begin"].alias("begin"), F.lit(rank).alias("rank"), F.lit(name).alias("kind"),
            s["end"].alias("end"), s["value"].alias("value"),
        ))

    # `+` and a later length check for assign, as a failing match still uses up its text; for the other
    # two a maximal run that is too short holds no longer match, so the length goes into the pattern
    assign = F.filter(
        _spans(text, KEYWORD, (":", "=")), lambda s: F.length(F.regexp_extract(s["value"], KEYWORD, 2)) >= 6
    )
    base = F.concat(
        kind(assign, 0, "assign"),
        kind(_spans(text, r"AKIA[A-Z0-9]{16,}", ("AKIA",)), 1, "access"),
        kind(_spans(text, r"[0-9a-f]{24,}"), 2, "hex"),
    )
    rows = rows.select("doc_id", "text", base.alias("base"))
    added = [kind(_entropy_spans(c, rules), rank, c.name) for rank, c in enumerate(rules.classes, start=len(KINDS))]
    return rows.select("doc_id", F.array_sort(F.concat(F.col("base"), *added)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_report(docs: DataFrame, rules: SecretRules = DEFAULT_RULES) -> DataFrame:
    """`doc_id`, the counts of the base kinds, the digest of the base spans and all spans as text."""
    found = scan_secrets(docs, rules=rules)
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
