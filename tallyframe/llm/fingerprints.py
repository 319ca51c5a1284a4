"""Document fingerprints: invertible Bloom lookup tables over paragraph digests, in Spark expressions alone.

Every paragraph digest goes into one cell of each of three subtables; a cell keeps a count, the XOR of its
digests and the XOR of their checks. Two versions subtract cell by cell: what both hold cancels out. Cells
left with one digest are peeled off, which frees others, until all differing digests are recovered. If
cells remain, the difference was too large for the table, and a larger one is tried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import let, texts


@dataclass(frozen=True)
class SketchRule:
    """`cells`: cells per subtable of the fingerprint. A retry has `grow` times as many; the last two have
    as many as both versions have digests, and eight times as many. `rounds`: most peeling rounds of one try.
    `paragraph`: pieces of a line that end with a sentence after 60 characters or more, or else after 400."""

    cells: int = 16
    grow: int = 4
    rounds: int = 24
    paragraph: str = r"[^\n]{60,400}?[.!?](?=\s|$)|[^\n]{1,400}"


DEFAULT_RULE = SketchRule()
SUBTABLES = 3
_CELLS = "array<struct<cell:int,n:int,id:long,chk:long>>"


def digests(text: Column, rule: SketchRule = DEFAULT_RULE) -> Column:
    """Distinct 64-bit digests of the trimmed paragraphs that are not blank."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(rule.paragraph), F.lit(0)), lambda p: F.trim(p))
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(items: Column, cells: Column) -> Column:
    """The cells that items (struct<n, id>) fall into, before equal cells are joined."""
    def one(item: Column) -> Column:
        return let(_check(item["id"]), lambda chk: F.array(*[
            F.struct(
                (F.pmod(F.xxhash64(item["id"], F.lit(k)), cells) * SUBTABLES + k).cast("int").alias("cell"),
                item["n"].alias("n"), item["id"].alias("id"), chk.alias("chk"),
            )
            for k in range(SUBTABLES)
        ]))

    return F.flatten(F.transform(items, one))


def _joined(entries: Column) -> Column:
    """Sorted cells that are not empty: equal cells are added up. Linear after the sort."""
    def stretches(e: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(e) - 1),
            lambda i: F.when(i == 0, F.lit(True)).otherwise(F.get(e, i)["cell"] != F.get(e, i - 1)["cell"]),
        )

        def add(g: Column) -> Column:
            return F.aggregate(F.slice(g, F.lit(2), F.size(g)), F.get(g, F.lit(0)), lambda a, x: F.struct(
                a["cell"].alias("cell"), (a["n"] + x["n"]).alias("n"),
                a["id"].bitwiseXOR(x["id"]).alias("id"), a["chk"].bitwiseXOR(x["chk"]).alias("chk"),
            ))

        def cell(s: Column, n: Column) -> Column:
            return F.when(n == 1, F.get(e, s)).otherwise(let(F.slice(e, s + 1, n), add))

        def cells(st: Column) -> Column:
            return F.transform(st, lambda s, k: let(
                F.coalesce(F.get(st, k + 1), F.size(e)) - s, lambda n: cell(s, n)))

        return let(starts, cells)

    empty = F.array().cast(_CELLS)
    sums = let(F.sort_array(entries), lambda e: F.when(F.size(e) == 0, empty).otherwise(stretches(e)))
    return F.filter(sums, lambda c: (c["n"] != 0) | (c["id"] != 0) | (c["chk"] != 0))


def _items(ids: Column, n: int) -> Column:
    return F.transform(ids, lambda d: F.struct(F.lit(n).alias("n"), d.alias("id")))


def sketch(ids: Column, cells: Column | int) -> Column:
    """The table of a set of digests: its cells that are not empty, by number."""
    return _joined(_entries(_items(ids, 1), F.lit(cells) if isinstance(cells, int) else cells))


def _negative(table: Column) -> Column:
    return F.transform(table, lambda c: F.struct(
        c["cell"].alias("cell"), (-c["n"]).alias("n"), c["id"].alias("id"), c["chk"].alias("chk")))


def peel(mine: Column, other: Column, cells: Column, rule: SketchRule) -> Column:
    """struct<rest, found>: the cells that stay, and the recovered items (n = 1 only here, -1 only there)."""
    start = F.struct(
        _joined(F.concat(mine, _negative(other))).alias("rest"), F.array().cast("array<struct<n:int,id:long>>").alias("found"),
        F.lit(False).alias("done"),
    )

    def step(acc: Column, _: Column) -> Column:
        pure = F.filter(acc["rest"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["id"])))

        def of(side: int) -> Column:
            # distinct as plain numbers, which Spark hashes; structs it would compare pair by pair
            ids = F.transform(F.filter(pure, lambda c: c["n"] == side), lambda c: c["id"])
            return _items(F.array_distinct(ids), side)

        items = F.concat(of(1), of(-1))

        def taken(p: Column) -> Column:
            minus = F.transform(p, lambda x: F.struct((-x["n"]).alias("n"), x["id"].alias("id")))
            return F.struct(
                F.when(F.size(p) == 0, acc["rest"]).otherwise(
                    _joined(F.concat(acc["rest"], _entries(minus, cells)))).alias("rest"),
                F.concat(acc["found"], p).alias("found"), (F.size(p) == 0).alias("done"),
            )

        return F.when(acc["done"] | (F.size(acc["rest"]) == 0), acc).otherwise(let(items, taken))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rule.rounds)), start, step)


def with_likeness(rows: DataFrame, name: str, mine: str, other: str, tables: tuple[str, str], rule: SketchRule) -> DataFrame:
    """Adds `name`, the shared share of two digest sets from what their tables' difference recovers.

    `mine`, `other` name the digests, from which larger tables are made for the rows that need them;
    `tables` those of `rule.cells`. Each try is a column of its own, null where an earlier one succeeded.
    """
    a, b = F.col(mine), F.col(other)
    both = F.size(a) + F.size(b)
    sizes = [F.lit(rule.cells), *(F.lit(rule.cells * rule.grow**k) for k in (1, 2)), both + 16, both * 8 + 16]
    tries: list[str] = []
    for k, cells in enumerate(sizes):
        left, right = (F.col(t) for t in tables) if k == 0 else (sketch(a, cells), sketch(b, cells))
        result = peel(left, right, cells, rule)
        if tries:
            result = F.when(F.size(F.col(f"{tries[-1]}.rest")) > 0, result)
        tries.append(f"_{name}_{k}")
        rows = rows.withColumn(tries[-1], result)
    # the last look is for digests that share all their cells at every size
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    found = F.coalesce(*[F.when(F.size(F.col(f"{t}.rest")) == 0, F.size(F.col(f"{t}.found"))) for t in tries], exact)
    shared = (both - found) / 2
    share = F.when(both == 0, F.lit(1.0)).otherwise(shared / (both - shared))
    return rows.withColumn(name, share).drop(*tries)


def as_text(table: Column, cells: int) -> Column:
    """Cells as `cell.count.digest.check`, hexadecimal, after the size of the table."""
    shown = F.transform(table, lambda c: F.concat_ws(
        ".", c["cell"].cast("string"), c["n"].cast("string"), F.lower(F.hex(c["id"])), F.lower(F.hex(c["chk"]))))
    return F.concat(F.lit(f"{SUBTABLES * cells}:"), F.array_join(shown, ","))


def with_next(rows: DataFrame) -> DataFrame:
    """`doc_id, text, ids` gain `next`, struct<text, ids> of the next document by descending id.

    Ids are cut into ranges of about equal numbers of rows; each range is ordered by itself and gets a
    copy of the first document of the next range. Only range limits and first ids pass the driver.
    """
    spark = rows.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = rows.filter("doc_id IS NOT NULL")
    cuts = known.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    if cuts:
        block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id")))
    else:
        block = F.lit(0)
    placed = known.withColumn("block", block)
    heads = {r["block"]: r["head"] for r in known.select("doc_id").withColumn("block", block)
             .groupBy("block").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    follows = [(heads[after], before) for before, after in zip(order, order[1:] + order[:1], strict=True)]
    empty = spark.createDataFrame(follows, "doc_id long, block int")
    ghosts = known.join(F.broadcast(empty), "doc_id").select(*known.columns, "block")
    window = Window.partitionBy("block").orderBy("ghost", F.desc("doc_id"), "text")
    both = placed.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    led = both.withColumn("next", F.lead(F.struct("text", "ids")).over(window)).filter("NOT ghost")
    alone = rows.filter("doc_id IS NULL").withColumn("next", F.struct("text", "ids"))
    return led.select(*rows.columns, "next").unionByName(alone)


def fingerprint_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: SketchRule = DEFAULT_RULE
) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next` per row.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document by descending id; the first document follows the last. Null texts are empty; an
    empty text has no paragraphs, and two such texts are alike. Rows that share an id follow each other by
    text. A row with a null id is its own next document and no one else's. Other columns are not read, and
    an empty table gives an empty one.
    """
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = with_next(rows.withColumn("ids", digests(F.col("text"), rule)))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "ids", F.col("next.ids").alias("next_ids"), edited.alias("edited"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "ids", "next_ids",
        digests(F.col("edited"), rule).alias("edited_ids"),
    )
    rows = rows.select("*", *[sketch(F.col(c), rule.cells).alias(t) for c, t in (
        ("ids", "table"), ("edited_ids", "edited_table"), ("next_ids", "next_table"))])
    rows = with_likeness(rows, "near_edited", "ids", "edited_ids", ("table", "edited_table"), rule)
    rows = with_likeness(rows, "near_next", "ids", "next_ids", ("table", "next_table"), rule)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("table"), rule.cells).alias("fingerprint"),
        as_text(F.col("edited_table"), rule.cells).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
