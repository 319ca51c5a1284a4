"""Exact dedup: blocks of rows exchange Golomb-coded fingerprints, only suspects are shuffled and compared.

Every block of rows sorts the distinct prefixes of its text hashes, cuts them by ranges, each of which has
an owner, and sends each owner one Golomb code of the gaps. The prefixes are a few bits longer than the
number of rows needs, so that a code takes a few bytes per row and rarely two texts share a prefix. Owners
answer with one bit per prefix: whether it came from more than one block. Rows whose bit is set, or whose
prefix occurs twice in their own block, are suspects; their texts are grouped byte by byte.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructType

from tallyframe.llm.common import packed, stored
from tallyframe.operators.skew import attach

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class ExchangeRule:
    """`spare_bits`: bits of a prefix beyond those that number the rows, so that about one row in
    2 ** spare_bits is a suspect by chance. `block_rows`, `block_bytes`: rows and bytes of text after which
    a block ends. `owner_rows`: rows per owner, about. `map_bytes`: bits and their keys sent to all tasks
    at once; more are taken in slices of blocks."""

    spare_bits: int = 10
    block_rows: int = 1 << 16
    block_bytes: int = 32 << 20
    owner_rows: int = 1 << 18
    map_bytes: int = 32 << 20


DEFAULT_RULE = ExchangeRule()
HEAD = struct.Struct("<IBI")


def encode(values: np.ndarray, width: int) -> bytes:
    """Golomb code (divisor a power of two) of rising numbers below 2 ** width: all quotients in unary, then
    all remainders."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    k = max(0, math.floor(math.log2(max(1.0, math.log(2) * 2.0**width / max(1, len(values))))))
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1
    first = np.packbits(unary).tobytes()
    return HEAD.pack(len(values), k, len(first)) + first + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def decode(code: bytes) -> np.ndarray:
    """The numbers of a code."""
    n, k, size = HEAD.unpack_from(code)
    unary = np.unpackbits(np.frombuffer(code, np.uint8, size, HEAD.size))
    quotients = np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=HEAD.size + size))[: n * k].reshape(n, k)
    rest = bits.astype(np.int64) @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0
    return np.cumsum((quotients << k) + rest)


def _block(table: pa.Table, block: int, bits: int, owner_bits: int) -> pa.Table:
    """The rows of a block with the place of their prefix, and each code at the first row of its owner."""
    prefix = (table.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    known, first, place, count = np.unique(prefix, return_index=True, return_inverse=True, return_counts=True)
    width = bits - owner_bits
    owner = known >> width
    owners, start = np.unique(owner, return_index=True)
    codes: list[bytes | None] = [None] * len(prefix)
    for a, b in zip(start, [*start[1:], len(known)]):
        codes[first[a]] = encode(known[a:b] & ((1 << width) - 1), width)
    rank = place - start[np.searchsorted(owners, owner[place])]
    added = {
        "block": pa.array(np.full(len(prefix), block, np.int64)),
        "at": pa.array((block << 20) + np.arange(len(prefix), dtype=np.int64)),
        "owner": pa.array(owner[place]), "rank": pa.array(rank.astype(np.int32)),
        "twice": pa.array(count[place] > 1), "code": pa.array(codes, pa.binary()),
    }
    for name, column in added.items():
        table = table.append_column(name, column)
    return table


def _blocks(bits: int, owner_bits: int, rule: ExchangeRule):
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rule.block_rows):
                part = batch.slice(lo, rule.block_rows)
                if held and (rows + part.num_rows > rule.block_rows or size + part.nbytes > rule.block_bytes):
                    yield from _block(pa.Table.from_batches(held), number, bits, owner_bits).to_batches()
                    held, rows, size, number = [], 0, 0, number + 1
                held.append(part)
                rows, size = rows + part.num_rows, size + part.nbytes
        if held:
            yield from _block(pa.Table.from_batches(held), number, bits, owner_bits).to_batches()

    return tasks


def _answer(codes: pd.DataFrame) -> pd.DataFrame:
    """Per block that sent a code, one bit for each number that another block sent too."""
    lists = [decode(c) for c in codes["code"]]
    sizes = [len(v) for v in lists]
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    equal = values[order][1:] == values[order][:-1]
    shared = np.zeros(len(values), bool)
    shared[order[1:]] |= equal
    shared[order[:-1]] |= equal
    out = []
    for block, owner, mine in zip(codes["block"], codes["owner"], np.split(shared, np.cumsum(sizes)[:-1])):
        if mine.any():
            padded = np.zeros(-(-len(mine) // 64) * 64, np.uint8)
            padded[: len(mine)] = mine
            out.append((block, owner, np.packbits(padded, bitorder="little").view("<i8").tolist()))
    return pd.DataFrame(out, columns=["block", "owner", "bits"])


def _suspected(prints: DataFrame, maps: DataFrame, rule: ExchangeRule) -> DataFrame:
    """`prints` with `suspect`. The bits go to all tasks, `map_bytes` of them at a time: a slice of blocks each."""
    size = maps.agg(F.sum(F.size("bits") * 8 + 24)).first()[0] or 0
    slices = max(1, -(-size // rule.map_bytes))
    bounds = [None, *_cuts(maps, slices), None]
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        within = F.lit(True)
        if lo is not None:
            within &= F.col("block") > lo
        if hi is not None:
            within &= F.col("block") <= hi
        both = prints.filter(within).join(F.broadcast(maps.filter(within)), ["block", "owner"], "left")
        word = F.get("bits", F.shiftright("rank", 6))
        marked = F.coalesce(F.bit_get(word, F.col("rank") % 64) == 1, F.lit(False))
        out.append(both.withColumn("suspect", F.col("twice") | marked).drop("bits"))
    return reduce(DataFrame.unionByName, out)


def _cuts(maps: DataFrame, slices: int) -> list[int]:
    if slices < 2:
        return []
    shares = [i / slices for i in range(1, slices)]
    return sorted(set(maps.agg(F.percentile_approx("block", shares, 100 * slices)).first()[0]))


def dedup_exact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: ExchangeRule = DEFAULT_RULE,
    keep: bool = False, fingerprint=F.xxhash64,
) -> DataFrame:
    """`doc_id, keep_id, group_size, kept, text_sha256` of every row; with `keep`, the row before it as `row`.

    Texts are equal if they are the same bytes once runs of ASCII white space are one space; a null text is
    empty, and all empty ones are equal. Of equal texts the row with the smallest id stays. A null id comes
    after all others; of rows with the same id and text, or of null ids alone, exactly one stays. An empty
    table gives an empty one, other columns are not read. `fingerprint` takes the text to a 64-bit number;
    texts that share one are told apart by their bytes.
    """
    total = docs.count()
    bits = min(60, math.ceil(math.log2(total + 1)) + rule.spare_bits)
    owner_bits = min(bits, math.ceil(math.log2(max(1, total / rule.owner_rows))))
    whole = packed(docs)
    text = F.regexp_replace(F.coalesce(F.col("row")[text_col], F.lit("")), SPACE, " ")
    rows = whole.select(*(["row"] if keep else []), F.col("row")[id_col].alias("doc_id"), text.alias("text"))
    rows = rows.select("*", fingerprint("text").alias("h"), F.sha2("text", 256).alias("text_sha256"))
    schema = StructType(list(rows.schema.fields))
    for name, kind in (("block", LongType()), ("at", LongType()), ("owner", LongType()), ("rank", IntegerType()),
                       ("twice", BooleanType()), ("code", BinaryType())):
        schema = schema.add(name, kind)
    prints = stored(rows.mapInArrow(_blocks(bits, owner_bits, rule), schema))
    codes = prints.filter("code IS NOT NULL").select("owner", "block", "code")
    maps = stored(codes.groupBy("owner").applyInPandas(_answer, "block long, owner long, bits array<bigint>"))
    looked = _suspected(prints.drop("code"), maps, rule)
    single = looked.filter("NOT suspect").select(
        "*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("at").alias("keep_at"))
    suspects = looked.filter("suspect")
    # one row per text and task is sent on; the key compares bytes
    groups = stored(suspects.groupBy("h", "text").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
        F.coalesce(F.min_by("at", "doc_id"), F.min("at")).alias("keep_at")))
    clash = stored(groups.groupBy("h").count().filter("count > 1").select("h"))
    # where a fingerprint has one text only, it stands for the text
    found = attach(suspects.drop("text"), groups.drop("text").join(clash, "h", "left_anti"), ["h"], how="inner")
    wanted = [*(["row"] if keep else []), "doc_id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"),
              "text_sha256"]
    out = single.select(*wanted).unionByName(found.select(*wanted))
    if clash.isEmpty():
        return out
    same = attach(suspects.join(clash, "h", "left_semi"), groups, ["h", "text"], how="inner")
    return out.unionByName(same.select(*wanted))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: ExchangeRule = DEFAULT_RULE) -> DataFrame:
    """The rows that stay, with all columns."""
    return dedup_exact(docs, id_col, text_col, rule, keep=True).filter("kept").select("row.*")
