"""Source divergence audit: how far the sources of a language use their terms differently.

Chunk factorization: texts are cut at white space, and a block of documents becomes a list of its distinct
chunks plus, per document, places in that list with counts. Only the lists are shuffled: each globally
distinct chunk is cut into terms once, the numbers of its terms are joined back to the blocks that hold it,
and each block sums documents and occurrences per group and term before they are added up over the blocks.
Case and punctuation that terms do not keep are folded first, so that they make no chunks of their own.
Terms and groups are numbers until the report is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import discard, stored
from tallyframe.operators.skew import attach, fits_broadcast

# Terms are runs of letters A-Z and of anything beyond ASCII, so no term crosses white space.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Bytes of a chunk: white space as one space, letters in lower case, beyond ASCII as they are, others as one mark.
FOLDED = bytes(
    c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else ord(" ") if chr(c) in " \t\n\v\f\r" else ord(".")
    for c in range(256)
)
BLOCKS = "block long, chunks array<string>, docs binary, pairs binary, n_pairs long"
CUT_AT_ONCE = 1 << 21  # bytes of texts that are cut at a time, at most, but for the last one's
GATHERED = 100_000  # chunks whose terms are packed at a time
PART_CELLS = 2_000_000  # cells that a task adds up, at most, but for those of one term
PAIRS_AT_ONCE = 1 << 18
ENTRIES = 1 << 17  # terms of documents that a block counts at a time, but for those of one document
CELLS = "gid long, tid long, docs long, n long"


@dataclass(frozen=True)
class AuditRule:
    """`least_docs`: documents of a language that a term must occur in. `scale`: what probabilities are
    multiplied by, at most 2,000,000,000, so that squares stay exact. `top`: ranks of the terms of a group that are reported. `block_bytes`: text after which a
    block ends; a longer document is a block of its own."""

    least_docs: int = 10
    scale: int = 1_000_000_000
    top: int = 10
    block_bytes: int = 16 << 20


DEFAULT_RULE = AuditRule()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed bytes."""
    raw = b"".join(len(c).to_bytes(8, "little") + c.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


def _joined(blobs: pa.ChunkedArray, *kinds: type) -> list[np.ndarray]:
    """Columns of several packs, one after the other."""
    return [np.concatenate(c) for c in zip(*(unpack(b.as_py(), *kinds) for b in blobs))]


def _folded(raw: bytes) -> bytes:
    """A text with the same terms and fewer distinct chunks: letters A-Z in lower case, and one mark for a run of what
    is neither a letter nor white space, which goes where it ends or begins a chunk. Of long runs more may stay."""
    marked = raw.translate(FOLDED).replace(b"..", b".").replace(b"..", b".")
    return marked.replace(b". ", b" ").replace(b" .", b" ").strip(b" .")


class Block:
    """Documents as places in a list of distinct chunks, with counts."""

    def __init__(self) -> None:
        self.groups: list[int] = []
        self.texts: list[bytes] = []
        self.chunks: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.waiting = 0

    def add(self, group: int, raw: bytes) -> None:
        self.groups.append(group)
        self.texts.append(raw)
        self.size += len(raw)
        self.waiting += len(raw)
        if self.waiting >= CUT_AT_ONCE:
            self._cut()

    def _cut(self) -> None:
        """Count the chunks of the documents that wait, by places in a list of their own."""
        # cut at ASCII white space alone; an empty text or white space at its ends gives an empty chunk, without terms
        cut = pc.ascii_split_whitespace(pa.array(self.texts, pa.string()))
        found = cut.flatten().dictionary_encode()
        n = len(found.dictionary)
        pair = np.repeat(np.arange(len(self.texts), dtype=np.int64), np.diff(cut.offsets.to_numpy())) * n
        pair += found.indices.to_numpy()
        pair.sort()
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        doc, place = np.divmod(pair[first], n)
        self.chunks.append(found.dictionary)
        count = np.diff(first, append=len(pair))
        sizes = np.bincount(doc, minlength=len(self.texts))
        self.parts.append(tuple(c.astype(np.int32) for c in (sizes, place, count)))
        self.texts, self.waiting = [], 0

    def row(self, number: int) -> pa.RecordBatch:
        if self.texts:
            self._cut()
        found = pa.chunked_array(self.chunks).dictionary_encode().unify_dictionaries()
        sizes, places, counts = zip(*self.parts)
        place = np.concatenate([c.indices.to_numpy()[p] for c, p in zip(found.chunks, places, strict=True)])
        docs = pack(np.array(self.groups, np.int64), np.concatenate(sizes))
        pairs = pack(place, np.concatenate(counts))
        chunks = found.chunk(0).dictionary
        chunks = pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks)
        columns = [pa.array([number], pa.int64()), chunks, pa.array([docs], pa.binary()), pa.array([pairs], pa.binary()),
                   pa.array([len(place)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["block", "chunks", "docs", "pairs", "n_pairs"])


def _counted(rule: AuditRule):
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for gid, raw in zip(batch.column("gid").to_pylist(), batch.column("raw")):
                raw = raw.as_py()
                if block.groups and block.size + len(raw) > rule.block_bytes:
                    yield block.row(number)
                    number, block = number + 1, Block()
                block.add(gid, _folded(raw))
        if block.groups:
            yield block.row(number)

    return tasks


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of the terms of chunks, packed by the block they go back to."""
    for batch in batches:
        home, place = (batch.column(c).to_numpy() for c in ("home", "place"))
        ids = batch.column("tids")
        length = np.diff(ids.offsets.to_numpy()).astype(np.int32)
        order = np.argsort(home, kind="stable")
        ids = ids.take(pa.array(order)).flatten().to_numpy()
        home, place, length = home[order], place[order], length[order]
        first = np.flatnonzero(np.diff(home, prepend=-1))
        ends = np.concatenate([[0], np.cumsum(length)])
        blobs = [pack(place[a:b], length[a:b], ids[ends[a] : ends[b]]) for a, b in zip(first, [*first[1:], len(home)])]
        yield pa.RecordBatch.from_arrays([pa.array(home[first]), pa.array(blobs, pa.binary())], ["home", "terms"])


def _summed(parts: int):
    def block(blocks: pa.Table, found: pa.Table) -> pa.Table:
        """Documents and occurrences per group and term of one block, packed by parts of the terms."""
        if not blocks.num_rows or not found.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "cells": pa.array([], pa.binary())})
        gid, tid, docs, n = _cells(blocks, found)
        part = tid.view(np.uint64) % np.uint64(parts)
        order = np.lexsort((gid, tid, part))
        part, columns = part[order], [c[order] for c in (gid, tid, docs, n)]
        first = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
        blobs = [pack(*_in_steps(*(c[a:b] for c in columns))) for a, b in zip(first, [*first[1:], len(part)])]
        return pa.table({"part": pa.array(part[first].astype(np.int32)), "cells": pa.array(blobs, pa.binary())})

    return block


def _in_steps(gid: np.ndarray, tid: np.ndarray, docs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rising numbers as the steps between them, which pack well."""
    return gid, np.diff(tid, prepend=0), docs, n


def _added(cells: pa.Table) -> pa.Table:
    """The cells of a part of the terms, summed over the blocks."""
    packs = [unpack(b.as_py(), *[np.int64] * 4) for b in cells.column("cells")]
    tid = np.concatenate([np.cumsum(p[1]) for p in packs])
    gid = np.concatenate([p[0] for p in packs])
    order = np.lexsort((gid, tid))
    gid, tid = gid[order], tid[order]
    first = np.flatnonzero(np.concatenate([[True], (tid[1:] != tid[:-1]) | (gid[1:] != gid[:-1])]))
    gid, tid = gid[first], tid[first]
    docs, n = (np.add.reduceat(np.concatenate([p[k] for p in packs])[order], first) for k in (2, 3))
    return pa.table({"gid": gid, "tid": tid, "docs": docs, "n": n})


def _cells(blocks: pa.Table, found: pa.Table) -> tuple[np.ndarray, ...]:
    """Documents and occurrences per group and term of one block."""
    groups, sizes = unpack(blocks.column("docs")[0].as_py(), np.int64, np.int32)
    place, count = unpack(blocks.column("pairs")[0].as_py(), np.int32, np.int32)
    gids, group = np.unique(groups, return_inverse=True)
    # the terms of a chunk one after the other
    places, lengths, ids = _joined(found.column("terms"), np.int32, np.int32, np.int64)
    tids, term = np.unique(ids, return_inverse=True)
    term = term.astype(np.int32)
    many, start = (np.zeros(int(place.max(initial=0)) + 1, np.int32) for _ in range(2))
    many[places] = lengths
    start[places] = np.cumsum(lengths) - lengths
    del places, lengths, ids
    # the documents of a group one after the other, so that its cells are added up before the next group's
    begin = np.cumsum(sizes, dtype=np.int64) - sizes
    entries = np.concatenate([[0], np.cumsum(many[place], dtype=np.int64)])
    order = np.argsort(group, kind="stable")
    inside = (entries[begin + sizes] - entries[begin])[order]
    del entries
    parts = []
    for lo, hi in _stretches(inside, ENTRIES):
        docs = order[lo:hi]
        at = _spread(begin[docs], sizes[docs])
        parts.append(_counts(group[docs], sizes[docs], place[at], count[at], many, start, term, len(tids)))
    cell, docs, n = (np.concatenate(c) for c in zip(*parts))
    del parts, place, count
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    cell, docs, n = cell[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in (docs, n))
    return gids[cell // len(tids)], tids[cell % len(tids)], docs, n


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts`."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts, dtype=np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)


def _counts(
    group: np.ndarray, sizes: np.ndarray, place: np.ndarray, count: np.ndarray,
    many: np.ndarray, start: np.ndarray, term: np.ndarray, n_terms: int,
) -> tuple[np.ndarray, ...]:
    """Rising cells (a group and a term) of a few documents with their documents and occurrences. `many` terms of
    a chunk are at its `start` in `term`."""
    # one row per document, chunk and term in it
    length = many[place]
    entry = np.repeat(np.arange(len(place), dtype=np.int32), length)
    term = term[_spread(start[place], length)]
    pair = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)[entry] * n_terms + term
    # sorted by document and term, each pair once with its occurrences
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], count[entry[order]].astype(np.int64)
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n, pair = np.add.reduceat(n, first) if len(first) else n, pair[first]
    cell = group[pair // n_terms] * n_terms + pair % n_terms
    order = np.argsort(cell, kind="stable")
    cells, at, docs = np.unique(cell[order], return_index=True, return_counts=True)
    return cells, docs.astype(np.int64), np.add.reduceat(n[order], at) if len(at) else n


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")], docs["text"].alias("text"))


def source_groups(docs: DataFrame) -> DataFrame:
    """`gid, lang, source` of every group that occurs."""
    groups = _labelled(docs).select("lang", "source").distinct()
    return stored(groups.select(F.monotonically_increasing_id().alias("gid"), "lang", "source"))


def term_counts(
    docs: DataFrame, groups: DataFrame, rule: AuditRule = DEFAULT_RULE, hashed: Callable[[Column], Column] = F.xxhash64
) -> tuple[DataFrame, DataFrame]:
    """`gid, tid, docs, n`, the documents that hold a term and its occurrences, and `tid, term`."""
    numbered = attach(_labelled(docs), groups, ["lang", "source"], "inner", small=fits_broadcast(groups))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")
    blocks = stored(numbered.select("gid", raw).mapInArrow(_counted(rule), BLOCKS))
    # a chunk has one row per block, so no chunk has a share of the rows that matters
    chunks = blocks.select(F.col("block").alias("home"), F.posexplode("chunks").alias("place", "chunk"))
    cut = F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0)).alias("terms")
    distinct = stored(chunks.select("chunk").distinct().select("chunk", cut).filter(F.size("terms") > 0))
    terms = stored(distinct.select(F.explode("terms").alias("term")).distinct())
    number = term_number(terms, hashed)
    found = chunks.join(distinct.select("chunk", F.transform("terms", number).alias("tids")), "chunk")
    found = stored(found.select("home", "place", "tids").mapInArrow(_gathered, "home long, terms binary"), GATHERED, "64m")
    discard(distinct)
    # a part's cells fit a task whatever the number of blocks
    parts = max(1, -(-(blocks.agg(F.sum("n_pairs")).first()[0] or 0) // PART_CELLS))
    sums = blocks.select("block", "docs", "pairs").groupBy("block").cogroup(found.groupBy("home")).applyInArrow(
        _summed(parts), "part int, cells binary")
    counts = stored(sums.groupBy("part").applyInArrow(_added, CELLS))
    discard(blocks)
    discard(found)
    return counts, terms.select(number(F.col("term")).alias("tid"), "term")


def term_number(terms: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> Callable[[Column], Column]:
    """A number for every term: its hash. The terms that share a hash, of which there are hardly any (one pair
    among six billion terms), are listed, and all but the first take the next numbers that no term has."""
    by_hash = terms.select("term", hashed(F.col("term")).alias("tid"))
    shared = by_hash.join(by_hash.groupBy("tid").count().filter("count > 1").select("tid"), "tid").orderBy("tid", "term").collect()
    given: dict[str, int] = {}
    seen: set[int] = set()
    for r in shared:
        if r.tid not in seen:
            seen.add(r.tid)
            continue
        number = r.tid
        while number in seen or not by_hash.filter(F.col("tid") == number).isEmpty():
            number = number + 1 if number < (1 << 63) - 1 else -(1 << 63)
        seen.add(number)
        given[r.term] = number
    if not given:
        return lambda term: hashed(term)
    listed = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
    return lambda term: F.coalesce(F.try_element_at(listed, term), hashed(term))


def _share(n: str, total: str, terms: str, rule: AuditRule) -> Column:
    """The scaled probability of n occurrences with two added to each of the terms; exact beyond 64 bits."""
    return F.expr(
        f"CAST(1 + (CAST({rule.scale} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) div ({total} + 2 * {terms}) AS BIGINT)")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergence_audit(docs: DataFrame, rule: AuditRule = DEFAULT_RULE) -> DataFrame:
    """`lang, source, part, item, value, rank`: how far each source is from the other sources of its language
    (`pair`, all of them), and the terms it uses more than its language does (`term`, the first `top`).

    Null texts, languages and sources count as empty ones. A group without a kept term has its pairs, with
    the values that follow from the added occurrences, and 0 where its language keeps no term; a language of
    one source has no pairs. Ties are broken by the item's bytes. Rows with equal or null ids are documents
    like any others, other columns are not read, and an empty table gives an empty result.
    """
    groups = source_groups(docs)
    counts, terms = term_counts(docs, groups, rule)
    small = fits_broadcast(groups)
    counts = attach(counts, groups.select("gid", "lang"), ["gid"], "inner", small=small)
    kept = stored(counts.groupBy("lang", "tid").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
                  .filter(F.col("docs") >= rule.least_docs).select("lang", "tid", "lang_n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    used = stored(attach(counts.select("lang", "gid", "tid", "n"), kept, ["lang", "tid"], "inner"))
    totals = used.groupBy("gid").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = groups.join(totals, "gid", "left").join(langs, "lang", "left").fillna(0, ["total", "held", "terms", "lang_total"])
    # the share of a term that the group does not use
    groups = stored(groups.withColumn("none", F.when(F.col("terms") > 0, _share("0L", "total", "terms", rule))))
    used = attach(used, groups.select("gid", "total", "terms", "lang_total", "none"), ["gid"], "inner", small=small)
    used = stored(used.select("lang", "gid", "tid", "none", _share("n", "total", "terms", rule).alias("p"),
                              _share("lang_n", "lang_total", "terms", rule).alias("q")))
    return _pairs(used, groups).unionByName(_terms(used, groups, terms, rule))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms that both sources of a pair use; a row is a term with its sources and shares."""
    for batch in batches:
        uses = batch.column("uses")
        gid, p, none = (uses.flatten().field(k).to_numpy() for k in range(3))
        left_of_row = np.repeat(uses.offsets.to_numpy()[1:] - uses.offsets.to_numpy()[0], np.diff(uses.offsets.to_numpy()))
        after = left_of_row - np.arange(len(gid)) - 1  # pairs of each use with the later ones of its term
        for lo, hi in _stretches(after, PAIRS_AT_ONCE):
            n = after[lo:hi]
            a = np.repeat(np.arange(lo, hi), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)

            def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return (x - y) * (x - y) // (x + y)

            more = apart(p[a], p[b]) - apart(p[a], none[b]) - apart(none[a], p[b])
            gids, at = np.unique(np.concatenate([gid[a], gid[b]]), return_inverse=True)
            x, y = at[: len(a)], at[len(a) :]
            code, which = np.unique(np.minimum(x, y) * len(gids) + np.maximum(x, y), return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, which, more)
            both = np.bincount(which, minlength=len(code)).astype(np.int64)
            columns = [gids[code // max(1, len(gids))], gids[code % max(1, len(gids))], total, both]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "more", "both"])


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of entries whose sizes add up to about `most`."""
    mark = np.cumsum(sizes) // most
    start = np.flatnonzero(np.diff(mark, prepend=-1))
    return zip(start.tolist(), [*start[1:].tolist(), len(sizes)])


def _pairs(used: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over all kept terms, from the terms that a source uses: a term that neither of two sources uses
    gives the same value each time, and one that only one of them uses depends on its share there alone."""
    # a term has at most one entry per source of its language
    uses = used.groupBy("lang", "tid").agg(F.collect_list(F.struct("gid", "p", "none")).alias("uses"))
    shared = uses.select("uses").mapInArrow(_together, "a long, b long, more long, both long").groupBy("a", "b").agg(
        F.sum("more").alias("more"), F.sum("both").alias("both"))
    levels = used.groupBy("lang", "gid", "p").agg(F.count("*").alias("n"))
    others = groups.select("lang", F.col("gid").alias("other"), F.col("none").alias("none_other"))
    alone = stored(levels.join(others, "lang").filter("gid <> other").groupBy("gid", "other").agg(
        F.sum(F.col("n") * _apart("p", "none_other")).alias("alone")))
    a, b = (
        groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "held", "none")], F.col("gid").alias(s), "terms")
        for s in ("a", "b")
    )
    pairs = a.join(b.drop("terms"), "lang").filter("a < b").join(shared, ["a", "b"], "left")
    for one, other in (("a", "b"), ("b", "a")):
        side = alone.select(F.col("gid").alias(one), F.col("other").alias(other), F.col("alone").alias(f"alone_{one}"))
        pairs = pairs.join(side, ["a", "b"], "left")
    pairs = pairs.fillna(0, ["more", "both", "alone_a", "alone_b"])
    neither = (F.col("terms") - F.col("held_a") - F.col("held_b") + F.col("both")) * _apart("none_a", "none_b")
    value = F.when(F.col("terms") > 0, F.col("alone_a") + F.col("alone_b") + F.col("more") + neither).otherwise(0)
    pairs = stored(pairs.select("lang", "source_a", "source_b", value.cast("long").alias("value")))
    both = pairs.toDF("lang", "source", "item", "value").unionByName(pairs.toDF("lang", "item", "source", "value"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", _rank().alias("rank"))


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))


def _terms(used: DataFrame, groups: DataFrame, terms: DataFrame, rule: AuditRule) -> DataFrame:
    more = used.filter("p > q").select("gid", "tid", _apart("p", "q").alias("value"))
    # with all ties of the last rank, as the terms decide among them
    near = more.withColumn("near", F.rank().over(Window.partitionBy("gid").orderBy(F.col("value").desc())))
    near = near.filter(F.col("near") <= rule.top).join(terms, "tid").join(groups.select("gid", "lang", "source"), "gid")
    ranked = near.withColumnRenamed("term", "item").withColumn("rank", _rank()).filter(F.col("rank") <= rule.top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
