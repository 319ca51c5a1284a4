"""Removal of long repeated strings with a family of sorted suffix levels that grows geometrically.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller id.

Suffix arrays here are sparse. All windows of `length` bytes in a row whose smallest gram hash is the same
gram form a run; the choice depends on the bytes of a window alone, so equal windows lie in runs of the
same gram wherever they occur. One suffix per run is kept, at its first window, as a fingerprint of the
gram and one of the run's whole span. A batch of documents gives its sorted array of such suffixes; levels
of a family are sorted arrays too, a new batch is merged into levels not longer than itself, so their
lengths grow geometrically and an entry is merged a logarithmic number of times. Batches are scanned
against the levels with sorted searches. Spark deals the suffixes out by gram, and each part of the gram
space has a family of its own.

1. Runs whose span occurs in an earlier document go as a whole.
2. Where one gram has several spans, the windows themselves are compared: the first holder of each span
   publishes a fingerprint per window, and these meet in a second exchange of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored
from tallyframe.llm.superminhash import mixed

NEVER = np.iinfo(np.int64).max  # the id of a row without one: it removes nothing elsewhere


@dataclass(frozen=True)
class RepeatRule:
    """`length`: bytes of a repeat. `gram`: bytes of the grams that choose runs. `batch_bytes`: text per
    batch, the unit of one task; a longer document is a batch of its own and is read in `segment` pieces."""

    length: int = 50
    gram: int = 20
    batch_bytes: int = 8 << 20
    segment: int = 1 << 20


DEFAULT_RULE = RepeatRule()


class Scanner:
    """Runs and windows of byte strings by rolling polynomials."""

    def __init__(self, rule: RepeatRule) -> None:
        self.rule = rule
        size = rule.segment + 2 * rule.length + 1
        with np.errstate(over="ignore"):
            one = np.ones(1, np.uint64)
            self.power = np.cumprod(np.concatenate([one, np.full(size, 0x5851F42D4C957F2D, np.uint64)]))
            back = pow(0x5851F42D4C957F2D, -1, 1 << 64)
            self.back = np.cumprod(np.concatenate([one, np.full(size, back, np.uint64)]))
            self.byte = mixed(np.arange(7, 263, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def prints(self, sums: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
        """Fingerprints of the strings at `starts`."""
        return mixed((sums[starts + lengths] - sums[starts]) * self.back[starts] + np.asarray(lengths).astype(np.uint64))

    def segments(self, raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Pieces such that every window lies in exactly one."""
        step = self.rule.segment
        for at in range(0, max(1, len(raw) - self.rule.length + 1), step):
            yield at, raw[at : at + step + self.rule.length - 1]

    def runs(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram fingerprint, span fingerprint, first window, windows) of the runs of a text."""
        parts = []
        with np.errstate(over="ignore"):
            for at, piece in self.segments(raw):
                n = len(piece) - self.rule.length + 1
                if n < 1:
                    continue
                sums = self.sums(piece)
                k = self.rule.gram
                starts = np.arange(len(piece) - k + 1)
                grams = mixed((sums[k:] - sums[:-k]) * self.back[: len(starts)])
                least = sliding_min(grams, self.rule.length - k + 1)
                first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                count = np.diff(np.append(first, n))
                spans = self.prints(sums, first, (count + self.rule.length - 1).astype(np.int64))
                parts.append((mixed(least[first]), spans, first + at, count))
        if not parts:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def windows(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows at `starts`, ascending."""
        out = []
        with np.errstate(over="ignore"):
            for at, piece in self.segments(raw):
                lo, hi = np.searchsorted(starts, [at, at + self.rule.segment])
                if hi > lo:
                    out.append(self.prints(self.sums(piece), starts[lo:hi] - at, self.rule.length))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each stretch of `width`, by running minima from both ends of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `starts`."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)


def stretches(ranked: np.ndarray) -> np.ndarray:
    """Where the stretches of equal numbers of a sorted array start."""
    return np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)


def smallest(keys: np.ndarray, docs: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """A sorted array of distinct keys, each with its smallest document and what comes with the key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = stretches(ranked)
    least = np.minimum.reduceat(docs[order], first) if len(keys) else docs
    return ranked[first], least, *(m[order[first]] for m in more)


class Levels:
    """The family of one part: sorted arrays whose lengths at least halve from one to the next."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []

    def add(self, batch: tuple[np.ndarray, ...]) -> None:
        """Merge a sorted batch with every level not twice as long; timsort joins sorted stretches in one scan."""
        while self.levels and len(self.levels[-1][0]) < 2 * len(batch[0]):
            level = self.levels.pop()
            batch = smallest(*(np.concatenate([a, b]) for a, b in zip(level, batch, strict=True)))
        self.levels.append(batch)

    def first_docs(self, keys: np.ndarray) -> np.ndarray:
        """Smallest document per key over all levels, NEVER if there is none."""
        out = np.full(len(keys), NEVER)
        for known, docs, *_ in self.levels:
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            out = np.where(hit, np.minimum(out, docs[at] if len(known) else NEVER), out)
        return out


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes, then all next ones, so that small ids compress well."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _numbers(raw: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(raw, kind)


def _rows(batch: int, keys: np.ndarray, docs: np.ndarray, grams: np.ndarray, parts: int) -> pd.DataFrame:
    """The suffixes of a batch, packed by part of the gram space, in the order of their keys."""
    part = ((grams >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    low = grams.astype(np.uint32)
    rows = [
        {"part": p, "batch": batch, "keys": keys[at].tobytes(), "docs": _planes(docs[at]), "grams": low[at].tobytes()}
        for p in range(parts)
        if len(at := order[cuts[p] : cuts[p + 1]])
    ]
    return pd.DataFrame(rows, columns=["part", "batch", "keys", "docs", "grams"])


_PACKED = "part int, batch long, keys binary, docs binary, grams binary"
_ANSWER = "batch long, step int, keys binary, docs binary, open binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _first_docs(
    texts: list[tuple], answers: Levels, at: int, open_: np.ndarray | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the smallest document of each of its keys (column `at`), in this batch or by the answers, and
    whether the key is in the sorted `open_`. The keys of a batch are sorted once and looked up in their order,
    as searches all over an array wait for memory each."""
    if not texts:
        return []
    sizes = [len(t[at]) for t in texts]
    keys = np.concatenate([t[at] for t in texts])
    least, listed = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys)
        ranked = keys[order]
        first = stretches(ranked)
        times, ranked = np.diff(np.append(first, len(keys))), ranked[first]
        docs = np.repeat(np.array([t[0] for t in texts], np.int64), sizes)
        found = np.minimum(answers.first_docs(ranked), np.minimum.reduceat(docs[order], first))
        least[order] = np.repeat(found, times)
        if open_ is not None and len(open_):
            place = np.searchsorted(open_, ranked)
            place[place == len(open_)] = 0
            listed[order] = np.repeat(open_[place] == ranked, times)
    cuts = np.cumsum(sizes)[:-1]
    return list(zip(np.split(least, cuts), np.split(listed, cuts), strict=True))


def _answers(frame: pd.DataFrame | None, step: int) -> tuple[Levels, np.ndarray]:
    """The answers to one batch as one sorted level, and the spans left open."""
    known = Levels()
    if frame is None or not len(frame):
        return known, np.zeros(0, np.uint64)
    frame = frame[frame["step"] == step]
    docs = [_unplaned(d) for d in frame["docs"]]
    if len(docs):
        known.levels = [smallest(_numbers(b"".join(frame["keys"])), np.concatenate(docs))]
    return known, np.sort(_numbers(b"".join(frame["open"])))


class Batch:
    """The texts of one batch with what is known of their runs."""

    def __init__(self, frame: pd.DataFrame, rule: RepeatRule) -> None:
        self.scan = Scanner(rule)
        self.raws = [np.frombuffer(raw, np.uint8) for raw in frame["raw"]]
        self.docs = frame["doc_id"].tolist()
        # (document, spans, grams, first windows, numbers of windows)
        self.texts = []
        for doc, raw in zip(self.docs, self.raws, strict=True):
            grams, spans, first, count = self.scan.runs(raw)
            self.texts.append((doc, spans, grams, first, count))

    def resolve(self, answers: Levels, open_: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text the windows that are repeated for sure, and those to be compared one by one."""
        sure, asked = [], []
        known = _first_docs(self.texts, answers, 1, open_)
        for (doc, _, _, first, count), (least, listed) in zip(self.texts, known, strict=True):
            seen = least < doc
            asks = ~seen & listed
            sure.append(spread(first[seen], count[seen]))
            asked.append(spread(first[asks], count[asks]))
        return sure, asked

    def prints(self, asked: list[np.ndarray]) -> list[tuple]:
        return [(doc, self.scan.windows(raw, starts)) for doc, raw, starts in zip(self.docs, self.raws, asked, strict=True)]


def _suffixes(rule: RepeatRule, parts: int):
    """The sorted suffixes of a batch, each once, with its smallest document."""
    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        texts = Batch(frame, rule).texts
        docs = np.concatenate([np.full(len(t[1]), t[0]) for t in texts])
        spans, docs, grams = smallest(np.concatenate([t[1] for t in texts]), docs, np.concatenate([t[2] for t in texts]))
        return _rows(int(key[0]), spans, docs, grams, parts)

    return task


def _scan_part(frame: pd.DataFrame) -> pd.DataFrame:
    """One part of the gram space: batches go into the family one by one, then each is scanned against it.

    Answers per batch the spans that occur in an earlier document, with that document, and the spans whose
    gram has other spans as well."""
    family, batches = Levels(), []
    for batch, keys, docs, grams in zip(frame["batch"], frame["keys"], frame["docs"], frame["grams"], strict=True):
        batches.append((batch, _numbers(keys), _unplaned(docs), _numbers(grams, np.uint32)))
        family.add(batches[-1][1:])
    # distinct spans per gram
    spans, _, grams = smallest(*(np.concatenate(c) for c in zip(*family.levels, strict=True)))
    grams = np.sort(grams)
    several = np.unique(grams[1:][grams[1:] == grams[:-1]])
    return _scanned(family, batches, 1, lambda g: np.isin(g, several))


def _scan_windows(frame: pd.DataFrame) -> pd.DataFrame:
    """The same for windows: those that occur in an earlier document."""
    family, batches = Levels(), []
    for batch, keys, docs in zip(frame["batch"], frame["keys"], frame["docs"], strict=True):
        batches.append((batch, _numbers(keys), _unplaned(docs)))
        family.add(batches[-1][1:])
    return _scanned(family, [(*b, None) for b in batches], 2, lambda g: False)


def _scanned(family: Levels, batches: list[tuple], step: int, is_open) -> pd.DataFrame:
    out = []
    for batch, keys, docs, grams in batches:
        first = family.first_docs(keys)
        seen = first < docs
        open_ = ~seen & is_open(grams)
        if seen.any() or open_.any():
            out.append({"batch": batch, "step": step, "keys": keys[seen].tobytes(), "docs": _planes(first[seen]),
                        "open": keys[open_].tobytes()})
    return pd.DataFrame(out, columns=["batch", "step", "keys", "docs", "open"])


def _windows(rule: RepeatRule, parts: int):
    """Fingerprints of a batch's windows that are to be compared, each once."""
    def task(key: tuple, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return _rows(0, *(np.zeros(0, k) for k in (np.uint64, np.int64, np.uint64)), parts)
        batch = Batch(frame, rule)
        texts = batch.prints(batch.resolve(*_answers(answers, 1))[1])
        docs = np.concatenate([np.full(len(t[1]), t[0]) for t in texts])
        keys, docs = smallest(np.concatenate([t[1] for t in texts]), docs)
        return _rows(int(key[0]), keys, docs, keys, parts).assign(grams=b"")

    return task


def _finish(rule: RepeatRule):
    """The result rows of a batch from the answers of both steps."""
    def task(key: tuple, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, list] = {c.split()[0]: [] for c in _RESULT.split(", ")}
        if len(frame):
            batch = Batch(frame, rule)
            sure, asked = batch.resolve(*_answers(answers, 1))
            texts = batch.prints(asked)
            for doc, raw, gone, starts, (least, _) in zip(
                batch.docs, batch.raws, sure, asked, _first_docs(texts, _answers(answers, 2)[0], 1), strict=True
            ):
                values = doc, *_outcome(raw, np.concatenate([gone, starts[least < doc]]), rule.length)
                for column, value in zip(rows.values(), values, strict=True):
                    column.append(value)
        return pd.DataFrame({k: pd.Series(v, dtype=object if k == "kept_sha256" else "int64") for k, v in rows.items()})

    return task


def _outcome(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, removed runs and the digest of what stays, for the repeated windows at `starts`."""
    edges = np.zeros(len(raw) + 1, np.int8)
    edges[starts] = 1  # a window is named once
    edges[starts + length] -= 1
    gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
    spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
    return len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: RepeatRule = DEFAULT_RULE
) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` per row of `docs`.

    Strings are UTF-8 bytes of the input and never cross documents; overlapping ones count. Texts shorter
    than a repeat, null and empty ones keep everything (a null text is empty). Rows that share an id do
    not remove each other's bytes. A row with a null id may lose what documents with an id hold and takes
    nothing from others. Other columns are not read; an empty table gives an empty one.

    Documents are dealt into batches by a hash, so a batch sends a suffix at most once and no part of the
    gram space gets more than one entry per batch for however frequent a string. A batch is read again
    for each step: that costs less than keeping its suffixes.
    """
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NEVER)).alias("doc_id"),
        F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8").alias("raw"),
    )
    total = rows.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()[0]
    n = max(1, -(-total // rule.batch_bytes))
    # rows without an id are dealt by their text
    deal = F.when(F.col("doc_id") == NEVER, F.xxhash64("raw")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("batch", F.pmod(deal, F.lit(n)))
    packed = rows.groupBy("batch").applyInPandas(_suffixes(rule, n), _PACKED)
    spans = stored(packed.groupBy("part").applyInPandas(_scan_part, _ANSWER))
    published = rows.groupBy("batch").cogroup(spans.groupBy("batch")).applyInPandas(_windows(rule, n), _PACKED)
    windows = stored(published.groupBy("part").applyInPandas(_scan_windows, _ANSWER))
    answers = spans.unionByName(windows)
    out = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_finish(rule), _RESULT)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NEVER)))
