"""Benchmark decontamination: BM25 with block maxima over the test items, every training passage a query.

The items are few and known in size, so their inverted index goes to every task; the training texts only
stream past it. Items lie in blocks. For a passage, the sum of its words' largest impacts per block bounds
every score in the block; blocks whose bound stays below their lowest threshold are skipped, and only the
rest are scored from the posting lists. What scores above an item's threshold is checked for the words of
its question and its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import packed, stored
from tallyframe.llm.superminhash import Shingler
from tallyframe.operators.skew import attach


@dataclass(frozen=True)
class LeakRule:
    """`share`: an item is retrieved by a passage that scores this share of the item's score for itself.
    `overlap`: share of the word n-grams (`n` words) of the question, and of the answer, that the passage
    must hold. `k1`, `b`: BM25. `blocks`: blocks of items. `shard_bytes`: text of the items in one index;
    more items make several indexes, and each costs a pass over the training texts."""

    share: float = 0.75
    overlap: float = 0.7
    n: int = 3
    k1: float = 1.2
    b: float = 0.75
    blocks: int = 128
    shard_bytes: int = 16 << 20


DEFAULT_RULE = LeakRule()


class Tokens(Shingler):
    """Hashes of words of letters, digits and bytes beyond ASCII, A-Z lower-cased: junk that clings to a
    word does not change it."""

    def __init__(self) -> None:
        super().__init__(n=1)
        word = set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256))
        self.blank = np.array([c not in word for c in range(256)])


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item: up to and after the last question mark; else the last line or
    sentence is the answer; else the last quarter of its words."""
    body = text.strip()
    cut = body.rfind("?")
    if cut < 0 or cut == len(body) - 1:
        inner = body.rstrip(".!?")
        cut = max(inner.rfind("\n"), inner.rfind(". "), inner.rfind("! "), inner.rfind("? "))
    if cut <= 0:
        words = body.split()
        keep = max(1, len(words) * 3 // 4)
        return " ".join(words[:keep]), " ".join(words[keep:])
    return body[: cut + 1], body[cut + 1 :]


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-grams as numbers; a shorter text is one gram."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return np.unique(total)


class ItemIndex:
    """Posting lists of BM25 impacts by word, block maxima and thresholds of a list of items."""

    def __init__(self, items: list[tuple[int, str]], rule: LeakRule) -> None:
        tokens = Tokens()
        words = [tokens.words(t.encode("utf-8", "surrogatepass")) for _, t in items]
        order = [i for i in np.argsort([len(w) for w in words], kind="stable") if len(words[i])]
        self.rule = rule
        self.ids = [items[i][0] for i in order]
        words = [words[i] for i in order]
        split = [[tokens.words(h.encode("utf-8", "surrogatepass")) for h in halves(items[i][1])] for i in order]
        # with the length of their grams, which is that of the part if it is shorter
        self.question, self.answer = ([(min(rule.n, len(s[k])), _grams(s[k], rule.n)) for s in split] for k in (0, 1))
        self.reach = max([len(w) for w in words], default=1)
        n = len(words)
        self.vocabulary = np.unique(np.concatenate(words)) if n else np.zeros(0, np.uint64)
        size = len(self.vocabulary)
        item = np.repeat(np.arange(n), [len(w) for w in words])
        term = np.searchsorted(self.vocabulary, np.concatenate(words)) if n else np.zeros(0, np.int64)
        cell, tf = np.unique(term.astype(np.int64) * max(1, n) + item, return_counts=True)
        self.term, self.item = cell // max(1, n), cell % max(1, n)
        length = np.array([len(w) for w in words], float)
        df = np.bincount(self.term, minlength=size)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = rule.k1 * (1 - rule.b + rule.b * length / max(1.0, length.mean() if n else 1.0))
        self.impact = idf[self.term] * tf * (rule.k1 + 1) / (tf + norm[self.item])
        self.start = np.concatenate([[0], np.cumsum(df)])
        # an item's score for itself, and what retrieves it
        self.threshold = rule.share * np.bincount(self.item, weights=self.impact, minlength=n)
        self.per_block = max(1, -(-n // rule.blocks))
        n_blocks = max(1, -(-n // self.per_block))
        self.most = np.zeros((size + 1, n_blocks), np.float32)  # the last row is for words of no item
        np.maximum.at(self.most, (self.term, self.item // self.per_block), self.impact.astype(np.float32))
        self.least = np.full(n_blocks, np.inf)
        np.minimum.at(self.least, np.arange(n) // self.per_block, self.threshold)

    def search(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(passage, first word, item, score) of all items above their thresholds, for the passages of a
        text: two lengths of the longest item each, one length apart, so every item's copy lies in one."""
        if not len(words) or not len(self.vocabulary):
            return []
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == words
        place, term = np.flatnonzero(known), at[known]
        if not len(place):
            return []
        n_steps = len(words) // self.reach + 1
        step = place // self.reach
        # each word once per step, then bounds of two steps together
        cell = np.unique(step * len(self.vocabulary) + term)
        step, term = cell // len(self.vocabulary), cell % len(self.vocabulary)
        used, first = np.unique(step, return_index=True)
        bound = np.zeros((n_steps + 1, self.most.shape[1]), np.float32)
        bound[used] = np.add.reduceat(self.most[term], first, axis=0)
        bound = bound[:-1] + bound[1:]
        out = []
        for p in np.flatnonzero((bound >= self.least * 0.999).any(axis=1)):
            blocks = np.flatnonzero(bound[p] >= self.least * 0.999)
            lo, hi = np.searchsorted(step, [p, p + 2])
            terms = np.unique(term[lo:hi])
            rows = np.concatenate([np.arange(self.start[t], self.start[t + 1]) for t in terms])
            rows = rows[np.isin(self.item[rows] // self.per_block, blocks)]
            scores = np.bincount(self.item[rows], weights=self.impact[rows], minlength=len(self.ids))
            for i in np.flatnonzero((scores >= self.threshold) & (scores > 0)):
                out.append((int(p), int(p) * self.reach, int(i), float(scores[i])))
        return out

    def leaks(self, words: np.ndarray) -> dict[int, tuple[int, float, float, float]]:
        """Per item found: first word of the passage, score, overlap of question and of answer; the best passage."""
        out: dict[int, tuple[int, float, float, float]] = {}
        for _, first, i, score in self.search(words):
            passage = words[first : first + 2 * self.reach]
            q, a = (
                np.isin(part, _grams(passage, n), assume_unique=True).mean() if n else 1.0
                for n, part in (self.question[i], self.answer[i])
            )
            if min(q, a) >= self.rule.overlap and (i not in out or score > out[i][1]):
                out[i] = (first, score, float(q), float(a))
        return out


def _shards(items: DataFrame, rule: LeakRule) -> list[list[tuple[int, str]]]:
    """The items in lists of at most `shard_bytes` of text each (one item at least). A test set is read
    to the driver; its size is the bound, and it does not grow with the training texts."""
    rows = items.orderBy("item_id", "text").collect()
    shards: list[list[tuple[int, str]]] = []
    room = 0
    for r in rows:
        need = len(r["text"].encode("utf-8", "surrogatepass"))
        if not shards or need > room:
            shards.append([])
            room = rule.shard_bytes
        shards[-1].append((r["item_id"], r["text"]))
        room -= need
    return shards


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: LeakRule = DEFAULT_RULE
) -> DataFrame:
    """`doc_id, item_id, first_word, score, question_overlap, answer_overlap` of every item in every text.

    One row per text and item, with its best passage. Null and empty texts and items without a word leak
    nothing; equal items are reported each; a null item id is a result like any other. Repeated rows give
    repeated results, and an empty table on either side an empty result. Texts are read whole.
    """
    known = items.select(items["item_id"], items["text"]).filter(F.length(F.trim("text")) > 0)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {kind}, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
    )
    rows = docs.select(docs[id_col].alias("doc_id"), F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8").alias("raw"))
    out = docs.sparkSession.createDataFrame([], schema)
    for shard in _shards(known, rule):
        out = out.unionByName(rows.mapInArrow(_search(ItemIndex(shard, rule)), schema))
    return out


def _search(index: ItemIndex):
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        names = ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap"]
        for batch in batches:
            at, found = [], []
            for i in range(batch.num_rows):
                for item, values in index.leaks(tokens.words(batch.column("raw")[i].as_py())).items():
                    at.append(i)
                    found.append((index.ids[item], *values))
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names)

    return tasks


def without_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: LeakRule = DEFAULT_RULE
) -> DataFrame:
    """The rows of `docs`, all columns, in which no item was found. Rows with a null id are judged by a
    hash of their text."""
    key = F.struct(F.col("row")[id_col], F.xxhash64(F.col("row")[text_col]))
    rows = packed(docs).withColumn("_key", F.xxhash64(key))
    probe = rows.select(F.col("_key").alias("doc_id"), F.col("row")[text_col].alias("text"))
    bad = stored(find_leaks(probe, items, rule=rule).select(F.col("doc_id").alias("_key")).distinct())
    return attach(rows, bad, ["_key"], how="left_anti").select("row.*")
