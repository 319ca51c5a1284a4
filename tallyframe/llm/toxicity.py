"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of the character n-grams of its words, word ends included, each hashed to a bucket with
an embedding. The mean embedding goes through a linear layer and a softmax. A misspelt or compounded
word shares most n-grams, hence most of its vectors, with the words seen in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCH = 1 << 19  # n-grams that a step of the fit weighs at a time


@dataclass(frozen=True)
class ToxicityRule:
    """`shortest` to `longest`: characters per n-gram. `bits`: 2 ** bits buckets of `dims` numbers.
    `steps` of full-batch Adam at `rate`; `decay` pulls embeddings to zero.

    The classifier is fitted on a bounded sample of the labelled training rows: per class at most
    `per_class` texts, those with the smallest hash of their id, of at most `longest_text` characters.
    Scoring takes every row and every character. `cut`: scores from there on predict 1. The classes weigh
    the same in training; `assumed_share` of label 1 then sets the operating point of the scores.
    """

    shortest: int = 3
    longest: int = 6
    bits: int = 18
    dims: int = 8
    steps: int = 60
    rate: float = 0.3
    decay: float = 1e-6
    per_class: int = 2500
    longest_text: int = 200_000
    cut: float = 0.7
    assumed_share: float = 0.3


DEFAULT_RULE = ToxicityRule()


@dataclass(frozen=True)
class ToxicityModel:
    """`weights`: per bucket the embedding times the difference of the class vectors, as float32 bytes.

    The mean of embeddings and the linear layer commute, so scoring needs one number per bucket.
    """

    rule: ToxicityRule
    weights: bytes
    bias: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)], dtype=bool)


def buckets(text: str, rule: ToxicityRule) -> np.ndarray:
    """Bucket of every n-gram of the lower-cased words of a text; a word end counts as a character."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    before = np.concatenate([[False], letter[:-1]])
    kept = np.where(letter, codes, np.uint32(0))[letter | before]  # one zero after each word
    codes = np.concatenate([np.zeros(1, np.uint32), kept, np.zeros(1, np.uint32)])
    inner = codes != 0
    out = []
    with np.errstate(over="ignore"):
        for n in range(rule.shortest, rule.longest + 1):
            m = len(codes) - n + 1
            if m < 1:
                break
            h = codes[:m] * np.uint32(0x9E3779B1) + np.uint32(n)
            ok = inner[1 : 1 + m].copy()
            for k in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[k : k + m]
                if 1 < k < n - 1:
                    ok &= inner[k : k + m]
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out.append((h >> np.uint32(32 - rule.bits))[ok])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The whole text in pieces that end at a word's end, so memory is bounded for texts of any length."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
        yield text[at:end]
        at = end


class Bags:
    """The n-grams of texts with their shares, joined over stretches of texts."""

    def __init__(self, size: int) -> None:
        self.held = np.zeros(size, np.int32)  # texts per bucket
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0  # entries of those
        self.done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # buckets, shares, entries per text

    def add(self, at: np.ndarray, shares: np.ndarray) -> None:
        self.held[at] += 1
        self.open.append((at, shares))
        self.n += len(at)
        if self.n >= STRETCH:
            self.close()

    def close(self) -> None:
        if self.open:
            at, shares = (np.concatenate(c) for c in zip(*self.open, strict=True))
            self.done.append((at, shares, np.array([len(a) for a, _ in self.open])))
            self.open, self.n = [], 0

    def shared(self, common: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The stretches with the common buckets alone; each is let go as its successor is made."""
        self.close()
        for k, (at, shares, n) in enumerate(self.done):
            keep = common[at]
            text = np.repeat(np.arange(len(n)), n)[keep]
            self.done[k] = at[keep], shares[keep], np.bincount(text, minlength=len(n))
        return self.done


def fit(texts: list[str], labels: list[int], rule: ToxicityRule) -> ToxicityModel:
    """Embeddings and the linear softmax together, by full-batch Adam.

    With X the rows of n-gram shares, the logits are X (E W); the gradient of E is (X' g) W' and that of W
    is E' (X' g), so a step needs two passes over the n-grams whatever the dimensions. Buckets seen in one
    text only stay at zero. The passes take the n-grams in stretches, added up in the order of the texts, so
    little more is held than the n-grams themselves.
    """
    size = 1 << rule.bits
    bags = Bags(size)
    for text in texts:
        counts = np.bincount(buckets(text, rule), minlength=size) if text else np.zeros(size, np.int64)
        at = np.flatnonzero(counts)
        bags.add(at.astype(np.int32), (counts[at] / max(1, counts.sum())).astype(np.float32))
    common = bags.held > 1
    stretches = bags.shared(common)
    y = np.array(labels, dtype=np.float64)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    rng = np.random.default_rng(1)
    embed = np.where(common[:, None], rng.normal(0, 0.1, (size, rule.dims)), 0.0).astype(np.float32)
    linear = rng.normal(0, 1.0, (rule.dims, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [embed, linear, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, rule.steps + 1):
        per_bucket = embed @ linear
        apart = per_bucket[:, 1] - per_bucket[:, 0]
        margin = np.concatenate([
            np.bincount(np.repeat(np.arange(len(n)), n), weights=x * apart[idx], minlength=len(n))
            for idx, x, n in stretches])
        p = 1 / (1 + np.exp(-(margin + bias[1] - bias[0])))  # the softmax of two classes
        g = (weight * (p - y)).astype(np.float32)
        back, first = np.zeros(size), 0
        for idx, x, n in stretches:
            np.add.at(back, idx, (x * np.repeat(g[first : first + len(n)], n)).astype(np.float64))
            first += len(n)
        back = back.astype(np.float32)
        both = np.stack([-back, back], axis=1)
        grads = [both @ linear.T + rule.decay * embed, embed.T @ both, np.array([-g.sum(), g.sum()], np.float32)]
        for p_, grad, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            step = rule.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            p_ -= np.where(common[:, None], step, 0).astype(np.float32) if p_ is embed else step.astype(np.float32)
    per_bucket = embed @ linear
    shift = np.log(rule.assumed_share / (1 - rule.assumed_share))
    return ToxicityModel(
        rule, (per_bucket[:, 1] - per_bucket[:, 0]).astype(np.float32).tobytes(), float(bias[1] - bias[0] + shift)
    )


def score_text(text: str, weights: np.ndarray, model: ToxicityModel) -> float:
    total, n = 0.0, 0
    for piece in _pieces(text):
        at = buckets(piece, model.rule)
        total, n = total + float(weights[at].sum(dtype=np.float64)), n + len(at)
    return float(1 / (1 + np.exp(-(total / max(1, n) + model.bias))))


def _split(doc_id: Column) -> Column:
    """Remainder that decides the fold: 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(3))


def train(
    docs: DataFrame, labels: DataFrame, rule: ToxicityRule = DEFAULT_RULE,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> ToxicityModel:
    """Fit on the labelled rows whose fold is not held out; labels other than 0 and 1 and null ids are left out.

    Only ids and labels choose the sample; its texts meet in one task, a size bounded by the rule. Without
    training rows of both classes every text scores near 1 (label 1 alone) or near 0.
    """
    marked = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
    marked = marked.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (_split(F.col("doc_id")) != 1))
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    none = np.zeros(1 << rule.bits, np.float32).tobytes()
    if not ones or not zeros:
        return ToxicityModel(rule, none, 30.0 if ones else -30.0)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = [marked.filter(F.col("label") == c).orderBy(*order).limit(rule.per_class) for c in (0, 1)]
    sample = chosen[0].unionByName(chosen[1]).dropDuplicates(["doc_id"])
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).filter(
        F.length("text") <= rule.longest_text)
    # at most 2 * per_class ids, so the other side need not move
    texts = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label", F.lit(0).alias("model"))

    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], kind="stable").drop_duplicates("doc_id")
        model = fit(group["text"].tolist(), group["label"].tolist(), rule)
        return pd.DataFrame({"weights": [model.weights], "bias": [model.bias]})

    fitted = texts.groupBy("model").applyInPandas(task, "weights binary, bias double").collect()
    return ToxicityModel(rule, bytes(fitted[0]["weights"]), fitted[0]["bias"]) if fitted else ToxicityModel(rule, none, -30.0)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row; only the text makes the score.

    Null and empty texts, and texts without a letter or digit, score what the bias alone gives. Repeated
    rows each get their row, a null id stays null, an empty table gives an empty one, other columns are
    not read. The model, 2 ** bits numbers, goes to every task.
    """
    return docs.select(
        docs[id_col].alias("doc_id"), (_split(docs[id_col]) == 1).alias("held_out"),
        scorer(model)(docs[text_col]).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= model.rule.cut, 1).otherwise(0))


def scorer(model: ToxicityModel):
    """The model as a column function of texts."""
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.frombuffer(model.weights, np.float32)
        for texts in batches:
            yield pd.Series([score_text(t or "", weights, model) for t in texts], dtype="float64")

    return scores


def keep_civil(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that the model does not predict 1."""
    return docs.filter(scorer(model)(docs[text_col]) < model.rule.cut)
