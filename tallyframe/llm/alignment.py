"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ones do.

Merge-path partitioning: the ends of a text's A tokens and of its B tokens are two rising lists. A binary
search along a diagonal of their merge finds how far each list has got after a given number of steps, so a
long merge falls into pieces of equal work that need nothing of each other. Each piece gives the tokens
that end together and its groups; the open groups at the borders of pieces are stitched per document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored
from tallyframe.operators.skew import attach

# Splits of the byte-level vocabularies: fixed value, as the tokenizer's file leaves it to the library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLDER = "/opt/tokenizers"
LONG_SPACE = 100_000


@dataclass(frozen=True)
class AlignRule:
    """`piece`: ends of both sides that a piece merges, about. `chunk_bytes`: text that a task tokenizes at
    a time. `chunk_tokens`: tokens that it merges at a time. `batch_rows`: rows that a task is given at a
    time, as a row of tokens may be large."""

    piece: int = 1 << 16
    chunk_bytes: int = 1 << 20
    chunk_tokens: int = 1 << 19
    batch_rows: int = 256


DEFAULT_RULE = AlignRule()


class ByteTokens:
    """A byte-level vocabulary (JSON). Ids that follow the order of the merges are ranks, and the faster
    library encodes by them; the results are the same."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    @cached_property
    def model(self) -> dict:
        return json.loads(self.raw)

    @cached_property
    def bytes(self) -> list[bytes]:
        """The bytes of each id. Bytes that are no printable Latin-1 characters are letters from U+0100 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {chr(b): b for b in plain}
        letter.update({chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))})
        vocab = self.model["model"]["vocab"]
        out = [b""] * (max([*vocab.values(), *(t["id"] for t in self.model["added_tokens"])]) + 1)
        for token, i in vocab.items():
            out[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        return out

    @cached_property
    def encoder(self):
        special = {t["content"] for t in self.model["added_tokens"]}
        vocab = {t: i for t, i in self.model["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in self.model["model"]["merges"]]
        ranked = [vocab.get(m.replace(" ", "", 1)) == 256 + k for k, m in enumerate(merges)]
        if all(ranked) and len(vocab) == 256 + len(merges):
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocab.values()}
            return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return self._by_file

    @cached_property
    def _tokenizer(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.raw.decode())
        out.encode_special_tokens = True
        return out

    def _by_file(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [(self._by_file if _long_space(t) else self.encoder)(" " + t) for t in texts]


def _long_space(text: str) -> bool:
    """Whether white space runs on for so long that the faster library's pattern would run out of stack."""
    return len(text) >= LONG_SPACE and re.search(rf"\s{{{LONG_SPACE}}}", text) is not None


class PieceTokens:
    """A sentence-piece model, which adds the space in front by itself."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw

    @cached_property
    def encoder(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.raw)

    @cached_property
    def bytes(self) -> list[bytes]:
        """The bytes of each id; U+2581 is a space, and byte pieces are <0xHH>."""
        model = self.encoder
        pieces = [model.id_to_piece(i) for i in range(len(model))]
        return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encoder.encode(texts, num_threads=1)


class Side:
    """A vocabulary with the tables that merging and printing need; `end` closes a group's tokens of this side."""

    def __init__(self, tokens, end: str) -> None:
        self.tokens = tokens
        self.end = end

    @cached_property
    def length(self) -> np.ndarray:
        return np.array([len(b) for b in self.tokens.bytes], np.int64)

    @cached_property
    def printed(self) -> np.ndarray:
        """Each id with a comma, then each id with the closing sign."""
        return np.array([f"{i}{sign}" for sign in (",", self.end) for i in range(len(self.length))], object)


def merge_path(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """How many of the rising `a` are among the first `steps` of the merge with `b`, equal ones of `a` first."""
    lo, hi = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (lo < hi).any():
        open_ = lo < hi
        mid = (lo + hi) // 2
        # a[mid] comes before b[steps - mid - 1]: more of a are in
        more = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(steps - mid - 1, 0, len(b) - 1)])
        lo, hi = np.where(more, mid + 1, lo), np.where(open_ & ~more, mid, hi)
    return lo


def cuts(a: np.ndarray, b: np.ndarray, piece: int) -> list[tuple[int, int]]:
    """Borders (tokens of a, tokens of b) of pieces of `piece` steps each. Ends that are equal stay together:
    a border moves on by the ends that equal the last one before it."""
    total = len(a) + len(b)
    steps = np.arange(piece, total, piece)
    out = [(0, 0)]
    for step, i in zip(steps, merge_path(a, b, steps)):
        j = step - i
        last = max(a[i - 1] if i else -1, b[j - 1] if j else -1)
        border = (int(np.searchsorted(a, last, "right")), int(np.searchsorted(b, last, "right")))
        if out[-1] != border:
            out.append(border)
    if out[-1] != (len(a), len(b)):
        out.append((len(a), len(b)))
    return out


PIECES = "row long, piece int, pieces int, doc_id {id}, a array<int>, b array<int>, a_at long, b_at long"


def _tokenized(models, rule: AlignRule):
    """One row per piece of a document; a document without tokens is one empty piece."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = map(Side, models.value, "|;")
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = batch.column("n").to_numpy(zero_copy_only=False)
            for lo, hi in zip(*_runs(np.cumsum(sizes) // rule.chunk_bytes)):
                at, cells = [], []
                texts = batch.column("text").slice(lo, hi - lo).to_pylist()
                for i, (text, a, b) in enumerate(zip(texts, a_side.tokens.encode(texts), b_side.tokens.encode(texts))):
                    raw = (" " + text).encode()
                    if not text or any(b"".join(map(s.tokens.bytes.__getitem__, x)) != raw for s, x in ((a_side, a), (b_side, b))):
                        a, b = [], []
                    a, b = np.array(a, np.int32), np.array(b, np.int32)
                    if len(a) + len(b) <= rule.piece:
                        found = [(a, b, 0, 0)]
                    else:
                        a_end, b_end = np.cumsum(a_side.length[a]), np.cumsum(b_side.length[b])
                        borders = cuts(a_end, b_end, rule.piece)
                        found = [
                            (a[i:k], b[j:m], int(a_end[i - 1]) if i else 0, int(b_end[j - 1]) if j else 0)
                            for (i, j), (k, m) in zip(borders, borders[1:])
                        ]
                    cells += [(row + i, k, len(found), *f) for k, f in enumerate(found)]
                    at += [lo + i] * len(found)
                row += hi - lo
                yield _pieces(batch.column("doc_id").take(pa.array(at, pa.int64())), cells)

    return tasks


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of equal marks."""
    start = np.flatnonzero(np.diff(marks, prepend=-1)) if len(marks) else np.zeros(0, np.int64)
    return start, np.append(start[1:], len(marks)) if len(start) else start


def _pieces(ids: pa.Array, cells: list[tuple]) -> pa.RecordBatch:
    row, piece, pieces, a, b, a_at, b_at = zip(*cells)
    def lists(arrays):
        flat = np.concatenate(arrays)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat, pa.int32()))

    columns = [pa.array(row, pa.int64()), pa.array(piece, pa.int32()), pa.array(pieces, pa.int32()), ids,
               lists(a), lists(b), pa.array(a_at, pa.int64()), pa.array(b_at, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["row", "piece", "pieces", "doc_id", "a", "b", "a_at", "b_at"])


MERGED = (
    "row long, piece int, pieces int, doc_id {id}, n_a long, n_b long, n_groups long, groups_sha256 string,"
    " head_a string, head_b string, body string, tail_a string, tail_b string, links array<long>"
)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), sizes)


def _ends(length: np.ndarray, rows: np.ndarray, at: np.ndarray, room: int) -> np.ndarray:
    """Ends of tokens, rising over all rows, as each row begins `room` after the one before it."""
    running = np.cumsum(length)
    start = np.searchsorted(rows, np.arange(len(at)))
    before = np.concatenate([[0], running])[start]
    return running - before[rows] + at[rows] + rows * room


class Merged:
    """The merge of the pieces of a batch, all rows at once."""

    def __init__(self, batch: pa.RecordBatch, a_side: Side, b_side: Side) -> None:
        self.n = batch.num_rows
        self.a, self.a_row = _flat(batch.column("a"))
        self.b, self.b_row = _flat(batch.column("b"))
        at = [batch.column(c).to_numpy() for c in ("a_at", "b_at")]
        room = int(max(x.max(initial=0) for x in at) + a_side.length[self.a].sum() + b_side.length[self.b].sum() + 1)
        self.a_end = _ends(a_side.length[self.a], self.a_row, at[0], room)
        self.b_end = _ends(b_side.length[self.b], self.b_row, at[1], room)
        at_b = np.searchsorted(self.b_end, self.a_end)
        both = np.append(self.b_end, -1)[at_b] == self.a_end
        self.cut = self.a_end[both & (np.diff(self.a_end, prepend=-1) > 0)]
        self.cut_row = (self.cut - 1) // room
        # the tokens up to each cut are a group; a row that begins or ends inside one has a number more
        self.a_group = np.searchsorted(self.cut, self.a_end) + self.a_row
        self.b_group = np.searchsorted(self.cut, self.b_end) + self.b_row
        self.a_side, self.b_side = a_side, b_side

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all pairs that end together, and the row of each."""
        la, ra = (np.searchsorted(self.a_end, self.cut, s) for s in ("left", "right"))
        lb, rb = (np.searchsorted(self.b_end, self.cut, s) for s in ("left", "right"))
        n = (ra - la) * (rb - lb)
        cut = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(cut)) - np.repeat(np.cumsum(n) - n, n)
        wide = np.maximum(1, rb - lb)[cut]
        return self.a[la[cut] + k // wide] * len(self.b_side.length) + self.b[lb[cut] + k % wide], self.cut_row[cut]

    def printed(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens as text with the sign after each, in the order of the groups, and the group of each."""
        most = max(self.a_group.max(initial=0), self.b_group.max(initial=0)) + 1
        n_a, n_b = (np.cumsum(np.bincount(g, minlength=most)) for g in (self.a_group, self.b_group))
        text = np.empty(len(self.a) + len(self.b), object)
        groups = np.empty(len(text), np.int64)
        before_b = np.concatenate([[0], n_b])
        for ids, group, side, ahead in (
            (self.a, self.a_group, self.a_side, before_b[self.a_group]), (self.b, self.b_group, self.b_side, n_a[self.b_group]),
        ):
            place = np.arange(len(ids)) + ahead
            text[place] = side.printed[ids + len(side.length) * (np.diff(group, append=-1) != 0)]
            groups[place] = group
        return text, groups


def _merged(models, rule: AlignRule):
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = map(Side, models.value, "|;")
        for batch in batches:
            sizes = sum(np.diff(batch.column(c).offsets.to_numpy()) for c in ("a", "b"))
            for lo, hi in zip(*_runs(np.cumsum(sizes) // rule.chunk_tokens)):
                yield _merge(batch.slice(lo, hi - lo), a_side, b_side)

    return tasks


def _merge(batch: pa.RecordBatch, a_side: Side, b_side: Side) -> pa.RecordBatch:
    m = Merged(batch, a_side, b_side)
    rows = np.arange(m.n + 1)
    codes, code_row = m.links()
    links = pa.ListArray.from_arrays(pa.array(np.searchsorted(code_row, rows), pa.int32()), pa.array(codes, pa.int64()))
    n_groups = np.bincount(m.cut_row, minlength=m.n)
    text, group = m.printed()
    bounds = np.searchsorted(m.a_row, rows) + np.searchsorted(m.b_row, rows)
    whole = batch.column("pieces").to_numpy() == 1
    digest: list[str | None] = [None] * m.n
    edges: list[tuple] = [(None,) * 5] * m.n
    first = np.searchsorted(m.cut_row, rows)  # number of a row's first cut
    for r in range(m.n):
        lo, hi = bounds[r], bounds[r + 1]
        if whole[r]:
            digest[r] = hashlib.sha256("".join(text[lo:hi].tolist())[:-1].encode()).hexdigest() if hi > lo else ""
            continue
        # the first group may begin in the piece before, what follows the last cut ends in a later one
        head, tail = lo, lo + np.searchsorted(group[lo:hi], first[r + 1] + r)
        if n_groups[r]:
            head += np.searchsorted(group[lo:hi], first[r] + r, "right")
        edges[r] = (
            *_sides("".join(text[lo:head])), "".join(text[head:tail]), *_sides("".join(text[tail:hi])))
    n_a, n_b = (np.bincount(x, minlength=m.n) for x in (m.a_row, m.b_row))
    names = ["row", "piece", "pieces", "doc_id"]
    columns = [batch.column(c) for c in names]
    columns += [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)]
    columns += [pa.array(digest, pa.string()), *(pa.array([e[k] for e in edges], pa.string()) for k in range(5)), links]
    names += ["n_a", "n_b", "n_groups", "groups_sha256", "head_a", "head_b", "body", "tail_a", "tail_b", "links"]
    return pa.RecordBatch.from_arrays(columns, names)


def _sides(text: str) -> tuple[str, str]:
    """The A and B ids of a printed group that may lack one side."""
    a, sign, b = text.rpartition("|")
    return a, b.rstrip(";")


def _stitched(pieces: pd.DataFrame) -> pd.DataFrame:
    """One row for the pieces of a document."""
    pieces = pieces.sort_values("piece")
    groups, open_a, open_b = [], [], []
    for p in pieces.itertuples():
        if p.n_groups:
            groups.append("|".join(",".join(filter(None, x)) for x in ([*open_a, p.head_a], [*open_b, p.head_b])))
            groups.append(p.body.rstrip(";"))
            open_a, open_b = [], []
        open_a.append(p.tail_a)
        open_b.append(p.tail_b)
    text = ";".join(filter(None, groups))
    sums = pieces[["n_a", "n_b", "n_groups", "n_links"]].sum()
    out = pieces.iloc[:1][["row", "doc_id"]].assign(**sums)
    return out.assign(groups_sha256=hashlib.sha256(text.encode()).hexdigest())


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """Most pairs of ids that can end together: one token's bytes are then the end of the other's."""
    out = 0
    for these, those in ((a, b), (b, a)):
        known: dict[bytes, int] = {}
        for t in those:
            known[t] = known.get(t, 0) + 1
        out += sum(known.get(t[k:], 0) for t in these for k in range(len(t)))
    return out


def align(
    docs: DataFrame, a_path: str = f"{FOLDER}/byte_bpe_50k.json", b_path: str = f"{FOLDER}/piece_bpe_32k.model",
    id_col: str = "doc_id", text_col: str = "text", rule: AlignRule = DEFAULT_RULE,
) -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` of every row.

    Both sides cover a space and the text. Groups end where tokens of both sides end at the same byte; links
    are the pairs of tokens that end there, counted by their ids over all rows; the best ones of an id of B
    are those with its highest count. Null and empty texts, and texts that a side does not give back byte by
    byte, have no tokens: zeros and an empty digest. Repeated rows count each, a null id stays null, other
    columns are not read, an empty table gives an empty one. The vocabularies are read on the driver and sent
    to the tasks (a few MB). A text is tokenized in one task, as a token may depend on all of it.
    """
    models, n_pairs, width = _models(docs, a_path, b_path)
    pieces = tokenized(docs, models, id_col, text_col, rule)
    merged = merged_pieces(pieces, models, rule)
    pairs = merged.select(F.explode("links").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    pairs = stored(pairs.withColumn("b", F.col("code") % width))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    counts = stored(pairs.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))
    found = merged.select("row", F.explode("links").alias("code"))
    # the vocabularies bound the pairs whatever the size of the input
    small = n_pairs * 24 <= 64 << 20
    scored = found.join(F.broadcast(counts), "code") if small else attach(found, counts, ["code"], "inner")
    scored = scored.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    merged = merged.withColumn("n_links", F.size("links").cast("long")).drop("links")
    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = docs.schema[id_col].dataType.simpleString()
    long_ones = merged.filter("pieces > 1").groupBy("row").applyInPandas(
        _stitched, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")
    out = merged.filter("pieces = 1").select(columns).unionByName(long_ones).join(scored, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def _models(docs: DataFrame, a_path: str, b_path: str):
    """The models sent to the tasks, the bound of their pairs, and the number of B's ids."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        models = (ByteTokens(a.read()), PieceTokens(b.read()))
    tables = [m.bytes for m in models]
    plain = (ByteTokens(models[0].raw), PieceTokens(models[1].raw))
    return docs.sparkSession.sparkContext.broadcast(plain), pair_bound(*tables), len(tables[1])


def tokenized(docs: DataFrame, models, id_col: str, text_col: str, rule: AlignRule) -> DataFrame:
    """One row per piece: the ids of both sides, and where their first tokens begin."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n"))
    return stored(rows.mapInArrow(_tokenized(models, rule), PIECES.format(id=docs.schema[id_col].dataType.simpleString())),
                  rule.batch_rows)


def merged_pieces(pieces: DataFrame, models, rule: AlignRule) -> DataFrame:
    """Links and groups of every piece. Pieces of long documents are dealt over all tasks, others stay."""
    schema = MERGED.format(id=pieces.schema["doc_id"].dataType.simpleString())
    one = pieces.filter("pieces = 1").mapInArrow(_merged(models, rule), schema)
    many = pieces.filter("pieces > 1").repartition("row", "piece").mapInArrow(_merged(models, rule), schema)
    return stored(one.unionByName(many), rule.batch_rows)
