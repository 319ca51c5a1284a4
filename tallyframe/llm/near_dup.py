"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

Documents with equal shingle sets form a class and go on as one. Classes meet in bands of their
signatures. In every bucket each class is first compared with the smallest one only, so a large group of
copies gives as many pairs as it has members. The links found so far make groups; then, in each bucket,
only classes of different groups are compared with each other, in blocks inside a task, and only links
that join groups leave it. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import packed, stored
from tallyframe.llm.superminhash import Shingler, bands, digest, likeness, marks, signature
from tallyframe.operators.skew import attach, first_row


@dataclass(frozen=True)
class NearRule:
    """Link documents with 100 * intersection >= percent * union of their sets of `n`-word shingles.

    `n_bands` bands of `rows` slots: at a likeness of 0.75, 32 bands of 4 miss a pair with a probability
    of 5e-6. `slack`: pairs are verified if the share of agreeing slots is at most that much below the
    threshold (0.15 is four and a half standard deviations). `block`: classes of a bucket compared at once.
    """

    n: int = 5
    percent: int = 75
    n_bands: int = 32
    rows: int = 4
    slack: float = 0.15
    block: int = 512


DEFAULT_RULE = NearRule()


def _signed(batches: Iterator[pa.RecordBatch], rule: NearRule) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(rule.n)
    for batch in batches:
        ids, hashes, raws = batch.column("doc_id"), batch.column("h"), batch.column("raw")
        out: dict[str, list] = {"doc_id": [], "n_shingles": [], "digest": [], "bands": [], "marks": []}
        seen: dict[bytes, tuple] = {}
        for i in range(batch.num_rows):
            grams = shingler.grams(raws[i].as_py())
            name = digest(grams) if len(grams) else None
            if name is not None and name not in seen:
                sig = signature(grams, rule.n_bands * rule.rows)
                seen[name] = bands(sig, rule.rows).tobytes(), marks(sig).tobytes()
            found = seen.get(name, (None, None))
            for key, value in zip(out, (ids[i].as_py(), len(grams), name, *found), strict=True):
                out[key].append(value)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(out["doc_id"], ids.type), "h": hashes, "n_shingles": pa.array(out["n_shingles"], pa.int64()),
            **{k: pa.array(out[k], pa.binary()) for k in ("digest", "bands", "marks")},
        })


def signatures(docs: DataFrame, rule: NearRule = DEFAULT_RULE) -> DataFrame:
    """`doc_id, h, n_shingles, digest, bands, marks` of `doc_id, h, text`; the last three null without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "h", F.encode("text", "UTF-8").alias("raw"))
    return rows.mapInArrow(
        lambda batches: _signed(batches, rule),
        f"doc_id {kind}, h long, n_shingles long, digest binary, bands binary, marks binary",
    )


def _gram_sets(docs: DataFrame, rule: NearRule) -> DataFrame:
    """`doc_id, digest, grams`: the full sets as bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rule.n)
        for batch in batches:
            for i in range(batch.num_rows):  # one row per batch: a set is as large as its text
                grams = shingler.grams(batch.column("raw")[i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), *(pa.array([x], pa.binary()) for x in (digest(grams), grams.tobytes()))],
                    ["doc_id", "digest", "grams"],
                )

    return docs.select("doc_id", F.encode("text", "UTF-8").alias("raw")).mapInArrow(
        sets, f"doc_id {kind}, digest binary, grams binary")


def _alike(rule: NearRule):
    @F.pandas_udf("boolean")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            both, union = likeness(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
            out.append(100 * both >= rule.percent * union)
        return pd.Series(out, dtype=bool)

    return check


def _near_marks(rule: NearRule):
    least = (rule.percent / 100 - rule.slack) * rule.n_bands * rule.rows

    @F.pandas_udf("boolean")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(len(a), -1)
        return pd.Series((x == y).sum(axis=1) >= least)

    return check


def _verified(pairs: DataFrame, sets: DataFrame, rule: NearRule) -> DataFrame:
    """The pairs `a, b` whose full sets are alike."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("grams_b"))
    both = attach(attach(pairs, left, ["a"], how="inner"), right, ["b"], how="inner")
    return both.filter(_alike(rule)("grams_a", "grams_b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """`node, component` for every end of the links `a, b`: the smallest node that can be reached.

    Each partition first reduces its links to a forest by union-find. Then every node's neighbours are
    hung on the smallest of them, in turns for larger neighbours and for all not larger ones, until
    nothing changes; the rounds grow with the logarithm of the longest chain. Each round is stored.
    """
    kind = links.schema["a"].dataType.simpleString()
    edges = stored(links.mapInPandas(_forest, f"a {kind}, b {kind}").filter("a != b").distinct())
    before = None
    while True:
        near = edges.select("a", "b").union(edges.select("b", "a"))
        least = near.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        hung = attach(near, least, ["a"], how="inner").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = stored(hung.filter("a != b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        hung = attach(down, least, ["a"], how="inner").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e"))
        edges = stored(hung.select("e.a", "e.b").filter("a != b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find with path halving over the links of one partition, batch by batch: each batch leaves a
    tree edge per node, so a partition gives at most as many links as it has nodes per batch."""
    for batch in batches:
        parent: dict = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]}, columns=["a", "b"]).astype(batch.dtypes.to_dict())


def _cross_links(rule: NearRule):
    """Links between different groups in one block pair of a bucket.

    Pairs near enough by their signatures are compared on their full sets, the nearest first; a pair whose
    groups a link of this block has joined already needs no look. At most one link per group comes out.
    """
    least = (rule.percent / 100 - rule.slack) * rule.n_bands * rule.rows

    def links(group: pd.DataFrame) -> pd.DataFrame:
        ids, comp = group["rep"].to_numpy(), pd.factorize(group["component"])[0]
        keys = np.frombuffer(b"".join(group["bands"]), np.int64).reshape(len(group), -1)
        sigs = np.frombuffer(b"".join(group["marks"]), np.uint8).reshape(len(group), -1)
        sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
        part, band = group["part"].to_numpy(), int(group["band"].iloc[0])
        two = group["one"].iloc[0] != group["two"].iloc[0]
        near: list[tuple[int, int, int]] = []
        for i in range(len(group) - 1):
            other = comp[i + 1 :] != comp[i]
            if two:  # pairs inside one of two blocks belong to that block's own task
                other &= part[i + 1 :] != part[i]
            at = np.flatnonzero(other) + i + 1
            if len(at) and band:  # met in an earlier band already
                at = at[~(keys[at, :band] == keys[i, :band]).any(axis=1)]
            if len(at):
                agree = (sigs[at] == sigs[i]).sum(axis=1)
                near += [(int(n), i, int(j)) for n, j in zip(agree, at, strict=True) if n >= least]
        parent = list(range(comp.max() + 1))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out: list[tuple] = []
        for _, i, j in sorted(near, reverse=True):
            x, y = find(comp[i]), find(comp[j])
            if x == y:
                continue
            both, union = likeness(sets[i], sets[j])
            if 100 * both >= rule.percent * union:
                parent[x] = y
                out.append((ids[i], ids[j]))
        return pd.DataFrame({k: np.array([o[n] for o in out], dtype=ids.dtype) for n, k in enumerate("ab")})

    return links


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: NearRule = DEFAULT_RULE
) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` per row of `docs`.

    `component_id` is the smallest id reachable over links, the own id included; `kept` marks the rows
    that carry it. A text with fewer words than a shingle is one shingle; null and empty texts and texts
    of white space have none and link with nothing. Repeated rows are equal documents; a class of equal
    sets is named by its smallest id, and classes of one name count as one document. Rows with a null id
    are members of their class but never name or link one: without another member their component is null
    and they are kept. An empty table gives an empty one; other columns are not read.
    """
    return _grouped(docs, id_col, text_col, rule).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, id_col: str, text_col: str, rule: NearRule) -> DataFrame:
    """`near_groups` with `h`, the hash of the text, and `digest`, the name of its set of shingles."""
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("h"))
    signed = stored(signatures(rows, rule))
    named = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL").select("digest", "doc_id", "bands", "marks")
    classes = stored(first_row(named, ["digest"], ["doc_id"]).withColumnRenamed("doc_id", "rep"))

    number = F.explode(F.sequence(F.lit(0), F.lit(rule.n_bands - 1)))
    keyed = classes.select("rep", "bands", number.alias("band"))
    keyed = keyed.select("rep", "band", F.xxhash64("band", F.expr("substring(bands, band * 8 + 1, 8)")).alias("key"))
    buckets = keyed.groupBy("key").agg(
        F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("n")).filter("hub != top").drop("top")
    members = stored(attach(keyed, stored(buckets), ["key"], how="inner"))

    first = members.filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    side = classes.select("rep", "marks")
    first = attach(first, side.select(F.col("rep").alias("a"), F.col("marks").alias("marks_a")), ["a"], how="inner")
    first = attach(first, side.select(F.col("rep").alias("b"), F.col("marks").alias("marks_b")), ["b"], how="inner")
    first = stored(first.filter(_near_marks(rule)("marks_a", "marks_b")).select("a", "b"))

    # full sets of the documents that may be compared: those that share a bucket
    wanted = attach(classes.select("rep", "digest"), members.select("rep").distinct(), ["rep"], how="left_semi")
    wanted = wanted.select(F.col("rep").alias("doc_id"), F.col("digest").alias("named"))
    chosen = attach(rows, stored(wanted), ["doc_id"], how="inner")
    sets = stored(_gram_sets(chosen.select("doc_id", "text"), rule))
    sets = attach(sets, wanted.withColumnRenamed("named", "digest"), ["doc_id", "digest"], how="left_semi")
    sets = stored(sets.select("doc_id", "grams").dropDuplicates(["doc_id", "grams"]))
    links = _verified(first, sets, rule)
    links = stored(links)
    groups = components(links)

    # what the first round left apart, wherever three or more meet
    grouped = attach(members.filter("n > 2"), groups.select(F.col("node").alias("rep"), "component"), ["rep"])
    grouped = stored(grouped.withColumn("component", F.coalesce("component", "rep")))
    open_ = grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    open_ = stored(open_.filter("low != high").select("key", "size"))
    left = attach(grouped.select("key", "band", "rep", "component"), open_, ["key"], how="inner")
    left = attach(left, classes.select("rep", "bands", "marks"), ["rep"], how="inner")
    left = attach(left, sets.withColumnRenamed("doc_id", "rep"), ["rep"], how="inner")
    parts = F.ceil(F.col("size") / rule.block).cast("int")
    left = left.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other"))
    kind = classes.schema["rep"].dataType.simpleString()
    more = stored(left.groupBy("key", "one", "two").applyInPandas(_cross_links(rule), f"a {kind}, b {kind}"))
    # the new links join whole groups, so only group names go through the second pass
    name = groups.select("node", "component")
    ends = attach(more, name.select(F.col("node").alias("a"), F.col("component").alias("ca")), ["a"])
    ends = attach(ends, name.select(F.col("node").alias("b"), F.col("component").alias("cb")), ["b"])
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(ends)
    groups = attach(groups, merged.select(F.col("node").alias("component"), F.col("component").alias("final")), ["component"])
    groups = groups.select("node", F.coalesce("final", "component").alias("component"))
    alone = merged.select("node", "component").join(groups.select("node"), "node", "left_anti")
    groups = stored(groups.unionByName(alone))

    names = attach(classes.select("digest", "rep"), groups.select(F.col("node").alias("rep"), "component"), ["rep"])
    names = stored(names.select("digest", F.coalesce("component", "rep").alias("component")))
    out = attach(signed.select("doc_id", "h", "n_shingles", "digest"), names, ["digest"])
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", "h", "n_shingles", "digest", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: NearRule = DEFAULT_RULE) -> DataFrame:
    """The rows of `docs`, all columns, that name their group by `near_groups`, one for each set of shingles.

    Rows that share an id and a set, or an id and a text without words, count as one: those of the smallest
    text hash stay, and of equal texts the row that is first by a hash of its columns. Rows with a null id
    stay where no row with an id has their set, one for each set. Other texts under one id stay if their
    own group is named by it, even if they are near each other.
    """
    groups = _grouped(docs, id_col, text_col, rule).filter("kept")
    name = F.coalesce("digest", F.encode(F.col("h").cast("string"), "UTF-8")).alias("name")
    each = groups.groupBy("doc_id", name, "h").agg(F.count("*").alias("n"))
    doc = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    chosen = stored(first_row(each, ["doc_id", "name"], ["h"]).select(doc.alias("_doc"), "n"))
    id_, text = F.col("row")[id_col], F.col("row")[text_col]
    rows = packed(docs).withColumn("_doc", F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(text).alias("h")))
    kept = stored(attach(rows, chosen, ["_doc"], how="inner"))
    # only what occurs more than once has to be ordered
    plain = [F.col("row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = first_row(kept.filter("n > 1"), ["_doc"], [F.xxhash64(*plain)])
    return kept.filter("n = 1").select("row.*").unionByName(first.select("row.*"))
