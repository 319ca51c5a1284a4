import hashlib

import numpy as np
import pandas as pd
from helpers import awkward, empty, prose

from tallyframe.llm import suffix_dedup


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            g = raw[p : p + length]
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            least = first.get(raw[p : p + length])
            if least is not None and (i is None or least < i):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same(spark, docs, rows, **rule):
    got = suffix_dedup.remove_repeats(docs, rule=suffix_dedup.RepeatRule(**rule)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_awkward_rows_match_brute_force(spark):
    docs = awkward(spark)
    same(spark, docs, [(r.doc_id, r.text) for r in docs.collect()], batch_bytes=20_000, segment=700)


def test_overlaps_edges_and_periodic_text(spark):
    base = prose(1, 200)
    rows = [(5, base), (3, base[100:150]), (4, base[100:149]), (9, "ab" * 60), (8, "ba" * 40), (7, "a" * 300), (6, "a" * 120),
            (11, base[:80] + prose(2, 5) + base[60:400]), (12, "é" * 30), (13, "xé" + "é" * 30), (14, base[3:53] + base[3:53])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(spark, docs, rows)
    same(spark, docs, rows, batch_bytes=100, segment=64)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).collect() == []


def test_levels_halve_and_answer_like_one_array():
    rng, family, known = np.random.default_rng(2), suffix_dedup.Levels(), {}
    for _ in range(40):
        keys, docs = rng.integers(0, 500, 60).astype(np.uint64), rng.integers(0, 90, 60)
        family.add(suffix_dedup.smallest(keys, docs))
        for k, d in zip(keys.tolist(), docs.tolist(), strict=True):
            known[k] = min(known.get(k, d), d)
        sizes = [len(level[0]) for level in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    asked = np.arange(600, dtype=np.uint64)
    want = [known.get(k, suffix_dedup.NEVER) for k in range(600)]
    assert family.first_docs(asked).tolist() == want


def test_keys_of_a_batch_are_looked_up_once_and_in_their_order(monkeypatch):
    looked, first_docs = [], suffix_dedup.Levels.first_docs

    def watched(self, keys):
        looked.append(keys)
        return first_docs(self, keys)

    monkeypatch.setattr(suffix_dedup.Levels, "first_docs", watched)
    texts = [prose(i % 7, 200) for i in range(20)]
    frame = pd.DataFrame({"doc_id": range(20), "raw": [t.encode() for t in texts]})
    out = suffix_dedup._finish(suffix_dedup.DEFAULT_RULE)((0,), frame, pd.DataFrame())
    assert out["n_removed"].tolist() == [0] * 7 + [len(t) for t in texts[7:]]
    assert len(looked) <= 2  # the spans of the batch, and its windows
    assert all((keys[1:] > keys[:-1]).all() for keys in looked)
