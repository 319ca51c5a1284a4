import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, awkward_texts, awkward, empty, prose
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup
from tallyframe.llm.exact_dedup import ExchangeRule, decode, encode


def brute(rows):
    """Result rows but for `kept`, and kept rows per text."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, min(known) if known else None, len(ids), sha) for i in ids]
    return Counter(out)


def check(docs, rows, **options):
    got = exact_dedup.dedup_exact(docs, **options).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert Counter(r.text_sha256 for r in kept) == Counter({r.text_sha256: 1 for r in got})


def cases():
    rows = [*awkward_texts(), (20, "a  b"), (21, "a\t\nb"), (22, " a b"), (23, "a b"), (24, "a b"), (25, "a b"),
            (26, " "), (27, "\x0b\x0c"), (28, "a\x00b"), (28, "a\x00b"), (None, "only null"), (None, "only null")]
    rows += [(100 + i, "the hot text") for i in range(400)] + [(600 + i, prose(i % 150, 6)) for i in range(400)]
    return rows


@pytest.mark.parametrize("rule", [
    exact_dedup.DEFAULT_RULE,
    ExchangeRule(block_rows=7, owner_rows=50),
    ExchangeRule(spare_bits=0, block_bytes=2_000, owner_rows=100, map_bytes=400),
])
def test_matches_groups_of_texts(spark, rule):
    rows = cases()
    docs = spark.createDataFrame([(i, t, "s", "r", "h", "c", 7, "b") for i, t in rows], SCHEMA).repartition(5)
    check(docs, rows, rule=rule)


def test_equal_fingerprints_are_told_apart(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, rows, fingerprint=lambda t: F.xxhash64(t) % 3)


def test_code_round_trip_and_size():
    random = np.random.default_rng(1)
    for width, n in ((0, 1), (1, 2), (5, 32), (20, 1), (20, 3000), (45, 1000), (60, 5)):
        values = np.unique(random.integers(0, 1 << width, n)) if width != 1 else np.array([0, 1])
        code = encode(values, width)
        assert decode(code).tolist() == values.tolist()
        if n == 1000:
            assert len(code) < n * (45 - 10 + 2) / 8 + 20  # two bits beyond the logarithm of the mean gap


def test_kept_rows_have_all_columns(spark):
    docs = awkward(spark)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.collect())["one two"] == 1
    assert exact_dedup.dedup_exact(empty(spark)).collect() == []
