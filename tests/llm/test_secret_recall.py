"""Share of random keys without a keyword that is found, by alphabet and length."""

import random

import pytest

from tallyframe.llm import secrets

UPPER, LOWER, DIGITS = secrets.UPPER, secrets.LOWER, secrets.DIGITS
ALPHABETS = {
    "HEX": DIGITS + "ABCDEF", "hEx": DIGITS + "abcdefABCDEF", "hex": DIGITS + "abcdef", "base32": UPPER + "234567",
    "upper": UPPER + DIGITS, "lower": LOWER + DIGITS, "mixed": UPPER + LOWER + DIGITS,
}
N = 100


@pytest.fixture(scope="module")
def shares(spark):
    rng, rows = random.Random(7), []
    for name, letters in ALPHABETS.items():
        for size in (24, 40, 64):
            for i in range(N):
                key = "".join(rng.choice(letters) for _ in range(size))
                rows.append((len(rows), f"see {key}, or" if i % 2 else f"sig={key}", name, size))
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, size long")
    found = {r.doc_id for r in secrets.scan_secrets(docs).collect() if r.spans}
    return {(n, s): sum(r[0] in found for r in rows if r[2:] == (n, s)) / N for n in ALPHABETS for s in (24, 40, 64)}


@pytest.mark.parametrize("name", ALPHABETS)
def test_random_keys_are_found(shares, name):
    assert all(shares[name, size] >= 0.97 for size in (24, 40, 64)), shares
