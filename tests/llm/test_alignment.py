import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, awkward, awkward_texts, empty, prose

from tallyframe.llm import alignment
from tallyframe.llm.alignment import AlignRule

A_PATH, B_PATH = (f"{alignment.FOLDER}/{n}" for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def read(path):
    with open(path, "rb") as file:
        return file.read()


def both(text, a_model, b_model):
    """Token ids and byte ends of both sides by the tokenizers' own libraries, or nothing."""
    raw = (" " + text).encode()
    out = []
    for model, ids in ((a_model, a_model._by_file(" " + text)), (b_model, b_model.encode([text])[0])):
        if not text or b"".join(model.bytes[i] for i in ids) != raw:
            return [], []
        end, side = 0, []
        for i in ids:
            end += len(model.bytes[i])
            side.append((i, end))
        out.append(side)
    return out


def brute(rows):
    """Rows of the result, one token after the other."""
    a_model, b_model = alignment.ByteTokens(read(A_PATH)), alignment.PieceTokens(read(B_PATH))
    sides = [both(t or "", a_model, b_model) for _, t in rows]
    links = []
    for a, b in sides:
        ends = {e: y for y, e in b}
        links.append([(x, ends[e]) for x, e in a if e in ends])
    counts = Counter(p for row in links for p in row)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for (i, _), (a, b), row in zip(rows, sides, links):
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        text = ";".join(grouped(a, b, cuts))
        out.append((i, len(a), len(b), len(cuts), len(row), sum(counts[p] == most[p[1]] for p in row),
                    sum(counts[p] for p in row), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return Counter(out)


def grouped(a, b, cuts):
    out, x, y = [], 0, 0
    for cut in cuts:
        left, right = [], []
        while x < len(a) and a[x][1] <= cut:
            left.append(str(a[x][0]))
            x += 1
        while y < len(b) and b[y][1] <= cut:
            right.append(str(b[y][0]))
            y += 1
        out.append(",".join(left) + "|" + ",".join(right))
    return out


def check(docs, rows, rule):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = alignment.align(docs, rule=rule).collect()
    assert Counter(tuple(r[n] for n in names) for r in got) == brute(rows)


def cases():
    rows = [(i, None if t is None else t[:6_000]) for i, t in awkward_texts()]
    rows += [(30, "<|endoftext|> <s> </s> <0x41> <unk>"), (31, "a▁b"), (32, "漢字 🙂👍🏽 é"), (33, "a\x00b\r\n\tc"),
             (34, "　wide  spaces "), (35, " "), (36, "it's we'll DON'T"), (37, "1234567890 3.14"), (38, "é" * 3_000)]
    return rows + [(100 + i, prose(i, 40)) for i in range(60)]


@pytest.mark.parametrize("rule", [alignment.DEFAULT_RULE, AlignRule(piece=64, chunk_bytes=3_000, chunk_tokens=900), AlignRule(piece=5)])
def test_matches_token_by_token(spark, rule):
    rows = cases()
    docs = spark.createDataFrame([(i, t, "s", "r", "h", "c", 7, "b") for i, t in rows], SCHEMA)
    check(docs.repartition(3), rows, rule)


def test_pieces_of_equal_work():
    random = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (1, 1), (400, 300), (1000, 10)):
        a, b = (np.sort(random.integers(0, 500, k)) for k in (n, m))
        steps = np.arange(0, n + m + 1)
        order = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        assert alignment.merge_path(a, b, steps).tolist() == [sum(side == 0 for _, side in order[:s]) for s in steps]
        borders = alignment.cuts(a, b, 50)
        assert borders[-1] == (n, m)
        for (i, j), (k, q) in zip(borders, borders[1:]):
            assert k + q > i + j and not set(a[i:k]) & set(a[k:]) and not (set(a[i:k]) & set(b[q:])) and not (set(b[j:q]) & set(a[k:]))
            ties = max(np.sum(a == v) + np.sum(b == v) for v in {*a, *b})
            assert k + q - i - j <= 50 + ties


def test_bound_of_pairs():
    assert alignment.pair_bound([b"a", b"ba"], [b"a", b"cba", b"x"]) >= 4
    models = alignment.ByteTokens(read(A_PATH)), alignment.PieceTokens(read(B_PATH))
    assert alignment.pair_bound(*(m.bytes for m in models)) * 24 <= 64 << 20


def test_awkward_rows_and_empty_table(spark):
    assert len(alignment.align(awkward(spark)).collect()) == 18
    assert alignment.align(empty(spark)).collect() == []


def test_very_long_runs_of_white_space():
    """Texts that the faster library cannot split go through the other one, with equal results below that length."""
    model = alignment.ByteTokens(read(A_PATH))
    for sign in (" ", "\n", " \t", "　"):
        short = "a" + sign * ((alignment.LONG_SPACE - 1) // len(sign)) + "b"
        assert not alignment._long_space(short) and model.encode([short]) == [model._by_file(" " + short)]
        long = "a" + sign * 600_000 + "b"
        ids = model.encode([long])[0]
        assert b"".join(model.bytes[i] for i in ids) == (" " + long).encode()
