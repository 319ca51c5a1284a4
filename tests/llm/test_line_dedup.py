import xxhash
from helpers import awkward, empty, prose

from tallyframe.llm import line_dedup

M = (1 << 64) - 1


def chunks(lines, rule=line_dedup.DEFAULT_RULE):
    """Chunks as (first line, lines) by the same rolling hash, one line at a time."""
    hashes = [xxhash.xxh64_intdigest(line.encode(), seed=42) for line in lines]
    out, first = [], 0
    for i in range(len(lines)):
        rolled = 0
        for k in range(rule.window):
            h = hashes[i - k] if i >= k else 0
            rolled ^= ((h << k) | (h >> (64 - k))) & M if k else h
        if i == len(lines) - 1 or rolled & ((1 << rule.boundary_bits) - 1) == 0:
            out.append((first, lines[first : i + 1]))
            first = i + 1
    return out


def brute(rows):
    """{(id, text): text without repeated chunks}; equal rows count once."""
    order = sorted({(i is None, i or 0, hash_of(t), i, t) for i, t in rows}, key=lambda r: r[:3])
    seen, out = {}, {}
    for _, _, _, i, t in order:
        if t is None:
            out[i, t] = (None, 0)
            continue
        left, gone = [], 0
        for at, chunk in chunks(t.split("\n")):
            key = tuple(chunk)
            if len(chunk) >= 2 and any(c.strip() for c in chunk):
                if seen.setdefault(key, (i, t, at)) != (i, t, at):
                    gone += 1
                    continue
            left += chunk
        out[i, t] = ("\n".join(left), gone)
    return out


def hash_of(text):
    if text is None:
        return 42
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = line_dedup.dedup_lines(docs, keep=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_removed_chunks) == want[r.row.doc_id, r.row.text]
    return got


def test_matches_line_by_line_scan(spark):
    lines = [prose(i, 8) for i in range(60)]
    rows = [(1, "\n".join(lines[:40])), (2, "\n".join(["inserted", *lines[:40]])), (3, "\n".join(lines[10:50])),
            (4, "\n".join(lines[20:30] + lines[20:30])), (5, "\n\n\n\n\n\n"), (6, "\n\n\n\n\n\n"), (5, "\n\n\n\n\n\n"),
            (7, None), (8, ""), (None, "\n".join(lines[:20])), (9, "\n".join(prose(100 + i % 7, 3) for i in range(3000)))]
    got = check(spark, rows)
    assert sum(r.n_removed_chunks for r in got) > 10


def test_shift_moves_only_near_boundaries():
    lines = [prose(i, 8) for i in range(200)]
    first = {tuple(c) for _, c in chunks(lines)}
    second = {tuple(c) for _, c in chunks(["new line", *lines])}
    assert len(first - second) <= 3


def test_awkward_and_empty_tables(spark):
    got = line_dedup.dedup_lines(awkward(spark)).collect()
    assert len(got) == 18 and {r.doc_id: r.text for r in got}[4] is None
    assert line_dedup.dedup_lines(empty(spark)).collect() == []
