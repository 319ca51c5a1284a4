"""Line dedup by overlapping pairs of lines, as op1_line_dedup runs it."""

from helpers import empty, prose
from test_line_dedup import hash_of

from tallyframe.llm import line_dedup


def brute(rows):
    """{(id, text): (left text, removed lines, removed stretches)}, one pair of lines after the other."""
    first, out = {}, {}
    for _, _, _, i, t in sorted({(i is None, i or 0, hash_of(t), i, t) for i, t in rows}, key=lambda r: r[:3]):
        lines = (t or "").split("\n")
        full, gone = [k for k, line in enumerate(lines) if line.strip()], set()
        for a, b in zip(full, full[1:], strict=False):
            where = first.setdefault(tuple(lines[a : b + 1]), (i, t, a, b))
            if where[:2] != (i, t) or a > where[3]:
                gone |= set(range(a, b + 1))
        left = None if t is None else "\n".join(line for k, line in enumerate(lines) if k not in gone)
        out[i, t] = left, len(gone), sum(k - 1 not in gone for k in gone)
    return out


def test_matches_pair_by_pair_scan(spark):
    lines = [prose(i, 8) for i in range(60)]
    rows = [(1, "\n".join(lines[:40])), (2, "\n".join(["inserted", *lines[:40]])), (3, "\n".join(lines[10:50])),
            (4, "\n".join(lines[20:30] + lines[20:30])), (5, "\n\n\n"), (6, "\n\n\n"), (7, None), (8, ""), (8, ""),
            (None, "\n".join(lines[:20])), (9, "\n".join(prose(100 + i % 7, 3) for i in range(3000))),
            (10, "a\na\na\na\na"), (11, "x\n\n" + lines[55] + "\n \n" + lines[56]), (12, lines[55] + "\n \n" + lines[56] + "\n\ny"),
            (13, lines[55] + "\n" + lines[56]), (14, lines[55] + "\n\nz\n" + lines[57]), (2, "other text\nunder one id"),
            (2, "\n".join(["inserted", *lines[:40]]))]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, rule=line_dedup.PAIRS, keep=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_removed_lines, r.n_removed_chunks) == want[r.row.doc_id, r.row.text]
    assert {r.row.doc_id: r.text for r in got}[10] == "a\na"
    assert line_dedup.dedup_lines(empty(spark), rule=line_dedup.PAIRS).collect() == []


def test_short_planted_passages_go_from_all_but_the_first(spark, tmp_path):
    """Blocks of 3 to 8 lines, each planted in three documents between lines of their own."""
    from tallyframe.llm.queries import QUERIES

    rows, planted = [], 0
    for size in range(3, 9):
        for n in range(6):
            seed = 1000 * size + 20 * n
            block = [prose(seed + k, 7) for k in range(size)]
            for copy in range(3):
                own = [prose(100_000 + 10 * (seed + copy) + k, 6) for k in range(4)]
                rows.append((len(rows), "\n".join([*own[:2], *block, *own[2:]])))
            planted += 2 * size
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()
    assert sum(r.n_removed_lines for r in got) == planted
    assert all(r.n_removed_chunks == (r.doc_id % 3 > 0) for r in got)
