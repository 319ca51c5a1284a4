import hashlib

from helpers import WORD, awkward, empty, prose

from tallyframe.llm import mixing


def brute(rows):
    """Targets by resharing round by round, thresholds by sorting."""
    size = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    names = sorted({s for _, s, _ in size}, key=lambda s: (s is None, (s or "").encode()))
    sums = {s: sum(n for _, x, n in size if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sums.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        unit = (total - sum(3 * sums[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * unit > 3 * sums[s]}
        if not more:
            break
        capped |= more
    out = []
    for s in names:
        target = 3.0 * sums[s] if s in capped else weight[s] * unit
        own = sorted((int(hashlib.md5(str("null" if i is None else i).encode()).hexdigest()[:15], 16), i, n) for i, x, n in size if x == s)
        full = min(3, int(target // sums[s])) if sums[s] else 0
        rest, at, limit = target - full * sums[s], 0, -1
        if full < 3:
            for h in sorted({h for h, _, n in own if n}):
                n = sum(m for g, _, m in own if g == h)
                if at + n > rest:
                    if at + n - rest < rest - at:
                        limit = h
                    break
                at, limit = at + n, h
        out += [(i, n, sums[s], round(target, 6), n * (full + (h <= limit))) for h, i, n in own]
    return out


def test_matches_sorting(spark):
    rows = [(i, prose(i, 5 + i * 37 % 90), ["b", "a", "é", "Z", None][i % 5] if i % 3 else "a") for i in range(300)]
    rows += [(1000, None, "void"), (1001, " ", "void"), (1002, prose(3, 4000), "zz"), (5, prose(5, 9), "b"), (5, prose(5, 9), "b")]
    rows += [(2000, "few", "tiny"), (None, "three words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert sum({(r[2], r[3]) for r in got} and [t for _, t in {(r[2], r[3]) for r in got}]) > 0


def test_no_document_is_taken_too_often_and_reruns_agree(spark):
    docs = awkward(spark)
    first = sorted(map(str, mixing.mix(docs).collect()))
    assert first == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert all(r.taken <= 3 * r["size"] for r in mixing.mix(docs).collect())


def test_empty_table_and_clashing_columns(spark):
    assert mixing.mix(empty(spark)).collect() == []
    docs = awkward(spark)
    kept = mixing.mix(docs, keep=True)
    assert kept.select("row.*").columns == docs.columns and kept.count() == docs.count()
