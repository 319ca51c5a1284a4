import hashlib
import re

from helpers import awkward, empty, prose

from tallyframe.llm import fingerprints as P

PARAGRAPH = re.compile(P.DEFAULT_RULE.paragraph)


def pieces(text):
    return {p.strip(" ") for p in PARAGRAPH.findall(text)} - {""}


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    known = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (-r[0], r[1].encode()))
    pairs = list(zip(known, known[1:] + known[:1], strict=True)) + [((None, t or ""),) * 2 for i, t in rows if i is None]
    out = []
    for (i, text), (_, after) in pairs:
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), round(share(pieces(text), pieces(edited)), 9),
                    round(share(pieces(text), pieces(after)), 9)))
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = P.fingerprint_report(docs).collect()
    mine = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(map(str, mine)) == sorted(map(str, brute(rows)))
    return got


def test_awkward_rows_match_exact_sets(spark):
    got = check(awkward(spark))
    prints = {}
    for r in got:
        if r.doc_id in (1, 2, 4, 5):
            prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[1] == prints[2] and prints[4] == prints[5] == {"48:"}


def test_long_documents_need_larger_tables(spark):
    """Hundreds of differing paragraphs: the first tables cannot be peeled, the larger ones recover all."""
    rows = [(i, ". ".join(prose(i * 1000 + k, 14) for k in range(30 * i + 1)) + ".") for i in range(12)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_peeling_recovers_the_differing_digests(spark):
    df = spark.sql("SELECT transform(sequence(1, 60), x -> xxhash64(x)) AS a, transform(sequence(6, 66), x -> xxhash64(x)) AS b")
    F = P.F
    cells = F.lit(16)
    out = df.select("a", "b", P.peel(P.sketch(F.col("a"), 16), P.sketch(F.col("b"), 16), cells, P.DEFAULT_RULE).alias("r")).first()
    assert out.r.rest == []
    assert {x.id for x in out.r.found if x.n == 1} == set(out.a) - set(out.b)
    assert {x.id for x in out.r.found if x.n == -1} == set(out.b) - set(out.a)


def test_single_document_follows_itself(spark):
    check(spark.createDataFrame([(7, prose(1, 100))], "doc_id long, text string"))


def test_empty_table(spark):
    assert P.fingerprint_report(empty(spark)).collect() == []
