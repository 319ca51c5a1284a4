import random
import re
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
from helpers import LOWER, awkward, empty, prose
from pyspark.sql import functions as F

from tallyframe.llm import divergence
from tallyframe.llm.divergence import AuditRule

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, rule=divergence.DEFAULT_RULE):
    """The report, one document and one pair of sources after the other."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        docs[lang].update(found.keys())
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= rule.least_docs]
        v = len(kept)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + rule.scale * (count[t] + 2) // (total + 2 * v) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}

        def apart(p, q):
            return (p - q) * (p - q) // (p + q)

        for s in sources:
            pairs = [(sum(apart(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(apart(own[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, rule.top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked[:top], 1)}
    return out


def check(spark, rows, rule=divergence.DEFAULT_RULE):
    docs = spark.createDataFrame([(i % 7, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string")
    got = divergence.divergence_audit(docs.repartition(3), rule).collect()
    want = brute(rows, rule)
    assert len(got) == len(want)
    assert {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got} == want
    return got


def cases():
    rows = [("en", f"s{i % 4}", prose(i % 40, 60) + " The the, (THE) it's x" + "y" * (i % 3)) for i in range(200)]
    rows += [("de", "only", f"Straße straße Ä{i} b　c") for i in range(12)] + [("xx", "a", "rare"), ("xx", "b", None), ("xx", None, "")]
    rows += [(None, None, "no lang"), (None, "s1", None), ("en", "silent", "123 ..."), ("en", None, "a-b_c.d " * 3_000)]
    rows += [("en", "s1", "x" * 200_000), ("en", "s2", " \t\n "), ("en", "s0", "dup dup dup"), ("en", "s0", "dup dup dup")]
    return rows


def test_matches_term_by_term(spark):
    got = check(spark, cases())
    assert {r.value for r in got if r.lang == "xx"} == {0}
    assert {(r.source, r.part) for r in got if r.lang == "en"} >= {("silent", "pair"), ("s1", "term")}


def test_small_blocks_and_other_rules(spark):
    check(spark, cases(), AuditRule(block_bytes=2_000, least_docs=2, top=3))


def test_ties_and_exact_arithmetic(spark):
    rows = [("en", f"s{i % 2}", f"a{'bcdefghijklm'[i % 12]} common") for i in range(240)]
    check(spark, rows, AuditRule(least_docs=1, scale=2_000_000_000))


def test_one_block():
    """A document counts once per term, whatever chunks it stands in."""
    block = divergence.Block()
    for group, text in ((7, b"a, b... a, c c c c c"), (9, b"b... b...\x0bb... b...")):
        block.add(group, text)
    blocks = pa.Table.from_batches([block.row(1)])
    assert blocks.column("chunks").to_pylist() == [["a,", "b...", "c"]]
    found = pa.RecordBatch.from_pydict({"home": [1, 1], "place": pa.array([1, 0], pa.int32()), "tids": [[50, 60, 60], [-50]]})
    found = pa.Table.from_batches(list(divergence._gathered([found])))
    want = {(7, -50, 1, 2), (7, 50, 1, 1), (7, 60, 1, 2), (9, 50, 1, 4), (9, 60, 1, 8)}
    assert set(zip(*(c.tolist() for c in divergence._cells(blocks, found)))) == want
    for parts in (1, 3):
        packed = divergence._summed(parts)(blocks, found)
        twice = pa.concat_tables([packed, packed])
        got = divergence._added(twice).to_pylist()
        assert {(r["gid"], r["tid"], r["docs"] // 2, r["n"] // 2) for r in got} == want and len(got) == 5
    assert divergence._summed(1)(blocks, found.slice(0, 0)).num_rows == 0


def counted_block(texts):
    block = divergence.Block()
    for i, text in enumerate(texts):
        block.add(i % 4, text.encode())
    blocks = pa.Table.from_batches([block.row(1)])
    terms = [TERM.findall(c.translate(LOWER)) for c in blocks.column("chunks")[0].as_py()]
    ids = {t: k for k, t in enumerate(sorted({t for c in terms for t in c}), -3)}
    held = [k for k, c in enumerate(terms) if c]
    found = pa.RecordBatch.from_pydict({
        "home": [1] * len(held), "place": pa.array(held, pa.int32()),
        "tids": pa.array([[ids[t] for t in terms[k]] for k in held], pa.list_(pa.int64()))})
    return blocks, pa.Table.from_batches(list(divergence._gathered([found]))), ids


def test_chunks_of_equal_terms_are_one(spark):
    """Punctuation and the case of A-Z make no chunks of their own."""
    texts = ["The the, (THE) the... *** 12 \"the\" the###", "the\vit's It,S it--s\t", " Ä, ä", None, ""]
    docs = spark.createDataFrame([(i, (t or "").encode()) for i, t in enumerate(texts)], "gid long, raw binary").coalesce(1)
    blocks = docs.mapInArrow(divergence._counted(divergence.DEFAULT_RULE), divergence.BLOCKS).collect()
    found = [c for b in blocks for c in b.chunks if TERM.search(c)]
    assert len(found) == len(set(found)) == 4 and {tuple(TERM.findall(c)) for c in found} == {("the",), ("it", "s"), ("Ä",), ("ä",)}


def test_folding_keeps_the_terms():
    drawn = random.Random(11)
    letters = [chr(c) for c in range(128)] + list("..,, \n\x1c  Äé\u0130\u2003")
    for text in ["".join(drawn.choices(letters, k=n % 60)) for n in range(3_000)] + ["." * 99 + "a" + "." * 99 + "b", ".", ""]:
        assert TERM.findall(divergence._folded(text.encode()).decode()) == TERM.findall(text.translate(LOWER))


def test_texts_are_cut_in_stretches(monkeypatch):
    texts = [prose(i % 9, 40) + f" x{i % 5}" for i in range(30)] + ["", " ", "a", "\ta  a b\n", "a" * 5_000]
    for at_once in (1, 500, 1 << 21):
        monkeypatch.setattr(divergence, "CUT_AT_ONCE", at_once, raising=False)
        block = divergence.Block()
        for i, text in enumerate(texts):
            block.add(i % 3, text.encode())
        row = block.row(5)
        groups, sizes = divergence.unpack(row["docs"][0].as_py(), divergence.np.int64, divergence.np.int32)
        place, count = divergence.unpack(row["pairs"][0].as_py(), divergence.np.int32, divergence.np.int32)
        chunks = row["chunks"][0].as_py()
        assert groups.tolist() == [i % 3 for i in range(len(texts))] and len(set(chunks)) == len(chunks)
        assert row["n_pairs"][0].as_py() == len(place) == sizes.sum()
        ends = sizes.cumsum()
        for text, a, b in zip(texts, ends - sizes, ends, strict=True):
            got = {chunks[p]: n for p, n in zip(place[a:b].tolist(), count[a:b].tolist(), strict=True) if chunks[p]}
            assert got == Counter(text.encode().decode().split())


def test_a_block_is_counted_in_stretches(monkeypatch):
    texts = [prose(i % 9, 40) + " The the, (THE) it's" for i in range(30)] + ["", "1 2", "x-y " * 90, "7"]
    blocks, found, ids = counted_block(texts)
    docs, n = Counter(), Counter()
    for i, text in enumerate(texts):
        terms = TERM.findall(text.translate(LOWER))
        docs.update((i % 4, ids[t]) for t in set(terms))
        n.update((i % 4, ids[t]) for t in terms)
    want = {(*cell, docs[cell], n[cell]) for cell in docs}
    for entries in (1, 50, 1 << 17):
        monkeypatch.setattr(divergence, "ENTRIES", entries, raising=False)
        got = list(zip(*(c.tolist() for c in divergence._cells(blocks, found)), strict=True))
        assert set(got) == want and len(got) == len(want)


def test_memory_of_a_block():
    blocks, found, _ = counted_block([prose(i % 25, 3_000) for i in range(400)])
    tracemalloc.start()
    divergence._cells(blocks, found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * blocks.column("n_pairs")[0].as_py()  # 31 bytes a chunk of a document; 116 with all documents at once


def test_terms_that_share_a_hash(spark):
    """Terms whose hashes are equal, or are the next number, have numbers of their own."""
    rows = [(c + d,) for c in "abcdef" for d in "xyz"]
    terms = spark.createDataFrame(rows, "term string")
    for hashed in (lambda t: F.length(t).cast("long"), lambda t: (F.ascii(t) % 2).cast("long"), F.xxhash64):
        number = divergence.term_number(terms, hashed)
        got = {r.term: r.tid for r in terms.select("term", number(F.col("term")).alias("tid")).collect()}
        assert len(set(got.values())) == len(rows)


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark).selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r.lang for r in divergence.divergence_audit(docs).collect()} <= {""}
    assert divergence.divergence_audit(empty(spark).selectExpr("*", "'en' AS lang")).collect() == []
