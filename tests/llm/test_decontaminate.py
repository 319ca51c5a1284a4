from helpers import awkward, empty, prose

from tallyframe.llm import decontaminate as D

ITEMS = "item_id long, text string, doc_id string"


def items(spark):
    rows = [(1, prose(50, 30) + ".\n" + prose(51, 12)), (2, "Why " + prose(52, 15) + "? " + prose(53, 2)), (3, prose(54, 40)),
            (4, prose(54, 40)), (5, None), (6, "  "), (None, prose(55, 20)), (7, "--- ---")]
    return spark.createDataFrame([(*r, "x") for r in rows], ITEMS)


def corpus(spark, benchmark):
    rows = [(i, prose(i, 200 + i)) for i in range(40)]
    for k, r in enumerate(benchmark.collect()):
        text = (r.text or "").replace("\n", " ")
        rows.append((100 + k, prose(200 + k, 150) + " " + text + "%%% " + prose(300 + k, 90)))
        rows.append((120 + k, prose(400 + k, 90) + " " + text[: len(text) // 3]))  # a third is no leak
    rows += [(140, prose(50, 30)), (141, None), (142, ""), (143, benchmark.first().text.upper())]
    return spark.createDataFrame(rows, "doc_id long, text string")


def planted(rows, benchmark):
    """Items whose words stand in a text in a row, by looking everywhere."""
    tokens = D.Tokens()
    known = [(r.item_id, tokens.words(r.text.encode())) for r in benchmark if r.text]
    out = set()
    for r in rows:
        words = tokens.words((r.text or "").encode()).tolist()
        for item, want in known:
            want = want.tolist()
            if want and any(words[k : k + len(want)] == want for k in range(len(words) - len(want) + 1)):
                out.add((r.doc_id, item))
    return out


def test_whole_copies_are_found_and_nothing_else(spark):
    benchmark = items(spark)
    docs = corpus(spark, benchmark)
    want = planted(docs.collect(), benchmark.collect())
    found = D.find_leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    assert all(r.question_overlap == r.answer_overlap == 1 for r in found)
    # small shards: the same in several passes
    again = D.find_leaks(docs, benchmark, rule=D.LeakRule(shard_bytes=150)).collect()
    assert {(r.doc_id, r.item_id) for r in again} == want


def test_skipping_blocks_loses_nothing():
    index = {b: D.ItemIndex([(i, prose(i, 10 + i % 30)) for i in range(60)], D.LeakRule(share=0.4, blocks=b)) for b in (1, 7, 60)}
    words = D.Tokens().words(" ".join(prose(i % 80, 10 + i % 30) for i in range(0, 300, 3)).encode())
    found = {b: {(p, ix.ids[i], round(s, 6)) for p, _, i, s in ix.search(words)} for b, ix in index.items()}
    assert found[1] == found[7] == found[60] and len(found[1]) > 20


def test_removal_keeps_other_rows_and_columns(spark):
    benchmark = items(spark)
    docs = awkward(spark)
    kept = D.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    leak = spark.createDataFrame([(None, prose(54, 40)), (None, "clean"), (1, "clean"), (1, "clean")], "doc_id long, text string")
    assert [tuple(r) for r in D.without_leaks(leak, benchmark).orderBy("doc_id").collect()] == [(None, "clean"), (1, "clean"), (1, "clean")]


def test_empty_tables(spark):
    benchmark = items(spark)
    assert D.find_leaks(empty(spark), benchmark).collect() == []
    assert D.find_leaks(awkward(spark), benchmark.limit(0)).collect() == []


def test_halves():
    assert D.halves("What is it? A cat.") == ("What is it?", " A cat.")
    assert D.halves("One here. Two there.") == ("One here.", " Two there.")
    assert D.halves("a b c d") == ("a b c", "d")
