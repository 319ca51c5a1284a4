"""One row of each near-duplicate group stays when ids repeat or are null."""

from helpers import prose

from tallyframe.llm import near_dup


def test_repeated_and_null_ids(spark):
    a, b, c, d, e = (prose(40 + i, 60) for i in range(5))
    rows = [(1, a, "x"), (1, a, "y"), (2, a, "x"), *[(5, b, str(i)) for i in range(30)],
            # another text under a kept id, whose own group is named by 1
            (5, a, "x"), (7, c, "x"), (7, c.upper(), "x"), (7, d, "x"),
            # copies without an id: of a named group, of none, without words
            *[(None, a, str(i)) for i in range(30)], *[(None, e, str(i)) for i in range(30)],
            (None, None, "x"), (None, None, "y"), (None, "", "x"), (8, None, "x"), (8, "", "x"), (8, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc string")
    kept = [tuple(r) for r in near_dup.keep_one(docs).collect()]
    assert set(kept) <= set(rows)
    want = [(1, a), (5, b), (7, c), (7, d), (None, e), (None, None), (None, ""), (8, None), (8, "")]
    got = [(i, c if i == 7 and t == c.upper() else t) for i, t, _ in kept]
    assert sorted(map(str, got)) == sorted(map(str, want))
