import tracemalloc
import zlib

import numpy as np
from helpers import awkward, empty, prose

from tallyframe.llm import toxicity

RULE = toxicity.ToxicityRule(bits=14, steps=80, per_class=400)


def labelled(spark, n=600):
    rows, marks = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = prose(i, 60 + i % 50).split(" ")
        if toxic:  # misspelt anew each time: only n-grams are shared
            for k in range(5, len(words), 12):
                words[k] = f"{words[k][:2]}zorgqu{words[k][-2:]}"
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, RULE)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    right = sum(got[i].predicted == (i % 3 == 0) for i in held)
    assert right / len(held) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_do_not_matter(spark):
    docs, labels = labelled(spark, 150)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity._split(labels["doc_id"]) == 1, 1 - labels["toxic"]).otherwise(labels["toxic"]))
    assert toxicity.train(docs, labels, RULE) == toxicity.train(docs, flipped, RULE)


def test_awkward_rows_and_empty_tables(spark):
    docs, labels = labelled(spark, 60)
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 5), (3, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.unionByName(odd), RULE)
    got = toxicity.score(awkward(spark), model).collect()
    assert len(got) == 18
    blank = {r.score for r in got if r.doc_id in (4, 5, 6)}
    assert len(blank) == 1  # null, empty and blank texts score the bias
    assert toxicity.score(empty(spark), model).collect() == []
    none = toxicity.train(docs, labels.limit(0), RULE)
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_pieces_cover_the_text():
    text = prose(1, 5000)
    assert "".join(toxicity._pieces(text, 100)) == text


def test_filter_keeps_columns(spark):
    docs = awkward(spark)
    model = toxicity.train(*labelled(spark, 60), RULE)
    assert toxicity.keep_civil(docs, model).columns == docs.columns


def test_fit_holds_its_n_grams_once():
    rule = toxicity.ToxicityRule(bits=16, dims=2, steps=2)
    texts = [prose(i % 150, 1_500) for i in range(450)]
    entries = sum(len(np.unique(toxicity.buckets(t, rule))) for t in texts)
    tracemalloc.start()
    toxicity.fit(texts, [i % 2 for i in range(450)], rule)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * entries  # 8 bytes of each entry, and what a stretch and the weights take; 34 with all at once


def test_stretches_do_not_change_the_model(monkeypatch):
    texts, labels = [prose(i % 40, 30 + i % 9) for i in range(120)] + [""], [i % 3 == 0 for i in range(121)]
    want = toxicity.fit(texts, labels, RULE)
    monkeypatch.setattr(toxicity, "STRETCH", 50)
    assert toxicity.fit(texts, labels, RULE) == want
