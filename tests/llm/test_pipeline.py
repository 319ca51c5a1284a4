"""The pipeline on a small corpus with one planted case per stage, each stage judged on its own input."""

import pytest
from helpers import prose
from test_decontaminate import planted
from test_line_dedup import brute as without_repeats
from test_mixing import brute as mixed
from test_near_dup import brute as groups

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, marks = [], []
    for i in range(240):
        words = prose(i, 90 + i % 40).split(" ")
        if i % 4 == 0:
            for k in range(3, len(words), 9):
                words[k] = f"{words[k][:2]}zorgqu"
        if i % 2 == 0 or i % 3 == 0:
            marks.append((i, None, int(i % 4 == 0)))
        rows.append((i, " ".join(words)))
    shared = "\n".join(prose(900 + k, 9) for k in range(12))
    rows += [(300 + k, f"{prose(500 + k, 70)}\n{shared}\n{prose(600 + k, 60)}") for k in range(4)]
    base = prose(700, 150).split(" ")
    rows += [(400 + k, " ".join([*base[: 40 * k + 5], f"edit{k}", *base[40 * k + 5 :]])) for k in range(3)]
    rows += [(500, prose(800, 60) + " " + prose(5000, 40) + " " + prose(801, 60)), (501, None), (502, ""), (503, shared)]
    docs = [(i, t, "en", f"s{i % 3}", len(t or ""), "x") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(5000, 40))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    out = [now]
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, str(folder)))
        out.append(now)
    return out, spark.read.parquet(f"{folder}/benchmark.parquet")


def ids(df):
    return {r.doc_id for r in df.collect()}


def test_columns_stay_until_the_mix(stages):
    tables, _ = stages
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert tables[-1].columns == [*tables[0].columns, "takes"]


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after = (ids(t) for t in stages[0][:2])
    gone = before - after
    toxic = {i for i in range(0, 240, 4)}
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) <= 3


def test_repeated_lines_go(stages):
    before, after = stages[0][1:3]
    want = without_repeats([(r.doc_id, r.text) for r in before.collect()])
    got = {r.doc_id: r for r in after.collect()}
    for (i, text), (left, n) in want.items():
        if n and not left.strip():
            assert i not in got
        else:
            assert got[i].text == left
            assert got[i].n_chars == (None if left is None else len(left))
    assert sum(n for _, n in want.values()) >= 3


def test_one_of_each_group_stays(stages):
    before, after = stages[0][2:4]
    want = groups([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == {i for i, (_, _, kept) in want.items() if kept}
    assert {401, 402}.isdisjoint(ids(after)) and 400 in ids(after)


def test_leaks_go(stages):
    tables, benchmark = stages
    before, after = tables[3:5]
    bad = {i for i, _ in planted(before.collect(), benchmark.collect())}
    assert bad == {500} and ids(after) == ids(before) - bad


def test_mix_takes_what_sorting_takes(stages):
    before, after = stages[0][4:6]
    want = {i: taken // size for i, size, _, _, taken in mixed([(r.doc_id, r.text, r.source) for r in before.collect()]) if taken}
    assert {r.doc_id: r.takes for r in after.collect()} == want
