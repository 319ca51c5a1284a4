"""Matching against a sequential brute-force matcher, hot contacts, and plan shapes."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.config import Matching
from tallyframe.functions.similarity import indel_ratio
from tallyframe.operators import match
from tallyframe.operators.skew import SkewPolicy
from tallyframe.schema import CRM, REPORT, conform

WORDS = ["ASHA", "ASHISH", "RAO", "RAOS", "KUMAR", "KUMARI", "BALA", "SHAH", "NAIR", "NAYAR", "DEV", "DEVI", "K", ""]


def brute(crm, reports, enabled, threshold, keys):
    """First key match, else best name among contact hits in mobile-then-e-mail order."""
    out = {}
    for r in reports:
        exact = [c for c in crm if c["pan"] == r["pan"]]
        if exact:
            out[r["raw_row_index"]] = (exact[0]["crm_order"], "EXACT_PAN", 1.0)
            continue
        best, score, route = None, 0.0, "UNMATCHED"
        if enabled:
            hits = []
            if "mobile" in keys and r["mobile"]:
                hits += [c for c in crm if c["mobile"] == r["mobile"]]
            if "email" in keys and r["email"]:
                hits += [c for c in crm if c["email"] == r["email"]]
            seen = set()
            for c in hits:
                if c["crm_client_id"] in seen:
                    continue
                seen.add(c["crm_client_id"])
                a, b = (" ".join(sorted(x["investor_name"].split())) for x in (c, r))
                if not a or not b:
                    continue
                s = indel_ratio(a, b)
                if s >= threshold and s > score:
                    best, score = c["crm_order"], s
                    route = "FUZZY_NAME_AND_MOBILE" if r["mobile"] and c["mobile"] == r["mobile"] else "FUZZY_NAME_AND_EMAIL"
        out[r["raw_row_index"]] = (best, route, score / 100.0)
    return out


def make(seed, n_crm=160, n_rep=160):
    rng = random.Random(seed)

    def name():
        return " ".join(w for w in rng.choices(WORDS, k=rng.randint(1, 4)) if w)

    def contact(kind):
        if rng.random() < 0.15:
            return None
        n = 0 if rng.random() < 0.4 else rng.randint(1, 25)  # one contact is hot
        return f"98765{n:05d}" if kind == "m" else f"u{n}@x.org"

    crm = [
        {"crm_client_id": f"C{rng.randint(0, 9) if rng.random() < 0.15 else 100 + i}", "crm_order": i,
         "pan": f"PAN{rng.randint(0, 300)}", "investor_name": name(), "mobile": contact("m"), "email": contact("e")}
        for i in range(n_crm)
    ]
    reports = [
        {"source": "CAMS", "raw_row_index": i + 2, "pan": f"PAN{rng.randint(0, 300) if rng.random() < 0.3 else 1000 + i}",
         "investor_name": rng.choice(crm)["investor_name"] if rng.random() < 0.5 else name(),
         "mobile": contact("m"), "email": contact("e")}
        for i in range(n_rep)
    ]
    return crm, reports


def frames(spark, crm, reports):
    c = spark.createDataFrame(crm, "crm_client_id string, crm_order bigint, pan string, investor_name string, mobile string, email string")
    r = spark.createDataFrame(reports, "source string, raw_row_index bigint, pan string, investor_name string, mobile string, email string")
    return conform(c, CRM), conform(r, REPORT)


@pytest.mark.parametrize(
    "seed,threshold,keys,policy",
    [
        (1, 0.9, ("mobile", "email"), SkewPolicy()),
        (2, 0.8, ("mobile", "email"), SkewPolicy(hot_block=3, task_pairs=20)),
        (3, 0.9, ("mobile", "email"), SkewPolicy(hot_block=0)),
        (4, 0.7, ("email",), SkewPolicy(hot_block=2, task_pairs=1)),
        (5, 0.5, ("mobile",), SkewPolicy(hot_block=1, task_pairs=10)),
        (10, 0.4, ("mobile", "email"), SkewPolicy(hot_block=4)),
        (11, 0.6, ("mobile", "email"), SkewPolicy(hot_block=0, task_pairs=20)),
        (12, 0.0, ("mobile", "email"), SkewPolicy(hot_block=5)),
        (6, 1.0, ("mobile", "email"), SkewPolicy(hot_block=1)),
    ],
)
def test_fuzzy_against_brute_force(spark, seed, threshold, keys, policy):
    crm, reports = make(seed)
    want = brute(crm, reports, True, threshold * 100.0 if threshold <= 1 else threshold, keys)
    matching = Matching(enable_fuzzy_matching=True, fuzzy_threshold=threshold, fuzzy_secondary_keys=keys)
    c, r = frames(spark, crm, reports)
    rows = match.align(r, c, matching, policy).select(
        "raw_row_index", F.col("crm.crm_order").alias("o"), "match_route", F.round("match_confidence", 9).alias("conf")).collect()
    got = {x.raw_row_index: (x.o, x.match_route, x.conf) for x in rows}
    assert len(rows) == len(reports)  # nobody lost, nobody doubled
    assert got == {k: (o, route, round(conf, 9)) for k, (o, route, conf) in want.items()}
    assert any(route.startswith("FUZZY") for _, route, _ in want.values())


def test_segments_lose_no_pair(spark):
    rng = random.Random(0)
    names = ["".join(rng.choices("ABC ", k=rng.randint(1, 24))).strip() or "A" for _ in range(140)]
    df = spark.createDataFrame([(n,) for n in set(names)], "n string")
    for t in (0.7, 0.85, 0.95, 1.0):
        a = df.select(F.col("n").alias("a"), F.explode(match.query_segments("n", t)).alias("tag"))
        b = df.select(F.col("n").alias("b"), F.explode(match.master_segments("n", t)).alias("tag"))
        found = {(x.a, x.b) for x in a.join(b, "tag").select("a", "b").distinct().collect()}
        near = {(x, y) for x in set(names) for y in set(names) if indel_ratio(x, y) >= t * 100}
        assert near <= found


def test_disabled_and_per_source_options(spark):
    crm, reports = make(7, 40, 40)
    c, r = frames(spark, crm, reports)
    routes = {x.match_route for x in match.align(r, c, Matching()).select("match_route").distinct().collect()}
    assert routes <= {"EXACT_PAN", "UNMATCHED"}
    off = Matching(enable_fuzzy_matching=True, fuzzy_threshold=0.5, fuzzy_secondary_keys=("mobile", "email"),
                   source_overrides={"CAMS": {"enable_fuzzy_matching": False}})
    assert {x.match_route for x in match.align(r, c, off).select("match_route").distinct().collect()} == routes


def test_known_scores(spark):
    c, r = frames(
        spark,
        [{"crm_client_id": "C1", "crm_order": 0, "pan": "P1", "investor_name": "RAMESH KUMAR SHARMA", "mobile": "9876543210", "email": "a@x.org"}],
        [{"source": "CAMS", "raw_row_index": 2, "pan": "P2", "investor_name": "SHARMA RAMESH KUMAR", "mobile": "9876543210", "email": None},
         {"source": "CAMS", "raw_row_index": 3, "pan": "P3", "investor_name": "RAMESH SHARMA", "mobile": None, "email": "A@x.org"},
         {"source": "CAMS", "raw_row_index": 4, "pan": " p1 ", "investor_name": "X", "mobile": None, "email": None}])
    m = Matching(enable_fuzzy_matching=True, fuzzy_threshold=0.80, fuzzy_secondary_keys=("mobile", "email"))
    got = {x.raw_row_index: (x.match_route, round(x.match_confidence, 4)) for x in match.align(r, c, m).collect()}
    assert got == {2: ("FUZZY_NAME_AND_MOBILE", 1.0), 3: ("FUZZY_NAME_AND_EMAIL", 0.8125), 4: ("EXACT_PAN", 1.0)}


def test_missing_in_report_goes_by_client_id(spark):
    c, r = frames(
        spark,
        [{"crm_client_id": i, "crm_order": n, "pan": p, "investor_name": "A", "mobile": None, "email": None}
         for n, (i, p) in enumerate([("C1", "P1"), ("C2", "P1"), ("C1", "P2")])],
        [{"source": "CAMS", "raw_row_index": 2, "pan": "P1", "investor_name": "A", "mobile": None, "email": None}])
    aligned = match.align(r, c, Matching())
    assert [x.crm_client_id for x in match.missing_in_report(aligned, c).collect()] == ["C2"]


def test_hot_key_keeps_every_row(spark):
    """A third of the rows share one PAN, one mobile and one name."""
    n = 3000
    crm = spark.range(n).selectExpr(
        "concat('C', id) AS crm_client_id", "id AS crm_order", "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('P', id) END AS pan",
        "CASE WHEN id % 3 = 0 THEN 'ASHA RAO' ELSE concat('NAME ', id) END AS investor_name",
        "CASE WHEN id % 3 = 0 THEN '9000000001' ELSE concat('98', id) END AS mobile")
    rep = spark.range(n).selectExpr(
        "'CAMS' AS source", "id + 2 AS raw_row_index",
        "CASE WHEN id % 3 = 0 THEN 'HOT' WHEN id % 3 = 1 THEN concat('Q', id) ELSE concat('P', id) END AS pan",
        "CASE WHEN id % 3 = 1 THEN 'RAO ASHA' ELSE concat('NAME ', id) END AS investor_name",
        "CASE WHEN id % 3 = 1 THEN '9000000001' ELSE concat('98', id) END AS mobile")
    m = Matching(enable_fuzzy_matching=True, fuzzy_threshold=0.9, fuzzy_secondary_keys=("mobile", "email"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        aligned = match.align(conform(rep, REPORT), conform(crm, CRM), m)
        got = {(x.match_route, x.o): x["count"] for x in aligned.groupBy(
            "match_route", F.when(F.col("crm.pan") == "HOT", F.col("crm.crm_order")).alias("o")).count().collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {("EXACT_PAN", 0): 1000, ("EXACT_PAN", None): 1000, ("FUZZY_NAME_AND_MOBILE", 0): 1000}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    crm, reports = make(8, 40, 40)
    c, r = frames(spark, crm, reports)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exact = match.exact_match(r, c)
        text = plan(exact)
        assert "WindowGroupLimit" in text  # the first row per key is taken before the shuffle
        assert "SortMergeJoin" in text
        m = Matching(enable_fuzzy_matching=True, fuzzy_threshold=0.9, fuzzy_secondary_keys=("mobile", "email"))
        fuzzy = match.fuzzy_match(exact.drop("crm"), c, m)
        text += plan(fuzzy) + plan(match.candidate_counts(r, c))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Scan" in text and "BatchEvalPython" not in text  # Arrow only


def test_candidate_counts(spark):
    crm, reports = make(9, 80, 60)
    c, r = frames(spark, crm, reports)
    got = {x.raw_row_index: (x.by_mobile, x.by_email, x.candidates) for x in match.candidate_counts(r, c).collect()}
    for rep in reports:
        m = {x["crm_client_id"] for x in crm if rep["mobile"] and x["mobile"] == rep["mobile"]}
        e = {x["crm_client_id"] for x in crm if rep["email"] and x["email"] == rep["email"]}
        assert got[rep["raw_row_index"]] == (len(m), len(e), len(m | e))


def test_hot_key_is_split_over_tasks(spark):
    """A third of the report rows share one key: adaptive execution splits that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.shuffle.partitions": "8",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 30_000
        crm = spark.range(n).selectExpr("concat('C', id) AS crm_client_id", "id AS crm_order", "concat('P', id) AS pan",
                                        "concat('NAME ', id) AS investor_name")
        rep = spark.range(0, n, 1, 8).selectExpr(
            "'CAMS' AS source", "id AS raw_row_index", "CASE WHEN id % 3 = 0 THEN 'P3' ELSE concat('P', id) END AS pan",
            "md5(cast(id AS string)) AS investor_name")
        joined = match.exact_match(conform(rep, REPORT), conform(crm, CRM))
        assert joined.filter("crm IS NOT NULL").select("raw_row_index", "crm.crm_client_id", "investor_name").toPandas().shape[0] == n
        probe = joined.select("raw_row_index", "investor_name", "crm.crm_client_id")
        rows = probe.collect()
        assert len(rows) == n
        assert "skew=true" in plan(probe)
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_master_rows_need_a_unique_order(spark):
    from tallyframe.errors import SchemaMismatchError
    from tallyframe.operators.match import check_order

    check_order(spark.range(5).withColumnRenamed("id", "crm_order"))
    for bad in (spark.range(5), spark.sql("SELECT 1L AS crm_order UNION ALL SELECT 1L"), spark.sql("SELECT CAST(NULL AS BIGINT) AS crm_order")):
        with pytest.raises(SchemaMismatchError, match="crm_order"):
            check_order(bad)


def test_low_threshold_in_a_hot_block(spark, monkeypatch):
    """One mobile on a third of both sides at a threshold of 0.5: few pairs are formed, the best names are found."""
    rng = random.Random(5)
    names = sorted({" ".join("".join(rng.choices("ABCDEFGHIKLMNOPRSTUVY", k=rng.randint(4, 8))) for _ in range(3)) for _ in range(700)})
    crm = [{"crm_client_id": f"C{i}", "crm_order": i, "pan": f"P{i}", "investor_name": n, "mobile": "9" if i % 3 == 0 else f"8{i}",
            "email": None} for i, n in enumerate(names)]
    hot = names[::3]
    reports = []
    for i in range(600):
        name = rng.choice(hot)
        if i % 20 == 0:  # no name close to it
            name = " ".join("".join(rng.choices("ABCDEFGHIKLMNOPRSTUVY", k=6)) for _ in range(3))
        elif i % 2:
            at = rng.randrange(len(name))
            name = name[:at] + "Z" + name[at + 1 :]
        reports.append({"source": "CAMS", "raw_row_index": i + 2, "pan": f"Q{i}", "investor_name": name,
                        "mobile": "9" if i % 3 == 0 else f"8{i}", "email": None})
    want = brute(crm, reports, True, 50.0, ("mobile",))
    formed = []
    plain = match._pairs
    monkeypatch.setattr(match, "_pairs", lambda *args: formed.append(plain(*args)) or formed[-1])
    m = Matching(enable_fuzzy_matching=True, fuzzy_threshold=0.5, fuzzy_secondary_keys=("mobile",))
    c, r = frames(spark, crm, reports)
    rows = match.align(r, c, m, SkewPolicy(hot_block=100)).select("raw_row_index", F.col("crm.crm_order").alias("o"), "match_route").collect()
    assert {x.raw_row_index: (x.o, x.match_route) for x in rows} == {k: v[:2] for k, v in want.items()}
    assert len(formed) == len(match.LEVELS) + 1
    asked = len({x["investor_name"] for x in reports if x["mobile"] == "9"})
    assert sum(p.count() for p in formed) < asked * len(hot) / 3
