"""Matching report rows to master rows: exact key first, then blocked fuzzy names.

The fuzzy step looks only at rows the key did not match. A candidate shares the mobile number
or the e-mail address; the highest name score at or above the threshold wins, the first master
row in mobile-then-e-mail order among equals.

Every step works on distinct values (contact, sorted name, threshold), so copies cost nothing.
Blocks of up to `hot_block` names are compared by their contact alone. In larger blocks a pair
is formed only if it shares a segment: a name within distance d of another keeps at least one
of any d+1 consecutive parts intact, so splitting the master name into one part more than the
threshold allows changes loses no pair that could reach the threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.config import Matching
from tallyframe.errors import SchemaMismatchError
from tallyframe.functions.similarity import can_reach, sorted_name_score
from tallyframe.functions.text import blank, strip, token_sort
from tallyframe.operators.skew import DEFAULT_POLICY, SkewPolicy, attach, first_row, fits_broadcast
from tallyframe.storage import written

_EPS = 1e-9
_MOBILE, _EMAIL = 0, 1


def match_key(c: Column) -> Column:
    return F.nullif(F.upper(strip(c)), F.lit(""))


def exact_match(reports: DataFrame, crm: DataFrame, key: str = "pan") -> DataFrame:
    """Add `crm`, the first master row with the same key, null without one."""
    masters = first_row(
        crm.withColumn("_key", match_key(F.col(key))).filter(F.col("_key").isNotNull()), ["_key"], ["crm_order"]
    ).select("_key", F.struct(*crm.columns).alias("crm"))
    keyed = reports.withColumn("_key", match_key(F.col(key)))
    return attach(keyed, masters, ["_key"], small=fits_broadcast(crm)).drop("_key")


def fuzzy_options(matching: Matching) -> dict[str, Column]:
    """Per-row settings by source: `enabled`, `threshold` (0 to 100), `by_mobile`, `by_email`."""

    def settings(override: dict) -> dict:
        threshold = float(override.get("fuzzy_threshold", matching.fuzzy_threshold))
        keys = override.get("fuzzy_secondary_keys", matching.fuzzy_secondary_keys)
        keys = ("mobile", "email") if keys is None else keys
        return {
            "enabled": bool(override.get("enable_fuzzy_matching", matching.enable_fuzzy_matching)),
            "threshold": threshold if threshold > 1.0 else threshold * 100.0,
            "by_mobile": "mobile" in keys,
            "by_email": "email" in keys,
        }

    general = settings({})
    out = {}
    for option, value in general.items():
        column = None
        for source, override in matching.source_overrides.items():
            special = settings(override)[option]
            if special != value:
                test = F.col("source") == source
                column = F.when(test, F.lit(special)) if column is None else column.when(test, F.lit(special))
        out[option] = F.lit(value) if column is None else column.otherwise(F.lit(value))
    return out


def _lowest_threshold(matching: Matching) -> float:
    values = [matching.fuzzy_threshold, *[o["fuzzy_threshold"] for o in matching.source_overrides.values() if "fuzzy_threshold" in o]]
    return min(float(v) if v > 1.0 else v * 100.0 for v in values)


def _contact_rows(mobile: Column, email: Column) -> Column:
    """One (kind, key) per contact that is present."""

    def entry(kind: int, key: Column) -> Column:
        return F.when(F.coalesce(key, F.lit("")) != "", F.struct(F.lit(kind).alias("kind"), key.alias("key")))

    return F.explode(F.array_compact(F.array(entry(_MOBILE, mobile), entry(_EMAIL, email))))


def master_segments(name: str, t: float) -> Column:
    """Tags of the parts a master name is cut into; one tag for a name too short to cut.

    A name of length n is cut into one part more than the changes that still allow `t`.
    """
    parts = f"CAST(floor(2 * length({name}) * {(1 - t) / t!r}D + {_EPS}D) + 1 AS INT)"
    return F.expr(f"""
        CASE WHEN {parts} > length({name}) THEN array(CAST(length({name}) AS STRING))
        ELSE transform(sequence(0, {parts} - 1), i -> {_cut(name, f'length({name})', parts)}) END
    """)


def _cut(name: str, n: str, parts: str) -> str:
    start, end = f"CAST(floor(i * {n} / {parts}) AS INT)", f"CAST(floor((i + 1) * {n} / {parts}) AS INT)"
    return f"concat_ws(':', {n}, i, substring({name}, {start} + 1, {end} - {start}))"


def query_segments(name: str, t: float) -> Column:
    """Tags under which any master name within reach of `name` can be found.

    For every reachable length m and each of its parts: the pieces of `name` of the size of that
    part, shifted by no more than the characters removed or added before it.
    """
    n = f"length({name})"
    near = f"CAST(greatest(1, ceil({n} * {t / (2 - t)!r}D - {_EPS}D)) AS INT)"
    far = f"CAST(greatest(1, floor({n} * {(2 - t) / t!r}D + {_EPS}D)) AS INT)"
    lengths = f"""
        transform(sequence({near}, {far}), m -> named_struct(
            'm', m,
            'parts', CAST(floor(2 * m * {(1 - t) / t!r}D + {_EPS}D) + 1 AS INT),
            'removed', CAST(floor((floor({1 - t!r}D * ({n} + m) + {_EPS}D) - ({n} - m)) / 2) AS INT),
            'added', CAST(floor((floor({1 - t!r}D * ({n} + m) + {_EPS}D) + ({n} - m)) / 2) AS INT)))
    """
    pieces = """
        flatten(transform({lengths}, l -> CASE WHEN l.parts > l.m THEN array(named_struct(
                'm', l.m, 'i', -1, 'size', 0, 'low', 0, 'high', 0))
            ELSE transform(sequence(0, l.parts - 1), i -> named_struct(
                'm', l.m, 'i', i,
                'size', CAST(floor((i + 1) * l.m / l.parts) - floor(i * l.m / l.parts) AS INT),
                'low', CAST(greatest(0, floor(i * l.m / l.parts) - l.removed) AS INT),
                'high', CAST(least({n} - (floor((i + 1) * l.m / l.parts) - floor(i * l.m / l.parts)),
                                   floor(i * l.m / l.parts) + l.added) AS INT))) END))
    """.format(lengths=lengths, n=n)
    return F.expr(f"""
        array_distinct(flatten(transform(filter({pieces}, p -> p.low <= p.high), p ->
            CASE WHEN p.i < 0 THEN array(CAST(p.m AS STRING))
            ELSE transform(sequence(p.low, p.high), at ->
                concat_ws(':', p.m, p.i, substring({name}, at + 1, p.size))) END)))
    """)


def fuzzy_match(
    residual: DataFrame,
    crm: DataFrame,
    matching: Matching,
    policy: SkewPolicy = DEFAULT_POLICY,
    cut: Callable[[DataFrame], DataFrame] = written,
) -> DataFrame:
    """Add `crm` (null if no candidate qualifies) and `score` to rows without an exact match.

    `cut` materialises the two reduced inputs, which are read more than once.
    """
    block, ask = ["kind", "key"], ["_m", "_e", "_name", "_thr"]
    options = fuzzy_options(matching)
    empty = F.lit("")
    rows = residual.withColumns(
        {
            "_m": F.when(options["by_mobile"], F.coalesce(strip(F.col("mobile")), empty)).otherwise(empty),
            "_e": F.when(options["by_email"], F.coalesce(F.lower(strip(F.col("email"))), empty)).otherwise(empty),
            "_name": F.when(options["enabled"], F.coalesce(token_sort(F.col("investor_name")), empty)).otherwise(empty),
            "_thr": options["threshold"].cast("double"),
        }
    )
    asked = cut(rows.filter("_name != '' AND (_m != '' OR _e != '')").select(*ask).distinct())
    by_contact = asked.withColumn("_c", _contact_rows(F.col("_m"), F.col("_e"))).select("*", "_c.*").drop("_c")
    queries = by_contact.select(*block, "_name", "_thr").distinct()

    masters = cut(_candidate_masters(crm, queries, fits_broadcast(asked)))
    small = fits_broadcast(asked, masters)
    named = masters.filter("_crm_name != ''")
    # of small inputs one look tells which of the steps for large blocks and shared ids can be left out
    biggest, shared = _block_facts(masters) if small else (None, None)
    if small and biggest <= policy.hot_block and biggest * asked.count() <= policy.task_pairs:
        best = _scored_best(attach(queries, named, block, "inner", small).withColumn("_needed", F.col("_thr")))
    else:
        best = _best_names(queries, named, _lowest_threshold(matching) / 100.0, policy, small, cut)

    offers = attach(by_contact, best, [*block, "_name", "_thr"], "inner", small)
    if shared != 0:
        # A client id on several master rows: its mobile hit hides its e-mail hit.
        hidden = (
            masters.filter((F.col("kind") == _MOBILE) & F.col("_shared_id").isNotNull())
            .select("_shared_id", F.col("key").alias("_m"), F.lit(True).alias("_hidden"))
            .distinct()
        )
        offers = attach(offers, hidden, ["_shared_id", "_m"], "left", small).filter(
            ~((F.col("kind") == _EMAIL) & F.coalesce("_hidden", F.lit(False)))
        )
    choice = (
        offers.groupBy(*ask)
        .agg(F.max(F.struct("_best.score", (-F.col("kind")).alias("_rank"), "_best._neg")).alias("_pick"))
        .select(*ask, F.col("_pick.score").alias("score"), (-F.col("_pick._neg")).alias("crm_order"))
    )
    winners = attach(crm.select("crm_order", F.struct(*crm.columns).alias("crm")), choice, ["crm_order"], "inner", small)
    return attach(rows, winners.drop("crm_order"), ask, "left", small).drop(*ask)


def _candidate_masters(crm: DataFrame, queries: DataFrame, few: bool) -> DataFrame:
    """Master rows of the contacts asked for: the first row per contact and client id, and per
    contact and name. `_shared_id` is the client id where several master rows carry it."""
    contacts = crm.select(
        "crm_client_id", "crm_order",
        F.coalesce(token_sort(F.col("investor_name")), F.lit("")).alias("_crm_name"),
        _contact_rows(strip(F.col("mobile")), F.lower(strip(F.col("email")))).alias("_c"),
    ).select("crm_client_id", "crm_order", "_crm_name", "_c.*")
    block = ["kind", "key"]
    contacts = attach(contacts, queries.select(*block).distinct(), block, "left_semi", few)
    contacts = first_row(contacts, [*block, "crm_client_id"], ["crm_order"])
    repeated = (
        contacts.groupBy("crm_client_id")
        .agg(F.min("crm_order").alias("_a"), F.max("crm_order").alias("_b"))
        .filter("_a != _b")
        .select("crm_client_id", F.col("crm_client_id").alias("_shared_id"))
    )
    marked = attach(contacts, repeated, ["crm_client_id"])
    return first_row(marked, [*block, "_crm_name", "_shared_id"], ["crm_order"]).select(
        *block, "_crm_name", "_shared_id", "crm_order"
    )


# Below this threshold a name has to be cut into more parts than it has letters.
SEGMENTED = 2 / 3
# Scores at which the names of large blocks are looked for first when the threshold lies below that. At lower
# scores the parts of a name are so short that nearly all names share one.
LEVELS = (0.9,)


def _best_names(
    queries: DataFrame, named: DataFrame, t: float, policy: SkewPolicy, small: bool, cut: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The best name of each query and `_shared_id`, as `_best` (score, minus the master's order).

    Only the best one counts. At a threshold too low for segments, large blocks are therefore searched from
    the top: a query whose best name scores 0.9 or more has it from segments for 0.9, and only queries
    without such a name are compared with all names of fitting length.
    """
    block, ask = ["kind", "key"], ["kind", "key", "_name", "_thr"]
    if t > SEGMENTED:
        return _top(queries, named, t, policy, small)
    sizes = named.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.filter(F.col("n") > policy.hot_block).select(*block))
    if large.isEmpty():
        return _top(queries, named, t, policy, small)
    crowded = attach(named, large, block, "left_semi", small)
    left = cut(attach(queries, large, block, "left_semi", small))
    found = []
    for level in LEVELS:
        hits = cut(_top(left, crowded, level, policy, small))
        found.append(hits)
        # a master row that shares its client id may be hidden later, so it settles nothing
        settled = hits.filter("_shared_id IS NULL").select(*ask)
        left = cut(attach(left, settled, ask, "left_anti", small).filter(F.col("_thr") < level * 100))
    rest = attach(queries, large, block, "left_anti", small).unionByName(left)
    found.append(_top(rest, named, t, policy, small))
    return reduce(DataFrame.unionByName, found).groupBy(*ask, "_shared_id").agg(F.max("_best").alias("_best"))


def _block_facts(masters: DataFrame) -> tuple[int, int]:
    """Names in the largest block, and rows whose client id other rows share."""
    blocks = masters.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.count("_shared_id").alias("s"))
    facts = blocks.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s")).first()
    return facts["n"], facts["s"]


def _top(queries: DataFrame, named: DataFrame, t: float, policy: SkewPolicy, small: bool) -> DataFrame:
    """The best name of each query and `_shared_id` that scores `t` and the query's own threshold."""
    needed = F.greatest(F.col("_thr"), F.lit(t * 100.0))
    return _scored_best(_pairs(queries, named, t, policy, small).withColumn("_needed", needed))


def _scored_best(pairs: DataFrame) -> DataFrame:
    """The best pair of each query and `_shared_id` that scores `_needed`."""
    scored = (
        pairs.filter(can_reach("_crm_name", "_name", "_needed"))
        .withColumn("score", sorted_name_score(F.col("_crm_name"), F.col("_name")))
        .filter((F.col("score") >= F.col("_needed")) & (F.col("score") > 0))
    )
    return scored.groupBy("kind", "key", "_name", "_thr", "_shared_id").agg(
        F.max(F.struct("score", (-F.col("crm_order")).alias("_neg"))).alias("_best")
    )


def _pairs(queries: DataFrame, named: DataFrame, t: float, policy: SkewPolicy, small: bool) -> DataFrame:
    """Name pairs that can reach the threshold `t`, and few others."""
    block = ["kind", "key"]
    t = min(t, 1.0)
    sizes = named.groupBy(*block).agg(F.count(F.lit(1)).alias("_masters"))
    asked = queries.groupBy(*block).agg(F.count(F.lit(1)).alias("_asked"))
    # at a threshold of 0 no part of a name need be shared, so blocks stay whole and are only sliced
    large = (F.col("_masters") > policy.hot_block) & F.lit(t > 0)
    slices = F.ceil(F.col("_masters") * F.col("_asked") / policy.task_pairs).cast("int")
    special = (
        sizes.join(asked, block)
        .filter(large | (slices > 1))
        .select(*block, large.alias("_large"), slices.alias("_slices"))
    )
    whole = F.array(F.lit(""))
    count = F.coalesce("_slices", F.lit(1))

    def tags(segments: Column) -> Column:
        return F.explode(F.when(F.coalesce("_large", F.lit(False)), segments).otherwise(whole))

    asking = (
        attach(queries, special, block, "left", small)
        .withColumn("_slice", F.pmod(F.xxhash64("_name"), count).cast("int"))
        .withColumn("_tag", tags(query_segments("_name", t) if t > 0 else whole))
    )
    offered = (
        attach(named, special, block, "left", small)
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("_tag", tags(master_segments("_crm_name", t) if t > 0 else whole))
    )
    helpers = ("_large", "_slices")
    return attach(asking.drop(*helpers), offered.drop(*helpers), [*block, "_slice", "_tag"], "inner")


def check_order(crm: DataFrame) -> None:
    """Refuse a master table whose rows `crm_order` does not tell apart: it names a winner's row."""
    if "crm_order" not in crm.columns:
        raise SchemaMismatchError("The master table needs crm_order, a number per row")
    wrong = crm.groupBy("crm_order").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR crm_order IS NULL").limit(1).collect()
    if wrong:
        raise SchemaMismatchError(f"crm_order must be unique and not null: {wrong[0]['crm_order']} occurs {wrong[0]['n']} times")


def align(
    reports: DataFrame,
    crm: DataFrame,
    matching: Matching,
    policy: SkewPolicy = DEFAULT_POLICY,
    cut: Callable[[DataFrame], DataFrame] = written,
) -> DataFrame:
    """Every report row with `crm` (null if unmatched), `match_route` and `match_confidence`.

    The key join is materialised once: the matched rows are read from there and never move
    again, the few others go through the fuzzy step.
    """
    check_order(crm)
    exact = cut(exact_match(reports, crm, matching.primary_key))
    found = F.col("crm").isNotNull()
    route = "EXACT_" + matching.primary_key.upper()
    overrides = matching.source_overrides.values()
    if not matching.enable_fuzzy_matching and not any(o.get("enable_fuzzy_matching") for o in overrides):
        return exact.withColumns(
            {
                "match_route": F.when(found, route).otherwise("UNMATCHED"),
                "match_confidence": F.when(found, 1.0).otherwise(0.0),
            }
        )
    hit = exact.filter(found).withColumns({"match_route": F.lit(route), "match_confidence": F.lit(1.0)})
    rest = cut(fuzzy_match(exact.filter(~found).drop("crm"), crm, matching, policy, cut))
    same_mobile = ~blank(F.col("mobile")) & F.col("crm.mobile").eqNullSafe(F.col("mobile"))
    rest = rest.withColumns(
        {
            "match_route": F.when(~found, "UNMATCHED")
            .when(same_mobile, "FUZZY_NAME_AND_MOBILE").otherwise("FUZZY_NAME_AND_EMAIL"),
            "match_confidence": F.coalesce(F.col("score") / 100.0, F.lit(0.0)),
        }
    ).drop("score")
    return hit.unionByName(rest.select(*hit.columns))


def is_matched(df: DataFrame) -> DataFrame:
    return df.filter(F.col("match_route") != "UNMATCHED")


def missing_in_crm(aligned: DataFrame) -> DataFrame:
    """Report rows without a master row."""
    return aligned.filter(F.col("match_route") == "UNMATCHED").drop("crm")


def missing_in_report(aligned: DataFrame, crm: DataFrame) -> DataFrame:
    """Master rows whose client id no report row was matched to."""
    seen = is_matched(aligned).select(F.col("crm.crm_client_id").alias("crm_client_id")).distinct()
    return attach(crm, seen, ["crm_client_id"], "left_anti")


def is_incomplete() -> Column:
    """A master row with a PAN but neither contacts nor KYC and FATCA statuses."""
    def unknown(f: str) -> Column:
        return F.coalesce(F.col(f), F.lit("UNKNOWN")) == "UNKNOWN"

    def absent(f: str) -> Column:
        return F.coalesce(F.col(f), F.lit("")) == ""

    return ~absent("pan") & absent("mobile") & absent("email") & unknown("kyc_status") & unknown("fatca_status")


def candidate_counts(reports: DataFrame, crm: DataFrame) -> DataFrame:
    """Distinct candidate clients of each report row by mobile, by e-mail and by either.

    Counted per contact before the join. Only clients with several master rows are paired with the
    contacts asked for, through their mobiles.
    """
    def contact(c: Column) -> Column:
        return F.nullif(strip(c), F.lit(""))

    keys = {"_m": contact(F.col("mobile")), "_e": contact(F.lower(F.col("email")))}
    clients = crm.select("crm_client_id", *[c.alias(k) for k, c in keys.items()]).distinct()

    def per(columns: list[str], name: str) -> DataFrame:
        present = clients.dropna(subset=columns).select(*columns, "crm_client_id").distinct()
        return present.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))

    # Clients found by both contacts are counted once. A client with one master row has both on
    # that row; only the few with several rows are looked up by their separate contacts.
    several = clients.groupBy("crm_client_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("crm_client_id")
    single = attach(clients, several, ["crm_client_id"], "left_anti").dropna(subset=["_m", "_e"])
    split = attach(clients, several, ["crm_client_id"], "left_semi")
    rows = reports.withColumns(keys)
    asked = rows.select("_m", "_e").dropna().distinct()
    by_m = attach(asked, split.select("_m", "crm_client_id").dropna().distinct(), ["_m"], "inner")
    found = attach(by_m, split.select("_e", "crm_client_id").dropna().distinct(), ["_e", "crm_client_id"], "left_semi")
    both = single.select("_m", "_e").unionByName(found.select("_m", "_e")).groupBy("_m", "_e").agg(
        F.count(F.lit(1)).alias("_both")
    )
    rows = attach(rows, per(["_m"], "by_mobile"), ["_m"])
    rows = attach(rows, per(["_e"], "by_email"), ["_e"])
    rows = attach(rows, both, ["_m", "_e"])
    zero = F.lit(0)
    return rows.withColumns(
        {
            "by_mobile": F.coalesce("by_mobile", zero),
            "by_email": F.coalesce("by_email", zero),
            "candidates": F.coalesce("by_mobile", zero) + F.coalesce("by_email", zero) - F.coalesce("_both", zero),
        }
    ).drop("_m", "_e", "_both")
