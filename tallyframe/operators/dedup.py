"""De-duplication inside one file: the first row of a key survives, later ones are classified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import strip
from tallyframe.operators.skew import attach, first_row
from tallyframe.schema import file_key

# Fields whose difference makes a duplicate a conflicting one.
CONFLICT_FIELDS = (
    "investor_name", "mobile", "email", "kyc_status", "fatca_status",
    "investor_status", "last_transaction_date", "total_amount",
)

_KEY = ["_file", "_pan", "_part"]


def _keyed(df: DataFrame, kind: str) -> DataFrame:
    """A master row is keyed by client id; a report row by folio, or by PAN alone without one."""
    if kind == "crm":
        file, part = F.lit(""), F.col("crm_client_id")
    else:
        file = file_key(df)
        part = F.coalesce(strip(F.col("folio_number")), F.lit(""))
    return df.withColumns({"_file": file, "_pan": F.col("pan"), "_part": part})


def _order(kind: str) -> str:
    return "crm_order" if kind == "crm" else "raw_row_index"


def dedup_first(df: DataFrame, kind: str = "report") -> DataFrame:
    """Surviving rows."""
    return first_row(_keyed(df, kind), _KEY, [_order(kind)]).drop(*_KEY)


def duplicates(df: DataFrame, kind: str = "report") -> DataFrame:
    """Non-surviving rows with `failure_type`, `conflicts` and `message`.

    The surviving rows are reduced first and only those of repeated keys are joined back.
    """
    order = _order(kind)
    fields = [f for f in CONFLICT_FIELDS if f in df.columns]
    keyed = _keyed(df, kind)
    first = (
        keyed.groupBy(*_KEY)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first_order"),
             F.min_by(F.struct(*fields), order).alias("_first"))
        .filter("_n > 1")
        .drop("_n")
    )
    conflicts = F.array_compact(
        F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_first.{f}")), F.lit(f)) for f in fields])
    )
    conflicting = F.size("conflicts") > 0
    return (
        attach(keyed, first, _KEY, "inner")
        .filter(F.col(order) > F.col("_first_order"))
        .withColumn("conflicts", conflicts)
        .withColumn("failure_type", F.when(conflicting, "CONFLICTING_DUPLICATE").otherwise("EXACT_DUPLICATE"))
        .withColumn(
            "message",
            F.when(conflicting,
                   F.concat(F.lit("Conflicting duplicate record found for PAN '"), F.col("pan"),
                            F.lit("'. Conflict in fields: "), F.concat_ws(", ", "conflicts"), F.lit(".")))
            .otherwise(F.concat(F.lit("Exact duplicate record found for PAN '"), F.col("pan"), F.lit("'."))),
        )
        .drop(*_KEY, "_first", "_first_order")
    )
