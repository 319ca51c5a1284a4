"""Reconciliation of prepared tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyframe.config import ReconConfig
from tallyframe.operators import compare, match
from tallyframe.operators.skew import DEFAULT_POLICY, SkewPolicy
from tallyframe.schema import CRM, REPORT, conform
from tallyframe.storage import written


@dataclass(frozen=True)
class Reconciliation:
    """Lazy tables of one run."""

    aligned: DataFrame
    matched: DataFrame
    missing_in_crm: DataFrame
    missing_in_report: DataFrame
    discrepancies: DataFrame
    matched_audits: DataFrame


def reconcile(
    crm: DataFrame,
    reports: DataFrame,
    config: ReconConfig,
    run_ts: str = "",
    policy: SkewPolicy = DEFAULT_POLICY,
    cut: Callable[[DataFrame], DataFrame] = written,
) -> Reconciliation:
    """Match, compare and explain.

    `cut` materialises the matched rows, which all outputs share; the rest is lazy.
    """
    crm, reports = conform(crm, CRM), conform(reports, REPORT)
    aligned = match.align(reports, crm, config.matching, policy, cut)
    matched = match.is_matched(aligned)
    missing = match.missing_in_report(aligned, crm)
    discrepancies = compare.report_discrepancies(aligned, config, run_ts).unionByName(
        compare.master_discrepancies(missing, config, run_ts)
    )
    return Reconciliation(
        aligned=aligned,
        matched=matched,
        missing_in_crm=match.missing_in_crm(aligned),
        missing_in_report=missing,
        discrepancies=discrepancies,
        matched_audits=compare.matched_audits(matched, config, run_ts),
    )
