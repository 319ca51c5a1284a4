"""Reconciliation of report tables against a master table on Spark."""

from tallyframe.config import ReconConfig, config_from_dict, load_config, standard_config
from tallyframe.operators.skew import SkewPolicy
from tallyframe.plans.reconcile import Reconciliation, reconcile
from tallyframe.plans.run import RunResult, run
from tallyframe.sources.catalog import register_source

__all__ = [
    "ReconConfig", "Reconciliation", "RunResult", "SkewPolicy", "config_from_dict", "load_config",
    "reconcile", "register_source", "run", "standard_config",
]
