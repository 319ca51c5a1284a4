"""Run configuration: frozen dataclasses, a YAML loader and the source profiles."""

from __future__ import annotations

import dataclasses
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.errors import ConfigurationError, FileAccessError
from tallyframe.schema import EXTENDED_FIELDS

Names = tuple[str, ...]


@dataclass(frozen=True)
class SourceProfile:
    available_fields: Names = ()
    required_fields: Names = ()
    compare: Names = ()
    validations: Names = ()


@dataclass(frozen=True)
class EngineSettings:
    run_mode: str = "STRICT"
    amount_epsilon: float = 0.01
    date_days_tolerance: int = 3


@dataclass(frozen=True)
class Matching:
    primary_key: str = "pan"
    enable_fuzzy_matching: bool = False
    fuzzy_threshold: float = 0.90
    fuzzy_secondary_keys: Names = ()
    source_overrides: dict[str, dict[str, Any]] = field(default_factory=dict)


@dataclass(frozen=True)
class Validation:
    require_pan: bool = True
    validate_kyc_status: bool = True
    validate_fatca_status: bool = True
    allowed_kyc_statuses: Names = ()
    allowed_fatca_statuses: Names = ()
    suppress_missing_in_report_for_incomplete_crm: bool = False


@dataclass(frozen=True)
class Reporting:
    default_output_formats: Names = ()
    formats: Names | None = None
    redact_sensitive_fields: bool = True
    redaction_key: str = ""
    severity_mappings: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ReconConfig:
    output_directory: str = "outputs"
    configure_logging: bool = False
    engine: EngineSettings = field(default_factory=EngineSettings)
    matching: Matching = field(default_factory=Matching)
    validation: Validation = field(default_factory=Validation)
    reporting: Reporting = field(default_factory=Reporting)
    sources: dict[str, SourceProfile] = field(default_factory=dict)


# Profiles used when the configuration names none for a source.
_EIGHT = (
    "pan", "investor_name", "mobile", "email",
    "kyc_status", "fatca_status", "investor_status", "total_amount",
)
DEFAULT_CRM_PROFILE = SourceProfile(
    available_fields=_EIGHT,
    required_fields=("pan", "investor_name"),
    compare=("pan", "investor_name"),
    validations=("pan_format", "mobile_format", "email_format"),
)
DEFAULT_REPORT_PROFILE = SourceProfile(  # validation of a file-based run
    available_fields=("pan", "investor_name", "mobile", "email", "total_amount"),
    required_fields=("pan", "investor_name"),
    compare=("pan", "investor_name", "mobile", "total_amount"),
    validations=("pan_format", "mobile_format"),
)
DEFAULT_COMPARE_PROFILE = SourceProfile(  # comparison of prepared tables
    available_fields=_EIGHT,
    required_fields=("pan", "investor_name"),
    compare=_EIGHT,
    validations=("pan_format", "mobile_format", "email_format"),
)


def load_config(path: str | Path) -> ReconConfig:
    import yaml

    path = Path(path)
    if not path.exists():
        raise FileAccessError(f"Configuration file not found at: {path}")
    try:
        data = yaml.safe_load(path.read_text(encoding="utf-8"))
    except (yaml.YAMLError, OSError) as err:
        raise ConfigurationError(f"Failed to read or parse YAML syntax: {err}") from err
    return config_from_dict(data or {})


def config_from_dict(data: dict[str, Any]) -> ReconConfig:
    return _build(ReconConfig, data, "")


def _build(cls: type, data: Any, where: str) -> Any:
    """Fill dataclass `cls` from a mapping; unknown keys are ignored, wrong types refused."""
    if not isinstance(data, dict):
        raise ConfigurationError(f"Configuration validation failed: {where or 'root'} must be a mapping")
    hints = typing.get_type_hints(cls)
    values = {
        f.name: _value(hints[f.name], data[f.name], f"{where}{f.name}")
        for f in dataclasses.fields(cls)
        if f.name in data
    }
    return cls(**values)


def _value(hint: Any, value: Any, where: str) -> Any:
    if dataclasses.is_dataclass(hint):
        return _build(hint, value, where + ".")
    if hint == dict[str, SourceProfile]:
        if not isinstance(value, dict):
            raise ConfigurationError(f"Configuration validation failed: {where} must be a mapping")
        return {name: _build(SourceProfile, p, f"{where}.{name}.") for name, p in value.items()}
    if value is None and type(None) in typing.get_args(hint):
        return None
    if "tuple" in str(hint):
        if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) for v in value):
            raise ConfigurationError(f"Configuration validation failed: {where} must be a list of strings")
        return tuple(value)
    if typing.get_origin(hint) is dict:
        if not isinstance(value, dict):
            raise ConfigurationError(f"Configuration validation failed: {where} must be a mapping")
        return dict(value)
    try:
        if hint is bool:
            flags = {"true": True, "yes": True, "on": True, "1": True,
                     "false": False, "no": False, "off": False, "0": False}
            return flags[str(value).strip().lower()]
        if hint is str:
            return str(value)
        return hint(value)
    except (KeyError, TypeError, ValueError) as err:
        raise ConfigurationError(f"Configuration validation failed: {where}: {value!r}") from err


class Profiles:
    """Per-source rules as column predicates over the `source` column.

    `lists("compare", "email")` is true on rows whose source compares e-mails. The rules are
    literals, so the predicates are a few `IN` lists and need no join.
    """

    def __init__(self, configured: dict[str, SourceProfile], fallback: SourceProfile) -> None:
        self._configured = configured
        self._fallback = fallback

    def lists(self, attribute: str, *names: str) -> Column:
        def has(profile: SourceProfile) -> bool:
            listed = {n.strip().lower() for n in getattr(profile, attribute)}
            return any(n in listed for n in names)

        source = F.col("source")
        yes = [s for s, p in self._configured.items() if has(p)]
        hit = source.isin(yes) if yes else F.lit(False)
        if not has(self._fallback):
            return hit
        known = list(self._configured)
        other = ~source.isin(known) if known else F.lit(True)
        return hit | other

    def names(self, attribute: str) -> list[str]:
        """Every name listed by any profile, first mention first."""
        profiles = [*self._configured.values(), self._fallback]
        return list(dict.fromkeys(n.strip().lower() for p in profiles for n in getattr(p, attribute)))

    def by_source(self, value) -> Column:
        """`value(profile)` as a column chosen by the row's source."""
        out = None
        for name, profile in self._configured.items():
            test = F.col("source") == name
            out = F.when(test, value(profile)) if out is None else out.when(test, value(profile))
        last = value(self._fallback)
        return last if out is None else out.otherwise(last)


def standard_profiles() -> dict[str, SourceProfile]:
    """The six report sources with all the fields each of them can carry."""
    name = ("pan", "investor_name")
    states = ("investor_status", "kyc_status", "fatca_status")

    def profile(contacts: Names, states: Names, folio: bool, compare_contacts: Names | None = None) -> SourceProfile:
        available = (*name, *contacts, "total_amount", *states, "tax_status", *EXTENDED_FIELDS)
        return SourceProfile(
            available_fields=(*available, "folio_number") if folio else available,
            required_fields=name,
            compare=(*name, *(contacts if compare_contacts is None else compare_contacts),
                     "total_amount", *states, *EXTENDED_FIELDS),
            validations=("pan_format", *(f"{c}_format" for c in (compare_contacts or contacts))),
        )

    return {
        "CAMS": profile(("mobile", "email"), states, folio=True),
        "KFINTECH": profile(("mobile",), states, folio=True),
        "BSE": profile(("email",), states, folio=False),
        "NSE": profile(("mobile", "email"), states, folio=False),
        "INSURANCE": profile(("mobile", "email"), (), folio=True),
        "PDF_CAS": profile(("mobile", "email"), (), folio=True, compare_contacts=("mobile",)),
    }


def standard_config() -> ReconConfig:
    """Settings of a usual run: fuzzy fallback on, tolerances and severities set."""
    return ReconConfig(
        engine=EngineSettings(run_mode="TOLERANT", amount_epsilon=0.05, date_days_tolerance=3),
        matching=Matching(
            enable_fuzzy_matching=True,
            fuzzy_threshold=0.9,
            fuzzy_secondary_keys=("mobile", "email"),
            source_overrides={"CAMS": {"enable_fuzzy_matching": True, "fuzzy_threshold": 0.88}},
        ),
        validation=Validation(
            allowed_kyc_statuses=("VERIFIED", "EXEMPT"),
            allowed_fatca_statuses=("COMPLIANT",),
            suppress_missing_in_report_for_incomplete_crm=True,
        ),
        reporting=Reporting(
            default_output_formats=("excel", "csv", "json"),
            redact_sensitive_fields=False,
            severity_mappings={
                "AMOUNT_MISMATCH": "CRITICAL",
                "DATE_MISMATCH": "LOW",
                "EMAIL_MISMATCH": "MEDIUM",
                "FATCA_MISMATCH": "HIGH",
                "FIELD_EMPTY": "MEDIUM",
                "FIELD_MISSING": "MEDIUM",
                "INCOMPLETE_CRM_RECORD": "MEDIUM",
                "KYC_MISMATCH": "MEDIUM",
                "MISSING_IN_CRM": "CRITICAL",
                "MISSING_IN_REPORT": "HIGH",
                "MOBILE_MISMATCH": "MEDIUM",
                "NAME_MISMATCH": "HIGH",
            },
        ),
        sources=standard_profiles(),
    )
