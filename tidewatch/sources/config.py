"""TOML configuration."""

from __future__ import annotations

import math
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from tidewatch.model import SEVERITIES
from tidewatch.sources.files import Limits

# Sections, and the options of those that name theirs.
DETECTORS = ("brute_force", "port_scan", "suspicious_login", "privilege_escalation", "impossible_travel", "unusual_traffic")
OPTIONS = {"report": ("minimum_severity", "timezone"), "input": ("max_file_size_bytes", "max_line_length"), "llm": ("enabled", "provider", "model", "timeout_seconds")}
FOREST_OPTIONS = ("n_estimators", "max_samples", "contamination", "random_state")
DEFAULT_MODEL = "gpt-4o-mini"


class ConfigurationError(ValueError):
    """A configuration that was given cannot be used."""


@dataclass(frozen=True)
class Config:
    detector_options: dict[str, dict[str, Any]] = field(default_factory=dict)
    report_options: dict[str, Any] = field(default_factory=dict)
    input_limits: Limits = field(default_factory=Limits)
    ml_options: dict[str, dict[str, Any]] = field(default_factory=dict)
    llm_options: dict[str, Any] = field(default_factory=dict)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigurationError(message)


def _table(values: Mapping, name: str, label: str | None = None) -> dict:
    own = values.get(name, {})
    _need(isinstance(own, dict), f"configuration section '{label or name}' must be a table")
    return dict(own)


def _known(given: Mapping, allowed, what: str) -> None:
    extra = sorted(set(given) - set(allowed))
    _need(not extra, f"unknown {what}: {', '.join(extra)}")


def load(path: Path | None = None) -> Config:
    """The configuration of a file; without one, all defaults. Options of detectors are checked by their constructors."""
    if path is None:
        return Config()
    path = Path(path)
    _need(path.is_file(), f"configuration file does not exist: {path}")
    try:
        raw = tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigurationError(f"could not load configuration '{path}': {e}") from e
    _known(raw, (*DETECTORS, *OPTIONS, "ml"), "configuration section(s)")
    ml = _table(raw, "ml")
    _known(ml, ("isolation_forest",), "ML configuration section(s)")
    forest = _table(ml, "isolation_forest", "ml.isolation_forest")
    _known(forest, FOREST_OPTIONS, "isolation_forest option(s)")
    own = {name: _table(raw, name) for name in OPTIONS}
    for name, allowed in OPTIONS.items():
        _known(own[name], allowed, f"{name} option(s)")
    llm = own["llm"]
    _need(isinstance(llm.get("enabled", False), bool), "llm.enabled must be true or false")
    _need(llm.get("provider", "openai") == "openai", "llm.provider must be 'openai'")
    model = llm.get("model", DEFAULT_MODEL)
    _need(isinstance(model, str) and bool(model.strip()), "llm.model must be a non-empty string")
    seconds = llm.get("timeout_seconds", 20)
    number = isinstance(seconds, (int, float)) and not isinstance(seconds, bool) and math.isfinite(seconds)
    _need(number and 0 < seconds <= 300, "llm.timeout_seconds must be greater than 0 and at most 300")
    severity = own["report"].get("minimum_severity")
    _need(severity is None or severity in SEVERITIES, "report.minimum_severity must be one of LOW, MEDIUM, HIGH, or CRITICAL")
    try:
        limits = Limits(**own["input"])
    except (TypeError, ValueError) as e:
        raise ConfigurationError(f"invalid input limits: {e}") from e
    return Config({d: _table(raw, d) for d in DETECTORS}, own["report"], limits, {"isolation_forest": forest} if forest else {}, llm)
