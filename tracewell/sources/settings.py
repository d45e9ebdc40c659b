"""Settings of a scan: defaults, then environment, then a JSON file; the later wins."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from copy import deepcopy

from tracewell.operators.rulespec import SEVERITIES
from tracewell.sources.files import EXCLUDED

PREFIX = "TRACEWELL__"
DEFAULTS: dict[str, dict] = {
    "scanning": {"max_file_size_kb": 10 * 1024, "exclude_dirs": list(EXCLUDED), "exclude_extensions": [], "min_severity": "LOW", "severity_overrides": {}},
    "reporting": {"output_dir": "reports", "default_format": "json", "include_snippets": True},
    "notifiers": {"chat": False, "tickets": False, "mail": False},
}


class SettingsError(ValueError):
    pass


def _value(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return text


def _checked(settings: dict) -> dict:
    scanning = settings["scanning"]
    names = [scanning["min_severity"], *scanning["severity_overrides"].values()]
    if unknown := [n for n in names if str(n).upper() not in SEVERITIES]:
        raise SettingsError(f"unknown severity {unknown[0]}")
    if scanning["max_file_size_kb"] <= 0:
        raise SettingsError("max_file_size_kb is above 0")
    return settings


def load_settings(path: str | None = None, env: Mapping[str, str] = os.environ) -> dict[str, dict]:
    """Settings by section. ``TRACEWELL__SCANNING__MIN_SEVERITY=HIGH`` sets ``scanning.min_severity``; values are JSON or text.

    A missing file leaves the others; one that can't be parsed, an unknown name, a value of another type, an unknown severity or a
    size of 0 raise ``SettingsError``.
    """
    layers: list[tuple[str, str, object]] = []
    for key, text in sorted(env.items()):
        parts = key.removeprefix(PREFIX).lower().split("__")
        if key.startswith(PREFIX) and len(parts) == 2:
            layers.append((*parts, _value(text)))
    if path is not None and os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                given = json.load(f)
            layers += [(section, name, value) for section, values in given.items() for name, value in values.items()]
        except (ValueError, AttributeError) as e:
            raise SettingsError(f"can't read {path}: {e}") from e
    out = deepcopy(DEFAULTS)
    for section, name, value in layers:
        if section not in out or name not in out[section]:
            raise SettingsError(f"unknown setting {section}.{name}")
        if type(value) is not type(out[section][name]):
            raise SettingsError(f"{section}.{name} is a {type(out[section][name]).__name__}")
        out[section][name] = value
    return _checked(out)


def ignore_lines(path: str) -> list[str]:
    """The lines of an ignore file; none if there is no such file."""
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8", errors="ignore") as f:
        return f.read().splitlines()
