"""Configuration: defaults, a YAML or JSON file merged over them, validation, and a cache."""

from __future__ import annotations

import copy
import os
from pathlib import Path

from .rules.model import RuleError, read_file

DEFAULTS = {
    "store": {"path": "nightjar-store"},
    "rules": {"directory": None, "chains": None},
    "dedup": {"window_hours": 24},
    "sources": {"allowed": [], "max_bytes": 100 * 1024 * 1024},
    "logging": {"level": "INFO", "file": None},
    "api": {"host": "127.0.0.1", "port": 8080, "keys_file": None, "require_auth": True, "cors_origins": []},
}
_KINDS = {("store", "path"): str, ("dedup", "window_hours"): int, ("sources", "allowed"): list, ("sources", "max_bytes"): int, ("logging", "level"): str, ("api", "host"): str, ("api", "port"): int, ("api", "require_auth"): bool, ("api", "cors_origins"): list}
_cache: dict[str, dict] = {}


class ConfigurationError(ValueError):
    """A configuration that cannot be used."""


def merge(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, mapping by mapping."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def validate(c: dict) -> dict:
    for section in DEFAULTS:
        if not isinstance(c.get(section), dict):
            raise ConfigurationError(f"{section} must be a mapping")
    for (section, key), kind in _KINDS.items():
        v = c[section].get(key)
        if not isinstance(v, kind) or kind is int and isinstance(v, bool):
            raise ConfigurationError(f"{section}.{key} must be of type {kind.__name__}")
    if not 1 <= c["api"]["port"] <= 65_535:
        raise ConfigurationError("api.port must be 1 to 65535")
    if c["dedup"]["window_hours"] < 1:
        raise ConfigurationError("dedup.window_hours must be 1 at least")
    if c["logging"]["level"].upper() not in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
        raise ConfigurationError(f"unknown level {c['logging']['level']!r}")
    return c


def load_config(path: str | None = None) -> dict:
    """Defaults with the file's values; a named file must exist, no file is fine."""
    path = path or os.environ.get("NIGHTJAR_CONFIG")
    if not path:
        return validate(copy.deepcopy(DEFAULTS))
    if not Path(path).is_file():
        raise ConfigurationError(f"{path} does not exist")
    try:
        found = read_file(path)
    except (RuleError, ValueError) as e:
        raise ConfigurationError(str(e)) from e
    if not isinstance(found or {}, dict):
        raise ConfigurationError("the configuration must be a mapping")
    return validate(merge(DEFAULTS, found or {}))


def get_config(path: str | None = None) -> dict:
    return _cache.setdefault(path or "", load_config(path))


def reset_cache() -> None:
    _cache.clear()
