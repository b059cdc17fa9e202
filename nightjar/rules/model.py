"""Detection rules and behaviour chains: model, validation, loading.

Rules are read from YAML (or JSON) files with the keys ``id name platform
severity mitre_attack description detection whitelist response``; chains have
``window_seconds`` and ``stages`` instead of ``detection``.
"""

from __future__ import annotations

import json
import logging
import re
from dataclasses import dataclass, field
from pathlib import Path

from ..schema import PLATFORMS, SEVERITIES
from . import patterns

log = logging.getLogger(__name__)

CRITERIA = ("process_name", "command_contains", "command_contains_any", "command_regex", "parent_process", "user_pattern")
_LISTS, _REGEXES = ("command_contains", "command_contains_any", "process_name_any"), ("command_regex", "user_pattern")
STAGE_CRITERIA = ("process_name", "process_name_any", "command_contains", "command_contains_any", "command_regex", "user_pattern")
WHITELISTS = ("users", "parent_processes", "paths")
MAX_WINDOW = 86_400


class RuleError(ValueError):
    """A rule or chain that cannot be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    platform: str
    severity: str
    detection: dict
    mitre_attack: tuple[str, ...] = ()
    description: str = ""
    whitelist: dict = field(default_factory=dict)
    response: tuple[str, ...] = ()
    false_positives: tuple[str, ...] = ()

    @property
    def criteria(self) -> tuple[str, ...]:
        """Configured criteria in matching order; an empty process name still counts, last."""
        found = [c for c in CRITERIA if self.detection.get(c)]
        if "process_name" in self.detection and "process_name" not in found:
            found.append("process_name")
        return tuple(found)

    def to_dict(self) -> dict:
        return {"id": self.id, "name": self.name, "platform": self.platform, "severity": self.severity, "mitre_attack": list(self.mitre_attack), "description": self.description,
                "detection": self.detection, "whitelist": self.whitelist, "response": list(self.response), "false_positives": list(self.false_positives)}


@dataclass(frozen=True)
class Stage:
    name: str
    match: dict
    relation: str = "child"


@dataclass(frozen=True)
class Chain:
    id: str
    name: str
    platform: str
    severity: str
    window_seconds: int
    stages: tuple[Stage, ...]
    mitre_attack: tuple[str, ...] = ()
    description: str = ""
    response: tuple[str, ...] = ()


def _texts(where: str, value, least: int = 0) -> None:
    if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
        raise RuleError(f"{where} must be a list of texts")
    if len(value) < least:
        raise RuleError(f"{where} must not be empty")


def check_regex(where: str, pattern: str) -> None:
    """The pattern must be one that both the rule author's dialect and Spark's accept."""
    if problem := patterns.check(pattern):
        raise RuleError(f"{where}: {problem}")


def _criteria(where: str, match: dict, known) -> None:
    if not isinstance(match, dict) or not match:
        raise RuleError(f"{where} must hold at least one criterion")
    if odd := set(match) - set(known):
        raise RuleError(f"{where}: unknown criteria {sorted(odd)}")
    for k, v in match.items():
        if k in _LISTS:
            _texts(f"{where}.{k}", v, 1)
        elif not isinstance(v, str):
            raise RuleError(f"{where}.{k} must be a text")
        if k in _REGEXES:
            check_regex(f"{where}.{k}", v)


def _common(d: dict, id_pattern: str, needed) -> None:
    if not isinstance(d, dict):
        raise RuleError("a rule must be a mapping")
    if lost := [k for k in needed if k not in d]:
        raise RuleError(f"{d.get('id', '?')}: missing {lost}")
    for k in ("id", "name", "platform", "severity"):
        if not isinstance(d[k], str):
            raise RuleError(f"{k} must be a text")
    if not re.search(id_pattern, d["id"]):
        raise RuleError(f"malformed id {d['id']!r}")
    if d["platform"] not in PLATFORMS:
        raise RuleError(f"{d['id']}: unknown platform {d['platform']!r}")
    if d["severity"] not in SEVERITIES:
        raise RuleError(f"{d['id']}: unknown severity {d['severity']!r}")
    _texts(f"{d['id']}.mitre_attack", d.get("mitre_attack") or [])
    for t in d.get("mitre_attack") or []:
        if not re.search(r"^T[0-9]{4}(\.[0-9]{3})?$", t):
            raise RuleError(f"{d['id']}: malformed technique {t!r}")


def _tuple(value) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value or ())


def parse_rule(d: dict) -> Rule:
    """A validated rule, or RuleError."""
    _common(d, r"^(WIN|LNX|MAC)-[0-9]{3}$", ("name", "id", "platform", "severity", "detection"))
    _criteria(f"{d['id']}.detection", d["detection"], CRITERIA)
    white = d.get("whitelist") or {}
    if not isinstance(white, dict):
        raise RuleError(f"{d['id']}.whitelist must be a mapping")
    for k in WHITELISTS:
        _texts(f"{d['id']}.whitelist.{k}", white.get(k) or [])
    return Rule(d["id"], d["name"], d["platform"], d["severity"], dict(d["detection"]), _tuple(d.get("mitre_attack")), d.get("description") or "", {k: tuple(white[k]) for k in WHITELISTS if white.get(k)}, _tuple(d.get("response")), _tuple(d.get("false_positives")))


def parse_chain(d: dict) -> Chain:
    """A validated chain, or RuleError."""
    _common(d, r"^CHAIN-(WIN|LNX|MAC)-[0-9]{3}$", ("name", "id", "platform", "severity", "window_seconds", "stages"))
    if odd := set(d) - {"name", "id", "platform", "severity", "window_seconds", "stages", "mitre_attack", "description", "false_positives", "response"}:
        raise RuleError(f"{d['id']}: unknown keys {sorted(odd)}")
    w = d["window_seconds"]
    if not isinstance(w, int) or isinstance(w, bool) or not 1 <= w <= MAX_WINDOW:
        raise RuleError(f"{d['id']}.window_seconds must be 1 to {MAX_WINDOW}")
    if not isinstance(d["stages"], list) or len(d["stages"]) < 2:
        raise RuleError(f"{d['id']} needs two stages at least")
    stages = []
    for s in d["stages"]:
        if not isinstance(s, dict) or not isinstance(s.get("name"), str) or set(s) - {"name", "relation", "match"}:
            raise RuleError(f"{d['id']}: malformed stage")
        if s.get("relation", "child") not in ("child", "descendant"):
            raise RuleError(f"{d['id']}: unknown relation {s['relation']!r}")
        _criteria(f"{d['id']}.{s['name']}", s.get("match"), STAGE_CRITERIA)
        stages.append(Stage(s["name"], dict(s["match"]), s.get("relation", "child")))
    return Chain(d["id"], d["name"], d["platform"], d["severity"], w, tuple(stages), _tuple(d.get("mitre_attack")), d.get("description") or "", _tuple(d.get("response")))


def read_file(path: str | Path) -> dict:
    """A rule file's mapping; YAML needs the yaml library, JSON needs nothing."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuleError("reading YAML rules needs the yaml library; use JSON files instead") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuleError(f"{path}: {e}") from e


def _load(files, parse) -> list:
    found: dict[str, object] = {}
    for f in files:
        try:
            item = parse(read_file(f))
        except (RuleError, OSError, ValueError) as e:
            log.warning("%s is skipped: %s", f, e)
            continue
        if item.id in found:
            log.warning("%s is skipped: %s is already defined", f, item.id)
            continue
        found[item.id] = item
    return [found[k] for k in sorted(found)]


def _files(folder: str | Path) -> list[Path]:
    root = Path(folder)
    return sorted(p for p in root.rglob("*") if p.suffix in (".yml", ".yaml", ".json")) if root.is_dir() else []


def load_rules(folder: str | Path, platform: str | None = None) -> list[Rule]:
    """All valid rules below a folder, by id; files of a folder ``correlation`` and invalid files are skipped."""
    files = [p for p in _files(folder) if "correlation" not in p.parts and "schema" not in p.name and p.name != "manifest.json"]
    return [r for r in _load(files, parse_rule) if platform in (None, r.platform)]


def load_chains(folder: str | Path) -> list[Chain]:
    """All valid chains of a folder, by id; of equal ids the first file counts; a missing folder has none."""
    return _load([p for p in _files(folder) if "schema" not in p.name], parse_chain)


def rule_by_id(rules: list[Rule], rule_id: str) -> Rule:
    for r in rules:
        if r.id == rule_id:
            return r
    raise KeyError(f"no rule {rule_id}")


def rules_of(rules: list[Rule], platform: str | None = None, severity: str | None = None) -> list[Rule]:
    return [r for r in rules if platform in (None, r.platform) and severity in (None, r.severity)]
