"""Signed rule packs: build, verify, and a registry with staging, activation and rollback."""

from __future__ import annotations

import argparse
import hashlib
import hmac
import json
import shutil
import sys
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from .model import Chain, Rule, RuleError, load_chains, load_rules, parse_chain, parse_rule, read_file

FORMAT = 1
MANIFEST, SIGNATURE = "manifest.json", "manifest.sig"


class PackError(RuleError):
    """A pack that cannot be built or trusted."""


@dataclass
class Verification:
    valid: bool
    problems: list[str] = field(default_factory=list)
    version: str | None = None

    def require(self) -> Verification:
        if not self.valid:
            raise PackError("; ".join(self.problems))
        return self


def _canonical(manifest: dict) -> bytes:
    return json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()


def _sign(manifest: dict, key: bytes) -> str:
    return hmac.new(key, _canonical(manifest), hashlib.sha256).hexdigest()


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _rule_files(root: Path) -> list[Path]:
    return sorted(p for p in root.rglob("*") if p.is_file() and not p.is_symlink() and p.suffix in (".yml", ".yaml", ".json") and p.name != MANIFEST)


def _inside(root: Path, name: str) -> Path | None:
    p = root / name
    ok = not Path(name).is_absolute() and ".." not in Path(name).parts and p.resolve().is_relative_to(root.resolve())
    return p if ok else None


def build_manifest(root: str | Path, version: str, author: str = "", now: datetime | None = None) -> dict:
    base = Path(root)
    files, ids = {}, []
    for p in _rule_files(base):
        if "schema" in p.name:
            continue
        d = read_file(p)
        item = parse_chain(d) if isinstance(d, dict) and "stages" in d else parse_rule(d)
        if item.id in ids:
            raise PackError(f"{item.id} is defined twice")
        ids.append(item.id)
        files[p.relative_to(base).as_posix()] = _digest(p)
    if not files:
        raise PackError("a pack holds one rule at least")
    return {"format": FORMAT, "version": version, "author": author, "created": (now or datetime.now(UTC)).isoformat(), "rules": sorted(ids), "files": files}


def build_pack(source: str | Path, target: str | Path, version: str, key: bytes, author: str = "", now: datetime | None = None) -> Path:
    """Copy a folder of rules to ``target`` with a signed manifest."""
    if not key:
        raise PackError("a signing key is needed")
    out = Path(target)
    if out.exists() and any(out.iterdir()):
        raise PackError(f"{out} is not empty")
    manifest = build_manifest(source, version, author, now)
    for name in manifest["files"]:
        (out / name).parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(Path(source) / name, out / name)
    (out / MANIFEST).write_text(json.dumps(manifest, indent=2, sort_keys=True))
    (out / SIGNATURE).write_text(_sign(manifest, key))
    return out


def verify_pack(root: str | Path, key: bytes) -> Verification:
    """Signature first, then every file: nothing missing, changed or added."""
    base = Path(root)
    try:
        manifest = json.loads((base / MANIFEST).read_text())
        signature = (base / SIGNATURE).read_text().strip()
    except (OSError, ValueError) as e:
        return Verification(False, [f"unreadable manifest or signature: {e}"])
    if not isinstance(manifest, dict) or not hmac.compare_digest(_sign(manifest, key), signature):
        return Verification(False, ["the signature does not fit"])
    problems, version = [], manifest.get("version")
    if manifest.get("format") != FORMAT:
        problems.append(f"unknown format {manifest.get('format')!r}")
    files = manifest.get("files") or {}
    for name, digest in files.items():
        p = _inside(base, name)
        if p is None:
            problems.append(f"{name} lies outside the pack")
        elif not p.is_file():
            problems.append(f"{name} is missing")
        elif not hmac.compare_digest(_digest(p), digest):
            problems.append(f"{name} was changed")
    problems += [f"{n} is not listed" for p in _rule_files(base) if (n := p.relative_to(base).as_posix()) not in files]
    return Verification(not problems, problems, version)


def load_verified(root: str | Path, key: bytes) -> tuple[list[Rule], list[Chain]]:
    verify_pack(root, key).require()
    base = Path(root)
    chains = [c for c in load_chains(base / "correlation")] if (base / "correlation").is_dir() else []
    return load_rules(base), chains


class PackRegistry:
    """Verified packs by version in one folder; a pointer names the active one and the one before."""

    def __init__(self, root: str | Path, key: bytes) -> None:
        self.root, self.key = Path(root), key
        (self.root / "packs").mkdir(parents=True, exist_ok=True)

    def _pointer(self) -> dict:
        p = self.root / "active.json"
        return json.loads(p.read_text()) if p.exists() else {"active": None, "previous": None}

    def _point(self, value: dict) -> None:
        part = self.root / "active.part"
        part.write_text(json.dumps(value))
        part.replace(self.root / "active.json")

    def _note(self, action: str, version: str | None, actor: str) -> None:
        with (self.root / "audit.jsonl").open("a") as f:
            f.write(json.dumps({"at": datetime.now(UTC).isoformat(), "action": action, "version": version, "actor": actor}) + "\n")

    def stage(self, pack: str | Path, actor: str = "") -> str:
        found = verify_pack(pack, self.key).require()
        if not found.version or "/" in found.version or found.version in (".", ".."):
            raise PackError(f"malformed version {found.version!r}")
        to = self.root / "packs" / found.version
        if to.exists():
            raise PackError(f"version {found.version} is already staged")
        shutil.copytree(pack, to)
        self._note("stage", found.version, actor)
        return found.version

    def activate(self, version: str, actor: str = "") -> None:
        verify_pack(self.root / "packs" / version, self.key).require()
        self._point({"active": version, "previous": self.active_version})
        self._note("activate", version, actor)

    def rollback(self, actor: str = "") -> str:
        old = self._pointer()
        if not old["previous"]:
            raise PackError("there is no version to go back to")
        verify_pack(self.root / "packs" / old["previous"], self.key).require()
        self._point({"active": old["previous"], "previous": old["active"]})
        self._note("rollback", old["previous"], actor)
        return old["previous"]

    @property
    def active_version(self) -> str | None:
        return self._pointer()["active"]

    @property
    def active_path(self) -> Path | None:
        return self.root / "packs" / self.active_version if self.active_version else None


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="nightjar-packs", description="Build and manage signed rule packs.")
    p.add_argument("--key-file", required=True)
    sub = p.add_subparsers(dest="action", required=True)
    b = sub.add_parser("build")
    b.add_argument("source"), b.add_argument("target"), b.add_argument("--version", required=True), b.add_argument("--author", default="")
    sub.add_parser("verify").add_argument("pack")
    for name in ("stage", "activate", "rollback"):
        s = sub.add_parser(name)
        s.add_argument("registry")
        if name != "rollback":
            s.add_argument("pack" if name == "stage" else "version")
    a = p.parse_args(args)
    key = Path(a.key_file).read_bytes().strip()
    try:
        if a.action == "build":
            print(build_pack(a.source, a.target, a.version, key, a.author))
        elif a.action == "verify":
            print(verify_pack(a.pack, key).require().version)
        elif a.action == "stage":
            print(PackRegistry(a.registry, key).stage(a.pack))
        elif a.action == "activate":
            PackRegistry(a.registry, key).activate(a.version)
        else:
            print(PackRegistry(a.registry, key).rollback())
    except RuleError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
