"""API keys with scopes. Keys are stored as SHA-256 digests and compared in constant time."""

from __future__ import annotations

import hashlib
import hmac
import json
import secrets
from dataclasses import dataclass
from pathlib import Path

IMPLIED = {"read": {"read"}, "scan": {"scan", "read"}, "admin": {"admin", "scan", "read"}}


class Unauthorized(PermissionError):
    status = 401


class Forbidden(PermissionError):
    status = 403


def expand(scopes) -> frozenset[str]:
    """Scopes with all they imply; an unknown scope is an error."""
    out: set[str] = set()
    for s in scopes:
        if s not in IMPLIED:
            raise ValueError(f"unknown scope {s!r}")
        out |= IMPLIED[s]
    return frozenset(out)


@dataclass(frozen=True)
class KeyRecord:
    label: str
    digest: str
    scopes: frozenset[str]


def digest(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


class KeyStore:
    def __init__(self, records: list[KeyRecord]) -> None:
        self.records = list(records)

    @classmethod
    def from_records(cls, rows: list[dict]) -> KeyStore:
        labels = [r["label"] for r in rows]
        if len(set(labels)) != len(labels):
            raise ValueError("labels must differ")
        return cls([KeyRecord(r["label"], r.get("digest") or digest(r["key"]), expand(r.get("scopes") or ["read"])) for r in rows])

    @classmethod
    def load(cls, path: str) -> KeyStore:
        """A JSON list of records, or a text file with one key that may do everything."""
        text = Path(path).read_text().strip()
        if not text:
            raise ValueError(f"{path} holds no key")
        return cls.from_records(json.loads(text)) if text.startswith("[") else cls.from_records([{"label": "default", "key": text, "scopes": ["admin"]}])

    def find(self, key: str) -> KeyRecord | None:
        mine, found = digest(key), None
        for r in self.records:  # all are compared, so the time does not tell which fits
            if hmac.compare_digest(mine, r.digest):
                found = r
        return found

    def require(self, header: str | None, scope: str) -> KeyRecord:
        """The record of a ``Bearer`` header that has a scope."""
        kind, _, key = (header or "").partition(" ")
        record = self.find(key.strip()) if kind.lower() == "bearer" and key.strip() else None
        if record is None:
            raise Unauthorized("a valid key is needed")
        if scope not in record.scopes:
            raise Forbidden(f"the key lacks the scope {scope}")
        return record


def new_key(label: str, scopes=("read",)) -> tuple[str, dict]:
    """A fresh key and the record to store for it."""
    key = secrets.token_urlsafe(32)
    return key, {"label": label, "digest": digest(key), "scopes": sorted(expand(scopes))}
