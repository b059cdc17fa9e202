"""Checks a log source before it is read."""

from __future__ import annotations

import stat
from pathlib import Path

EXTENSIONS = {"linux": {".log", ""}, "windows": {".evtx", ".xml"}, "macos": {".ndjson", ".json", ".log"}}
MAX_BYTES, MAX_DEPTH = 100 * 1024 * 1024, 20


class SourceError(ValueError):
    """A source that may not be read."""


def check_source(path: str, platform: str, allowed: list[str] | None = None, max_bytes: int | None = MAX_BYTES) -> str:
    """The resolved path of a local source, or SourceError.

    It must exist, be a file or folder inside one of ``allowed`` (links resolved), have a
    suffix of its platform, and not be larger than ``max_bytes``.
    """
    if not path or not path.strip():
        raise SourceError("the source is empty")
    if "\x00" in path:
        raise SourceError("the source contains a null character")
    if platform not in EXTENSIONS:
        raise SourceError(f"unknown platform {platform!r}")
    p = Path(path)
    if not p.exists():
        raise SourceError(f"the source does not exist: {path}")
    real = p.resolve()
    if len(real.parts) > MAX_DEPTH:
        raise SourceError("the source lies too deep")
    mode = real.stat().st_mode
    if not (stat.S_ISREG(mode) or stat.S_ISDIR(mode)):
        raise SourceError("the source is neither a file nor a folder")
    if allowed and not any(real.is_relative_to(Path(a).resolve()) for a in allowed):
        raise SourceError("the source lies outside the allowed folders")
    if stat.S_ISREG(mode):
        name = real.name
        if real.suffix.lower() not in EXTENSIONS[platform] and not (platform == "linux" and name.startswith("audit.log")):
            raise SourceError(f"the suffix {real.suffix!r} is not one of {platform}")
        if max_bytes is not None and real.stat().st_size > max_bytes:
            raise SourceError(f"the source is larger than {max_bytes} bytes")
        with real.open("rb"):  # a file that cannot be opened is an error here, not in a task
            pass
    return str(real)
