"""Incremental reading of a growing log file: complete lines only, from a checkpoint, safe against rotation."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


@dataclass(frozen=True)
class Checkpoint:
    source: str
    inode: int = 0
    offset: int = 0
    size: int = 0
    mtime: float = 0.0

    def rotated(self, st: os.stat_result) -> bool:
        """The file is another one, was cut, or was written anew at the same size."""
        if not self.inode:
            return False
        return st.st_ino != self.inode or st.st_size < self.offset or (st.st_size == self.size and st.st_mtime != self.mtime)


def read_new(path: str, old: Checkpoint | None = None, most: int | None = None) -> tuple[str, Checkpoint]:
    """The complete lines that were added since a checkpoint, and the next checkpoint."""
    old = old or Checkpoint(path)
    st = os.stat(path)
    start = 0 if old.rotated(st) else old.offset
    with open(path, "rb") as f:
        f.seek(start)
        data = f.read() if most is None else f.read(most)
    end = data.rfind(b"\n") + 1
    return data[:end].decode("utf-8", "replace"), Checkpoint(path, st.st_ino, start + end, st.st_size, st.st_mtime)


def hold_back(text: str, new: Checkpoint, consumed: int) -> Checkpoint:
    """The checkpoint after a parser used only the first ``consumed`` characters of ``text``."""
    if consumed >= len(text):
        return new
    left = len(text[consumed:].encode())
    return Checkpoint(new.source, new.inode, new.offset - left, new.size, new.mtime)


class CheckpointFile:
    """Checkpoints by source in one JSON file, replaced atomically."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def _all(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def load(self, source: str) -> Checkpoint | None:
        found = self._all().get(source)
        return Checkpoint(**found) if found else None

    def save(self, c: Checkpoint) -> None:
        all_ = self._all() | {c.source: asdict(c)}
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(all_))
        part.replace(self.path)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return asdict(Checkpoint(self.path))

    def read(self, start: dict):
        text, new = read_new(self.path, Checkpoint(**start), self.most)
        return iter([(x,) for x in text.splitlines()]), asdict(new)

    def readBetweenOffsets(self, start: dict, end: dict):
        first = start["offset"] if start["inode"] in (0, end["inode"]) and start["offset"] <= end["offset"] else 0
        with open(self.path, "rb") as f:
            f.seek(first)
            text = f.read(end["offset"] - first).decode("utf-8", "replace")
        return iter([(x,) for x in text.splitlines()])


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", ...)``: the lines of one growing file."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("maxBytes", 64 << 20)))
