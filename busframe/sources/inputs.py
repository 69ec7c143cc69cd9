"""Which recordings a run reads: paths, a manifest or a pattern. Small lists, kept in order on the driver."""

from __future__ import annotations

import os
import re
from pathlib import Path

from busframe.errors import BadUsage

MOST = 256


def manifest(path: str) -> list[str]:
    """One path a line; blank lines and those that begin with # don't count."""
    lines = (x.strip() for x in Path(path).read_text("utf-8").splitlines())
    return [x for x in lines if x and not x.startswith("#")]


def matching(pattern: str) -> list[str]:
    """Regular files of one folder by name, sorted; only * and ? in the name are special."""
    folder, name = os.path.split(pattern)
    form = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in name), re.DOTALL)
    with os.scandir(folder or ".") as entries:
        return sorted(str(Path(folder) / e.name) for e in entries if e.is_file() and form.fullmatch(e.name))


def resolve(paths: list[str] = (), manifest_path: str | None = None, pattern: str | None = None) -> list[str]:
    """Exactly one of the three ways, and 1 to 256 recordings."""
    if sum((bool(paths), manifest_path is not None, pattern is not None)) != 1:
        raise BadUsage("name recordings, a manifest or a pattern, and only one of them")
    out = list(paths) if paths else manifest(manifest_path) if manifest_path is not None else matching(pattern)
    if not 1 <= len(out) <= MOST:
        raise BadUsage(f"1 to {MOST} recordings are read at a time, not {len(out)}")
    return out
