"""Small files of the ledger: atomic writes, confined paths, a lock."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path
from typing import Any


def text_of(document: Any) -> str:
    return json.dumps(document, indent=2) + "\n"


def write_text(path: str | Path, text: str, overwrite: bool = False) -> Path:
    """Writes the whole file or none of it, with plain line feeds. An existing file stays unless overwrite."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.exists() and not overwrite:
        return path
    handle, staged = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(staged, path)
    except BaseException:
        Path(staged).unlink(missing_ok=True)
        raise
    return path


def inside(folder: str | Path, name: str) -> Path:
    """The path of a file in the folder; raises ValueError if name leads out of it."""
    base = Path(folder).resolve()
    path = (base / name).resolve()
    if not isinstance(name, str) or path.parent != base:
        raise ValueError(f"{name!r} is not a file name in {folder}")
    return path


@contextlib.contextmanager
def locked(folder: str | Path) -> Iterator[None]:
    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(Path(folder) / ".lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield
