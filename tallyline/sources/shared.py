"""Files that Python tasks open themselves: by a local path, or by an address of a file system that Arrow knows."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def opened(path: str):
    """The file for reading, with seek."""
    system, inside = _place(path)
    return system.open_input_file(inside)


def version(path: str) -> tuple[str, int, int]:
    """Path, size and time of change: what tells one content of a path from the next."""
    system, inside = _place(path)
    found = system.get_file_info(inside)
    return path, found.size or 0, found.mtime_ns or 0


def exists(path: str) -> bool:
    system, inside = _place(path)
    return system.get_file_info(inside).type == fs.FileType.File


def read_whole(path: str) -> bytes:
    with opened(path) as f:
        return f.read()


def write_whole(path: str, data: bytes) -> None:
    """Writes beside the path and moves there, so that no reader sees half a file."""
    system, inside = _place(path)
    system.create_dir(inside.rpartition("/")[0], recursive=True)
    beside = f"{inside}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as f:
        f.write(data)
    system.move(beside, inside)


def names(folder: str) -> list[str]:
    """Names of a folder's files; none if there is no such folder."""
    system, inside = _place(folder)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)) if x.type == fs.FileType.File)


def remove(path: str) -> None:
    system, inside = _place(path)
    system.delete_file(inside)
